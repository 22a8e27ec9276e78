"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.plans.tables import drop, written


def _digest(links: DataFrame, keys: list[str]) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())


def component_labels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, label) of every id in edges (keys, a, b), which join ids of equal keys: label is the smallest id that can be reached.

    A round ties the larger neighbours of each id to the smallest one that it knows, then all to that: the number of rounds grows with the logarithm
    of the longest path, and what an id knows is spread over its rows, never held. Keys are not null. An edge from an id to itself makes it a component of one."""
    alone = edges.select(*keys, F.col("a").alias("id")).unionByName(edges.select(*keys, F.col("b").alias("id"))).distinct()
    alone = written(alone, "ids")
    links = written(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    told, before = _digest(links, keys), None
    while told != before and told[0]:
        both = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least("a", F.min("b")).alias("_least"))
        large = written(both.where("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("_least").alias("b")).where("a <> b").distinct(), "links")
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("_least"))
        tied = large.join(least, [*keys, "a"])
        small = tied.select(*keys, "a", F.col("_least").alias("b")).unionByName(tied.select(*keys, F.col("b").alias("a"), F.col("_least").alias("b"))).where("a <> b").distinct()
        old, links, before = links, written(small, "links"), told
        drop(old, large)
        told = _digest(links, keys)
    return alone.join(links.withColumnsRenamed({"a": "id", "b": "_label"}), [*keys, "id"], "left").select(*keys, "id", F.coalesce("_label", "id").alias("label"))


def joining_edges(edges: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """Those of edges (keys, a, b, rank) that join two components when edges are added in order of their ranks, distinct within keys: the first spanning forest.

    In each round every component takes its first edge to another one, so rounds are a logarithm of the largest component."""
    edges = written(edges.where("a <> b"), "edges")
    chosen, labels = edges.limit(0), None
    while True:
        out = edges.withColumns({"_la": F.col("a"), "_lb": F.col("b")})
        if labels is not None:
            for end in ("a", "b"):
                known = labels.select(*keys, F.col("id").alias(end), F.col("label").alias("_known"))
                out = out.join(known, [*keys, end], "left").withColumn(f"_l{end}", F.coalesce("_known", end)).drop("_known")
        out = written(out.where("_la <> _lb"), "between")
        if out.isEmpty():
            return chosen
        best = out.select(*keys, F.explode(F.array("_la", "_lb")).alias("_part"), F.struct(*rank).alias("_rank")).groupBy(*keys, "_part").agg(F.min("_rank").alias("_rank"))
        best = best.select(*keys, *[F.col(f"_rank.{r}").alias(r) for r in rank]).distinct()
        chosen = written(chosen.unionByName(edges.join(best, [*keys, *rank], "left_semi")).distinct(), "forest")
        labels = component_labels(chosen.select(*keys, "a", "b"), keys)
