"""Density clusters of windows by a grid of cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.operators.components import component_labels
from rutine.operators.features import standardized
from rutine.operators.scans import numbered
from rutine.plans.tables import written

#: Dimensions that the key of the cells' join is made of; a cell goes to three to the power of so many neighbourhoods.
JOINED = 3
#: Share by which a distance may pass the radius: sums differ in their last digits by the order of adding, and what is exactly at the radius is near.
SLACK = 1e-12


def cell_edges(points: DataFrame, eps: float, size: int) -> DataFrame:
    """(log_id, a, b), a < b: pairs of cells, named by their first points, with points at most eps apart. points: (log_id, id, cell, first, v).

    Cells are joined by their neighbourhoods in the first dimensions; pairs of cells whose boxes are further apart than eps go before a point is read."""
    side, wide = _side(eps, size), _wide(eps, size)
    cells = points.groupBy("log_id", "first").agg(F.first("cell").alias("cell"))
    near = [F.floor(F.get("cell", F.lit(i)) / wide) for i in range(min(JOINED, size))]
    left = cells.select("log_id", F.col("first").alias("a"), F.col("cell").alias("_a"), *[c.alias(f"_q{i}") for i, c in enumerate(near)])
    right = cells.select("log_id", F.col("first").alias("b"), F.col("cell").alias("_b"), *[c.alias(f"_q{i}") for i, c in enumerate(near)])
    for i in range(len(near)):
        right = right.withColumn(f"_q{i}", F.explode(F.array(*[F.col(f"_q{i}") + step for step in (-1, 0, 1)])))
    gap = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double")), F.lit(0.0), lambda total, x: total + x * x)
    pairs = left.join(right, ["log_id", *[f"_q{i}" for i in range(len(near))]]).where(F.col("a") < F.col("b")).where(gap * side * side <= eps * eps * (1 + 1e-9))
    pairs = written(pairs.select("log_id", "a", "b"), "cell-pairs")
    x = points.select("log_id", F.col("first").alias("a"), F.col("v").alias("_x"))
    y = points.select("log_id", F.col("first").alias("b"), F.col("v").alias("_y"))
    apart = F.sqrt(F.aggregate(F.zip_with("_x", "_y", lambda p, q: p - q), F.lit(0.0), lambda total, z: total + z * z))
    return pairs.join(x, ["log_id", "a"]).join(y, ["log_id", "b"]).where(apart <= eps * (1 + SLACK)).select("log_id", "a", "b").distinct()


def _side(eps: float, size: int) -> float:
    """The width of a cell: any two points of a cell are less than eps apart."""
    return eps / math.sqrt(size) * (1 - 1e-9)


def _wide(eps: float, size: int) -> int:
    """So many cells are at least eps."""
    return math.ceil(eps / _side(eps, size))


def cluster_windows(means: DataFrame, eps: float = 1.2) -> DataFrame:
    """Windows (log_id, window_start, mean) with `cluster`: those connected by distances of at most eps (to 12 digits) between means that are standardised within
    their log; -1 for loners and for means with a null or NaN. Clusters are numbered within a log by their first window.

    This is density clustering with two points as the least. Equal means are one point; points of one cell are connected without being compared, so
    dense places cost no pairs; cells are connected through joins of neighbouring cells, and no log is one task. All means have
    the same number of dimensions; windows are distinct, and log_id is not null. Many cells within eps of each other are compared in pairs: in many
    dimensions this is quadratic in the windows of a neighbourhood."""
    whole = F.coalesce(F.forall("mean", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    means = written(means.select("log_id", "window_start", "mean", whole.alias("_whole")), "means")
    scaled = written(standardized(means.where("_whole"), "mean", ["log_id"]).select("log_id", "window_start", F.col("scaled").alias("v")), "scaled")
    size = scaled.agg(F.max(F.size("v"))).first()[0] or 0
    cell = F.transform("v", lambda x: F.floor(x / _side(eps, max(1, size))))
    points = scaled.groupBy("log_id", "v").agg(F.min("window_start").alias("id"), F.count("*").alias("n")).withColumn("cell", cell)
    firsts = points.groupBy("log_id", "cell").agg(F.min("id").alias("first"))
    points = written(points.join(firsts, ["log_id", "cell"]), "points")
    edges = written(cell_edges(points, eps, size), "edges") if size else points.select("log_id", F.col("first").alias("a"), F.col("first").alias("b")).limit(0)
    labels = component_labels(edges, ["log_id"]).withColumnRenamed("id", "first")
    points = points.join(labels, ["log_id", "first"], "left").withColumn("label", F.coalesce("label", "first"))
    groups = points.groupBy("log_id", "label").agg(F.sum("n").alias("_n")).where("_n > 1").drop("_n")
    groups = numbered(groups, ["log_id"], ["label"], "cluster")
    named = points.join(groups, ["log_id", "label"]).select("log_id", "v", F.col("cluster").cast("int").alias("cluster"))
    out = scaled.join(named, ["log_id", "v"], "left").select("log_id", "window_start", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return out.unionByName(means.where("NOT _whole").select("log_id", "window_start", F.lit(-1).alias("cluster")))
