"""Micro-tasks of a log and their frequent itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.functions.scalars import clean_label
from rutine.operators.sequence import in_log

# Words and column names that must be just these for results to agree.

#: Words that complete a task.
COMPLETE = ("submit", "save", "ok", "confirm", "apply", "bernehmen")
#: Columns that may hold the case and the time of an event, in the order in which they are looked for.
CASES = ("idx", "CaseID", "case:concept:name", "caseID", "timeStamp")
TIMES = ("timeStamp", "timestamp", "time:timestamp")
#: Columns that make up the class of an event, name the object that it touches, and hold its values.
CONTEXT = (
    "concept:name", "category", "application", "concept:name", "tag_category", "tag_type", "tag_title",
    "eventType", "target.name", "targetApp", "target.workbookName", "target.sheetName", "target.innerText", "target.tagName",
)
SEMANTIC = ("target.innerText", "target.name", "tag_type", "tag_value", "tag_attributes")
VALUES = ("target.innerText", "url", "target.value", "content")


def resolve(columns: list[str], candidates: tuple[str, ...], what: str) -> str:
    """The first candidate that is there."""
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"no column for {what}: {', '.join(candidates)}")


def present(columns: list[str], candidates: tuple[str, ...], what: str) -> list[str]:
    """The candidates that are there, each once."""
    found = [c for c in dict.fromkeys(candidates) if c in columns]
    if not found:
        raise ValueError(f"no column for {what}: {', '.join(candidates)}")
    return found


def boundaries(log: DataFrame, semantic: list[str], complete: tuple[str, ...] = COMPLETE) -> DataFrame:
    """log with is_boundary: some semantic label is a completing word, or two words of which the second is one."""
    flag = F.lit(False)
    for c in semantic:
        words = F.split(clean_label(F.col(c).cast("string")), " ")
        hit = F.get(words, F.size(words) - 1).isin(*complete) & (F.size(words) <= 2)
        flag = flag | F.coalesce(hit, F.lit(False))
    return log.withColumn("is_boundary", flag)


def micro_tasks(log: DataFrame, item: str, case: str = "case_id") -> DataFrame:
    """Segments between boundaries, each from a boundary row on: (log_id, segment, start_index, end_index, case_id, items).

    items are the distinct classes in it, in order. Rows before the first boundary are segment 0."""
    rows = log.withColumn("segment", F.sum(F.col("is_boundary").cast("int")).over(in_log().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("log_id", "segment").agg(
        F.min("event_index").alias("start_index"), F.max("event_index").alias("end_index"), F.min_by(case, "event_index").alias("case_id"),
        F.sort_array(F.collect_set(item)).alias("items"),
    )


def feature_vectors(tasks: DataFrame, vocabulary: DataFrame, width: int = 120) -> DataFrame:
    """tasks with `vector`, their items one-hot over a log's vocabulary (log_id, item, place), padded with zeros to width."""
    words = vocabulary.groupBy("log_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("_words"))
    hot = F.transform("_words", lambda w: F.array_contains("items", w).cast("int"))
    pad = F.array_repeat(F.lit(0), F.greatest(F.lit(width) - F.size("_words"), F.lit(0)))
    return tasks.join(words, "log_id").withColumn("vector", F.concat(hot, pad)).drop("_words")


def vocabulary(log: DataFrame, item: str) -> DataFrame:
    """A log's classes by first appearance: (log_id, item, place)."""
    first = log.where(F.col(item).isNotNull()).groupBy("log_id", F.col(item).alias("item")).agg(F.min("event_index").alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("log_id").orderBy("_first")) - 1).drop("_first")


def vector_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("items").agg(F.count("*").alias("count"))


def tasks_per_case(tasks: DataFrame, least: int = 2) -> DataFrame:
    """(log_id, case_id, tasks): the distinct tasks of cases with at least `least` of them, as comma-joined items."""
    rows = tasks.where("case_id IS NOT NULL").withColumn("_task", F.array_join("items", ","))
    return rows.groupBy("log_id", "case_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("_task")).alias("tasks")).where(F.col("n") >= least).drop("n")


def frequent_itemsets(baskets: DataFrame, items: str = "tasks", min_support: float = 0.1, algorithm: str = "fpgrowth", most: int | None = None) -> DataFrame:
    """(items, freq, support) of itemsets in at least min_support of all baskets, of at most `most` items.

    'fpgrowth' grows patterns by the distributed FP-growth of Spark's library; 'apriori' counts candidates level by level, each made of two
    sets of the level before whose subsets are all frequent. Both give the same sets; a driver-side row is a frequent set, never a basket."""
    from pyspark.ml.fpm import FPGrowth

    if algorithm not in ("fpgrowth", "apriori"):
        raise RuntimeError(f"unknown algorithm {algorithm}")
    n = baskets.count()
    if algorithm == "apriori":
        return _apriori(baskets.select(F.array_distinct(items).alias("basket")), n, min_support, most)
    found = FPGrowth(itemsCol=items, minSupport=min_support).fit(baskets.withColumn(items, F.array_distinct(items))).freqItemsets
    found = found.withColumn("items", F.sort_array("items")).withColumn("support", F.col("freq") / F.lit(max(1, n)))
    return found.where(F.size("items") <= most) if most else found


def _apriori(baskets: DataFrame, n: int, min_support: float, most: int | None) -> DataFrame:
    spark, size = baskets.sparkSession, 1
    least = min_support * n
    counts = baskets.select(F.explode("basket").alias("item")).where("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= least).collect()
    level = sorted((r.item,) for r in counts)
    out = [([r.item], r.freq) for r in counts]
    while level and (most is None or size < most):
        known, size = set(level), size + 1
        wanted = [a + b[-1:] for i, a in enumerate(level) for b in level[i + 1 :] if a[:-1] == b[:-1]]
        wanted = [c for c in wanted if all(c[:i] + c[i + 1 :] in known for i in range(size))]
        if not wanted:
            break
        table = spark.createDataFrame([(list(c),) for c in wanted], f"items {baskets.schema['basket'].dataType.simpleString()}")
        within = F.size(F.array_intersect("basket", "items")) == size
        level = []
        for r in baskets.join(table, within).groupBy("items").agg(F.count("*").alias("freq")).where(F.col("freq") >= least).collect():
            level.append(tuple(r["items"]))
            out.append((r["items"], r.freq))
        level.sort()
    kind = baskets.schema["basket"].dataType.simpleString()
    return spark.createDataFrame(out, f"items {kind}, freq long").withColumn("support", F.col("freq") / F.lit(max(1, n)))
