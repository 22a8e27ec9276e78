"""Sampling and synthetic logs. Random choices are seeded hashes of positions, so reruns and retried tasks agree."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.operators.sequence import in_log, reindex


def uniform(seed: int, *columns: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / 2.0**53


def geometric(u: Column, p: float, most: int) -> Column:
    """A length from 1 to most: geometric, its tail folded back evenly."""
    n = F.floor(F.log(1 - u) / math.log(1 - p))
    return F.pmod(n, F.lit(most)) + 1


def random_n(low: int, high: int, seed: int) -> int:
    return random.Random(seed).randint(low, high)


def consecutive_rows(log: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n consecutive rows of each log from a random start; all of a shorter one."""
    size = F.max("event_index").over(Window.partitionBy("log_id")) + 1
    start = F.floor(uniform(seed, "log_id") * F.greatest(size - n + 1, F.lit(1)))
    return log.withColumn("_start", start).where((F.col("event_index") >= F.col("_start")) & (F.col("event_index") < F.col("_start") + n)).drop("_start")


def random_log(source: DataFrame, actions: int, most: int = 10, p: float = 0.35, seed: int = 42) -> DataFrame:
    """A log of `actions` rows for each log of source: blocks of consecutive rows, of geometric length, one after the other.

    With most = 1 every row is drawn by itself. Blocks are a seed table that is exploded and joined, never appended."""
    sizes = source.groupBy("log_id").agg((F.max("event_index") + 1).alias("_n"))
    blocks = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(actions - 1))))
    blocks = blocks.withColumn("_start", F.floor(uniform(seed, "log_id", "block") * F.col("_n"))).withColumn("_len", geometric(uniform(seed + 1, "log_id", "block"), p, most) if most > 1 else F.lit(1).cast("long"))
    run = Window.partitionBy("log_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_past", F.coalesce(F.sum("_len").over(run), F.lit(0))).where(F.col("_past") < actions)
    rows = blocks.withColumn("_k", F.explode(F.expr("sequence(CAST(0 AS BIGINT), _len - 1)")))
    rows = rows.select("log_id", (F.col("_past") + F.col("_k")).alias("_at"), F.pmod(F.col("_start") + F.col("_k"), F.col("_n")).alias("event_index")).where(F.col("_at") < actions)
    return rows.join(source, ["log_id", "event_index"]).withColumn("event_index", F.col("_at")).drop("_at")


def shuffled_log(source: DataFrame, actions: int, seed: int = 42) -> DataFrame:
    """Rows in random order, all of them before any comes again, up to `actions`."""
    sizes = source.groupBy("log_id").agg((F.max("event_index") + 1).alias("_n"))
    rows = source.join(sizes, "log_id").withColumn("_cycle", F.explode(F.expr(f"sequence(CAST(0 AS BIGINT), CAST(ceil({actions} / _n) AS BIGINT) - 1)")))
    order = Window.partitionBy("log_id").orderBy("_cycle", uniform(seed, "log_id", "_cycle", "event_index"), "event_index")
    rows = rows.withColumn("event_index", F.row_number().over(order) - F.lit(1).cast("long"))
    return rows.where(F.col("event_index") < actions).drop("_n", "_cycle")


def random_values(df: DataFrame, column: str, m: int, least: int = 1, seed: int = 42) -> DataFrame:
    """(value, count) of m rows drawn among values with at least `least` rows: frequent values are likelier, and may come twice."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).where(F.col("count") >= least)
    rows = n.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    return rows.orderBy(uniform(seed, F.col("value").cast("string"), F.col("_row")), "value").limit(m).drop("_row")


def _moved(log: DataFrame, share: Column, seed: int) -> DataFrame:
    """Rows of a random share get each other's places, in a random order."""
    n = F.max("event_index").over(Window.partitionBy("log_id")) + 1
    pick = F.row_number().over(Window.partitionBy("log_id").orderBy(uniform(seed, "log_id", "event_index"), "event_index"))
    rows = log.withColumn("_out", pick <= F.floor(n * share))
    place = F.row_number().over(Window.partitionBy("log_id", "_out").orderBy("event_index"))
    turn = F.row_number().over(Window.partitionBy("log_id", "_out").orderBy(uniform(seed + 1, "log_id", "event_index"), "event_index"))
    rows = rows.withColumn("_place", place).withColumn("_turn", turn)
    slots = rows.where("_out").select("log_id", F.col("_place").alias("_turn"), F.col("event_index").alias("_slot"), F.lit(True).alias("_out"))
    out = rows.join(slots, ["log_id", "_turn", "_out"], "left").withColumn("event_index", F.coalesce("_slot", "event_index"))
    return out.select(*log.columns)


def shuffle_share(log: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """floor(n * share) rows of each log trade places; the rest keep theirs."""
    return _moved(log, F.lit(float(share)), seed)


def reorder(log: DataFrame, percent: float = 10, seed: int = 42) -> DataFrame:
    return _moved(log, F.lit(percent / 100), seed)


def remove_percent(log: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """Each log without floor(n * percent / 100) random rows, reindexed."""
    n = F.max("event_index").over(Window.partitionBy("log_id")) + 1
    pick = F.row_number().over(Window.partitionBy("log_id").orderBy(uniform(seed, "log_id", "event_index"), "event_index"))
    return reindex(log.withColumn("_gone", pick <= F.floor(n * percent / 100)).where("NOT _gone").drop("_gone"))


def insert_rows(log: DataFrame, rows: DataFrame) -> DataFrame:
    """log with rows (log_id, before_index, seq, ...) put in front of the event at before_index; `inserted` tells them. Nothing is spliced: the order is sorted by."""
    a = log.withColumn("_at", F.col("event_index").cast("long")).withColumn("_kind", F.lit(1)).withColumn("_seq", F.lit(0).cast("long"))
    b = rows.withColumnRenamed("before_index", "_at").withColumn("_at", F.col("_at").cast("long")).withColumn("_kind", F.lit(0)).withColumn("_seq", F.col("seq").cast("long")).drop("seq")
    both = a.drop("event_index").unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy("log_id").orderBy("_at", "_kind", "_seq")
    return both.withColumn("event_index", F.row_number().over(order) - F.lit(1).cast("long")).withColumn("inserted", F.col("_kind") == 0).drop("_at", "_kind", "_seq")


def plant_motifs(noise: DataFrame, motifs: DataFrame, occurrences: int, shuffle: float = 0.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(logs, truth): each motif (motif_number, seq, ...) put into every log of noise `occurrences` times at random places, without overlap.

    A share of each occurrence's rows trades places. truth is (log_id, motif_number, occurrence, start_index, end_index)."""
    sizes = noise.groupBy("log_id").agg((F.max("event_index") + 1).alias("_n"))
    each = sizes.join(F.broadcast(motifs.select("motif_number").distinct()), how="cross").withColumn("occurrence", F.explode(F.sequence(F.lit(0), F.lit(occurrences - 1))))  # logs by motif numbers
    at = F.floor(uniform(seed, "log_id", "motif_number", "occurrence") * (F.col("_n") + 1))
    each = each.withColumn("before_index", at).drop("_n")
    rows = each.join(motifs.withColumnRenamed("seq", "event_index"), "motif_number").withColumnRenamed("log_id", "_log")
    rows = rows.withColumn("log_id", F.concat_ws("#", "_log", "motif_number", "occurrence"))
    rows = _moved(rows.withColumn("_block", F.struct("motif_number", "occurrence")), F.lit(float(shuffle)), seed + 7)
    rows = rows.withColumn("log_id", F.col("_log")).drop("_log")
    # blocks at one place stand one after the other
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("log_id", "before_index").orderBy("_block", "event_index"))).drop("event_index", "_block")
    out = insert_rows(noise, rows)
    truth = out.where("inserted").groupBy("log_id", "motif_number", "occurrence").agg(F.min("event_index").alias("start_index"), F.max("event_index").alias("end_index"))
    return out, truth


def catalogue(truth: DataFrame, logs: DataFrame) -> DataFrame:
    """(log_id, log_length, motifs, motif_share) of planted logs."""
    n = logs.groupBy("log_id").agg(F.count("*").alias("log_length"), F.sum(F.col("inserted").cast("long")).alias("_in"))
    m = truth.groupBy("log_id").agg(F.countDistinct("motif_number").alias("motifs"), F.count("*").alias("occurrences"))
    return n.join(m, "log_id", "left").select("log_id", "log_length", "motifs", "occurrences", (100 * F.col("_in") / F.col("log_length")).alias("motif_percent"))


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """A row for each combination of parameter values."""
    out = None
    for name, some in values.items():
        kind = "string" if any(isinstance(x, str) for x in some) else "double" if any(isinstance(x, float) for x in some) else "long"
        part = spark.createDataFrame([(x,) for x in some], f"{name} {kind}")
        out = part if out is None else out.join(F.broadcast(part), how="cross")  # lists of the caller
    return out


def noise_rows(spark: SparkSession, values: dict[str, list], n: int, overrides: dict[str, dict[str, list]] | None = None, key: str = "app", seed: int = 42) -> DataFrame:
    """n rows (event_index, ...), each column drawn by itself; overrides {key value: {column: values}} hold for rows of that key."""
    pick = lambda name, some: F.element_at(F.array(*map(F.lit, some)), (F.floor(uniform(seed, F.lit(name), "event_index") * len(some)) + 1).cast("int"))
    out = spark.range(n).withColumnRenamed("id", "event_index")
    out = out.withColumns({c: pick(c, some) for c, some in values.items()})
    for app, columns in (overrides or {}).items():
        out = out.withColumns({c: F.when(F.col(key) == app, pick(f"{app}.{c}", some)).otherwise(F.col(c) if c in out.columns else F.lit(None)) for c, some in columns.items()})
    return out


def truth_by_markers(log: DataFrame, end_marker: Column, long_from: int = 40) -> DataFrame:
    """(log_id, case_number, start_index, length, motif) of the stretches that end at marker rows; motif is RT for long ones, else SR."""
    rows = log.withColumn("_end", F.coalesce(end_marker, F.lit(False)).cast("int"))
    rows = rows.withColumn("case_number", F.coalesce(F.sum("_end").over(in_log().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.groupBy("log_id", "case_number").agg(F.min("event_index").alias("start_index"), F.count("*").alias("length"), F.max("_end").alias("_done")).where("_done = 1").drop("_done")
    return out.withColumn("motif", F.when(F.col("length") > long_from, "RT").otherwise("SR"))


def interleave_noise(log: DataFrame, noise: DataFrame, truth: DataFrame, rows: int = 50) -> DataFrame:
    """log with `rows` rows of noise (event_index, ...) after each stretch of truth, taken in order and over again."""
    order = Window.partitionBy("log_id").orderBy("start_index")
    spots = truth.withColumn("_k", F.row_number().over(order) - 1).select("log_id", (F.col("start_index") + F.col("length")).alias("before_index"), "_k")
    total = noise.count()
    spots = spots.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("_pick", F.pmod(F.col("_k") * rows + F.col("seq"), F.lit(max(1, total))))
    return insert_rows(log, spots.join(noise.withColumnRenamed("event_index", "_pick"), "_pick").drop("_pick", "_k"))


def label_tasks(log: DataFrame, rules: list[tuple[Column, str]], default: str = "", name: str = "task") -> DataFrame:
    """log with a label: that of the last rule that holds."""
    out = F.lit(default)
    for condition, label in rules:
        out = F.when(F.coalesce(condition, F.lit(False)), label).otherwise(out)
    return log.withColumn(name, out)
