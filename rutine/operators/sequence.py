"""Operators over ordered logs: rows (log_id, event_index, ...), one log being the rows of a log_id in order of event_index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from rutine.functions.scalars import num_to_letters, row_key
from rutine.operators.scans import BLOCK, beside, numbered, running


def in_log(*more: str) -> WindowSpec:
    return Window.partitionBy("log_id", *more).orderBy("event_index")


def reindex(log: DataFrame, name: str = "event_index", long: bool = False) -> DataFrame:
    """Positions 0, 1, ... of what is left of each log.

    Here and below, `long` deals the rows of each log in blocks, so that no log is one task. It gives the same, and costs some jobs more."""
    if long:
        return numbered(log, ["log_id"], ["event_index"], "_at").withColumn(name, F.col("_at")).drop("_at")
    return log.withColumn(name, F.row_number().over(in_log()) - F.lit(1).cast("long"))


def symbolize(log: DataFrame, columns: list[str], long: bool = False) -> DataFrame:
    """log with symbol_code, the rank of its key among the log's sorted distinct keys, symbol, that code in letters, and `count`,
    how often the key occurs with a value in the first column. Ranks are taken over distinct keys, which the log is joined with."""
    keyed = log.withColumn("_key", row_key(*columns))
    keys = keyed.groupBy("log_id", "_key").agg(F.count(columns[0]).alias("count"))
    if long:
        ranks = numbered(keys, ["log_id"], ["_key"], "symbol_code").withColumn("symbol_code", F.col("symbol_code").cast("int"))
    else:
        ranks = keys.withColumn("symbol_code", F.row_number().over(Window.partitionBy("log_id").orderBy("_key")) - 1)
    ranks = ranks.withColumn("symbol", num_to_letters(F.col("symbol_code")))
    return keyed.join(ranks, ["log_id", "_key"]).drop("_key")


def factorize(log: DataFrame, columns: list[str], name: str = "code") -> DataFrame:
    """Codes of keys in the order of their first appearance in the log."""
    keyed = log.withColumn("_key", row_key(*columns))
    first = keyed.groupBy("log_id", "_key").agg(F.min("event_index").alias("_first"))
    codes = first.withColumn(name, F.row_number().over(Window.partitionBy("log_id").orderBy("_first")) - 1)
    return keyed.join(codes.drop("_first"), ["log_id", "_key"]).drop("_key")


def hierarchy_ids(log: DataFrame, columns: list[str], name: str = "hierarchy_id") -> DataFrame:
    """Codes of distinct combinations in the order of the columns, nulls last; nulls match nulls."""
    order = [F.asc_nulls_last(c) for c in columns]
    combos = log.select("log_id", *columns).distinct()
    combos = combos.withColumn(name, F.row_number().over(Window.partitionBy("log_id").orderBy(*order)) - 1)
    other = combos.select(F.col("log_id").alias("_log"), *[F.col(c).alias(f"_{c}") for c in columns], name)
    on = [log["log_id"] == other["_log"], *[log[c].eqNullSafe(other[f"_{c}"]) for c in columns]]
    return log.join(other, on, "left").select(*log.columns, name)


def dictionary(df: DataFrame, columns: list[str], order: str, name: str = "id") -> DataFrame:
    """Distinct combinations of columns numbered from 0 by their first appearance in the order: (columns, name). Numbers are given part by part, not by one task."""
    first = df.groupBy(*columns).agg(F.min(order).alias("_first"))
    return numbered(first, [], ["_first", *columns], name).drop("_first")


def lookup(df: DataFrame, known: DataFrame, columns: list[str], name: str = "id", absent: int | None = -1) -> DataFrame:
    """df with the number that a dictionary gives to its columns, and `absent` for what is not in there. Nulls match nulls."""
    other = known.select(*[F.col(c).alias(f"_{c}") for c in columns], F.col(name).alias("_id"))
    on = [df[c].eqNullSafe(other[f"_{c}"]) for c in columns]
    return df.join(other, on, "left").select(*df.columns, F.coalesce("_id", F.lit(absent).cast("long")).alias(name))


def bigrams(log: DataFrame, column: str = "symbol", long: bool = False) -> DataFrame:
    """Every adjacent pair: (log_id, event_index, left, right). Overlapping pairs all count."""
    rows, order, own = log.select("log_id", "event_index", column), in_log(), F.lit(True)
    if long:
        rows, order = beside(numbered(rows, ["log_id"], ["event_index"], "_at"), ["log_id"], "_at", 0, 1)
        own = F.col("_own")
    pairs = rows.select("log_id", "event_index", F.col(column).alias("left"), F.lead(column).over(order).alias("right"), F.lead("event_index").over(order).alias("_next"), own.alias("_own"))
    return pairs.where("_next IS NOT NULL AND _own").drop("_next", "_own")


def bigram_table(log: DataFrame, column: str = "symbol", positions: bool = True, long: bool = False) -> DataFrame:
    """Counts of adjacent pairs, with their first position and, on demand, all of them; most frequent first, then earliest."""
    what = [F.count("*").alias("count"), F.min("event_index").alias("first_pos")]
    if positions:
        what.append(F.sort_array(F.collect_list("event_index")).alias("positions"))
    return bigrams(log, column, long).groupBy("log_id", "left", "right").agg(*what)


def islands(rows: DataFrame, merge_gap: int | None = None, long: bool = False) -> DataFrame:
    """Runs of consecutive event_index: (log_id, start_index, end_index, length), length counting the rows that are there.

    With merge_gap, runs whose distance from end to start is at most that become one."""
    if long:  # a run starts where the row before is too far; runs are numbered by a running count
        at, far = F.col("event_index"), max(1, merge_gap or 1)
        told = running(rows.select("log_id", "event_index"), ["log_id"], "event_index", {"_before": ("last", at)}, itself=False)
        told = running(told.withColumn("_new", F.when(at - F.col("_before") <= far, 0).otherwise(1)), ["log_id"], "event_index", {"_run": ("sum", F.col("_new"))})
        return told.groupBy("log_id", "_run").agg(F.min("event_index").alias("start_index"), F.max("event_index").alias("end_index"), F.count("*").alias("length")).drop("_run")
    run = F.col("event_index") - F.row_number().over(in_log())
    out = rows.select("log_id", "event_index").withColumn("_run", run).groupBy("log_id", "_run").agg(F.min("event_index").alias("start_index"), F.max("event_index").alias("end_index"), F.count("*").alias("length")).drop("_run")
    if merge_gap is None:
        return out
    order = Window.partitionBy("log_id").orderBy("start_index")
    far = F.col("start_index") - F.lag("end_index").over(order) > merge_gap
    out = out.withColumn("_run", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(order))
    return out.groupBy("log_id", "_run").agg(F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.sum("length").alias("length")).drop("_run")


def rolling_clipped_mean(value: Column, n: int, most: float = 3600.0, order: WindowSpec | None = None) -> Column:
    """Mean of the last n values, each clipped to [0, most]; null until there are n rows."""
    rows = (order or in_log()).rowsBetween(-(n - 1), 0)
    clipped = F.least(F.greatest(value, F.lit(0.0)), F.lit(float(most)))
    return F.when(F.count(F.lit(1)).over(rows) == n, F.avg(clipped).over(rows))


def time_gaps(log: DataFrame, ts: str = "ts", gap: float = 3600.0, n: int = 100, long: bool = False) -> DataFrame:
    """log with gap_seconds to the next row, modulo a day, and two flags: more than `gap` in all; more than the rolling mean.

    The last row has a gap of 0. Where the rolling mean is not there yet the flag is false."""
    rows, order, columns = log, in_log(), log.columns
    if long:
        rows, order = beside(numbered(log, ["log_id"], ["event_index"], "_at"), ["log_id"], "_at", n, 1, max(n, BLOCK))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    micros = F.lead(at).over(order) - at
    out = rows.withColumn("_total", F.coalesce(micros / 1e6, F.lit(0.0)))
    out = out.withColumn("gap_static", F.col("_total") > gap).withColumn("gap_seconds", F.pmod(F.floor("_total"), F.lit(86400)))
    out = out.withColumn("gap_mean", rolling_clipped_mean(F.col("gap_seconds").cast("double"), n, order=order))
    out = out.withColumn("gap_dynamic", F.coalesce(F.col("gap_mean") < F.col("gap_seconds"), F.lit(False)))
    return (out.where("_own") if long else out).select(*columns, "gap_static", "gap_seconds", "gap_mean", "gap_dynamic")


def break_window(log: DataFrame, ts: str = "ts", threshold: float = 950.0, percentile: float = 0.75) -> DataFrame:
    """A window size for each log from its breaks: (log_id, quantile, breaks, window_size).

    Of the gaps of at most threshold seconds, the quantile; the breaks are the places, among those gaps, of gaps equal to it;
    window_size is the mean of the steps between breaks less one, null with fewer than two."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (at - F.lag(at).over(in_log())) / 1e6
    gaps = log.withColumn("_gap", gap).where(F.col("_gap") <= threshold)
    gaps = gaps.select("log_id", "event_index", "_gap", (F.row_number().over(in_log()) - 1).alias("_place"))
    q = gaps.groupBy("log_id").agg(F.expr(f"percentile(_gap, {percentile})").alias("quantile"))
    at = gaps.join(q, "log_id").where("_gap = quantile")
    at = at.withColumn("_step", F.col("_place") - F.lag("_place").over(Window.partitionBy("log_id").orderBy("_place")) - 1)
    found = at.groupBy("log_id").agg(F.count("*").alias("breaks"), F.avg("_step").alias("window_size"))
    return q.join(found, "log_id", "left").select("log_id", "quantile", F.coalesce("breaks", F.lit(0)).alias("breaks"), "window_size")


def nearest_boundaries(log: DataFrame, boundary: str = "is_boundary") -> DataFrame:
    """log with next_boundary and previous_boundary. A row that is itself a boundary has no next one; the previous one is always earlier."""
    here = F.when(F.col(boundary), F.col("event_index"))
    ahead = F.first(here, ignorenulls=True).over(in_log().rowsBetween(0, Window.unboundedFollowing))
    back = F.last(here, ignorenulls=True).over(in_log().rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("next_boundary", F.when(~F.coalesce(F.col(boundary), F.lit(False)), ahead)).withColumn("previous_boundary", back)


def cooccurrence(log: DataFrame, column: str, n: int = 1) -> DataFrame:
    """(log_id, a, b, count) of values within n places of each other. The log's last row is never a centre."""
    last = F.max("event_index").over(Window.partitionBy("log_id"))
    rows = log.select("log_id", "event_index", F.col(column).alias("a"), (F.col("event_index") == last).alias("_last"))
    sides = F.array(*[F.lead("a", i).over(in_log()) for i in range(1, n + 1)], *[F.lag("a", i).over(in_log()) for i in range(1, n + 1)])
    each = rows.withColumn("_sides", sides).withColumn("b", F.explode("_sides")).where("NOT _last AND b IS NOT NULL AND a IS NOT NULL")
    return each.groupBy("log_id", "a", "b").agg(F.count("*").alias("count"))


def running_total(value: Column) -> Column:
    return F.sum(value).over(in_log().rowsBetween(Window.unboundedPreceding, 0))


def extract_windows(log: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """Rows of fixed windows from starts (log_id, start_index): with window_start and case_number, the number of the kept window as text.

    Windows that start outside of the log are skipped, those that reach over its end are cut, and windows may overlap."""
    ends = log.groupBy("log_id").agg(F.max("event_index").alias("_last"))
    kept = starts.select("log_id", "start_index").distinct().join(ends, "log_id").where("start_index >= 0 AND start_index <= _last")
    kept = kept.withColumn("case_number", (F.row_number().over(Window.partitionBy("log_id").orderBy("start_index")) - 1).cast("string"))
    rows = kept.withColumn("event_index", F.explode(F.sequence("start_index", F.least(F.col("start_index") + size - 1, F.col("_last")))))
    return rows.select("log_id", F.col("start_index").alias("window_start"), "case_number", "event_index").join(log, ["log_id", "event_index"])


def window_means(vectors: DataFrame, starts: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    """(log_id, window_start, mean) of whole windows of array vectors; incomplete ones are skipped."""
    rows = extract_windows(vectors, starts, size).select("log_id", "window_start", F.posexplode(vector).alias("_at", "_x"))
    means = rows.groupBy("log_id", "window_start", "_at").agg(F.avg("_x").alias("_mean"), F.count("*").alias("_n")).where(F.col("_n") == size)
    return means.groupBy("log_id", "window_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_mean"))), lambda x: x["_mean"]).alias("mean"))


def case_list(log: DataFrame, column: str = "case_id") -> DataFrame:
    """(log_id, case, first index, number of rows); rows without a case are left out."""
    return log.where(F.col(column).isNotNull()).groupBy("log_id", column).agg(F.min("event_index").alias("start_index"), F.count("*").alias("length"))


def identifier_positions(log: DataFrame, column: str) -> DataFrame:
    return log.where(F.col(column).isNotNull()).groupBy("log_id", column).agg(F.sort_array(F.collect_list("event_index")).alias("positions"))


def within_ranges(log: DataFrame, ranges: DataFrame, long: bool = False) -> DataFrame:
    """Rows of the union of half-open ranges (log_id, lo, hi), with original_index, reindexed from 0. Ranges are merged first."""
    spans = ranges.where("hi > lo")
    if long:
        spans = numbered(spans.select("log_id", "lo", "hi"), ["log_id"], ["lo", "hi"], "_at")
        told = running(spans, ["log_id"], "_at", {"_reach": ("max", F.col("hi"))}, itself=False)
        told = running(told.withColumn("_new", F.coalesce(F.col("lo") > F.col("_reach"), F.lit(True)).cast("long")), ["log_id"], "_at", {"_run": ("sum", F.col("_new"))})
    else:
        order = Window.partitionBy("log_id").orderBy("lo", "hi")
        reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
        told = spans.withColumn("_new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    merged = told.groupBy("log_id", "_run").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    at = merged.select("log_id", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("event_index"))
    kept = log.join(at, ["log_id", "event_index"])
    return reindex(kept.withColumn("original_index", F.col("event_index")), long=long)


def union_logs(*logs: DataFrame) -> DataFrame:
    """Logs one after the other under one log_id each; columns are united, positions made anew."""
    out = None
    for i, log in enumerate(logs):
        part = log.withColumn("_part", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    order = Window.partitionBy("log_id").orderBy("_part", "event_index")
    return out.withColumn("event_index", F.row_number().over(order) - F.lit(1).cast("long")).drop("_part")
