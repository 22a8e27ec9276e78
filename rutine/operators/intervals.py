"""Joins of intervals and bands. Intervals are inclusive: rows (log_id, <id>, start, end)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.operators.components import component_labels, joining_edges
from rutine.operators.scans import numbered, running
from rutine.plans.shipping import ship
from rutine.plans.tables import written

#: Width of the bins by which a range join is an equi-join.
BIN = 256


def overlap(s1: str, e1: str, s2: str, e2: str) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def overlapping(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of a (log_id, a_id, a_start, a_end) and b (log_id, b_id, b_start, b_end) that share an index, with their overlap.

    Intervals are dealt into bins and joined by (log, bin); a pair counts in the first bin that both have."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    x = a.where("a_start <= a_end").withColumn("_bin", bins("a_start", "a_end"))
    y = b.where("b_start <= b_end").withColumn("_bin", bins("b_start", "b_end"))
    pairs = x.join(y, ["log_id", "_bin"]).where("a_start <= b_end AND b_start <= a_end")
    pairs = pairs.where(F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / width)).drop("_bin")
    return pairs.withColumn("overlap", overlap("a_start", "a_end", "b_start", "b_end"))


def overlap_table(motifs: DataFrame, truth: DataFrame) -> DataFrame:
    """All pairs of motifs (log_id, motif_id, motif_start, motif_end) and truth (log_id, gt_id, gt_start, gt_end) of a log, with lengths, overlap,
    its share of both, and is_best_match, which marks a truth's first largest overlap. Pairs without overlap are there too."""
    t = motifs.join(truth, "log_id").withColumn("motif_length", F.expr("motif_end - motif_start + 1")).withColumn("gt_length", F.expr("gt_end - gt_start + 1"))
    t = t.withColumn("overlap", overlap("motif_start", "motif_end", "gt_start", "gt_end"))
    t = t.withColumn("overlap_motif_ratio", F.col("overlap") / F.col("motif_length")).withColumn("overlap_gt_ratio", F.col("overlap") / F.col("gt_length"))
    first = F.row_number().over(Window.partitionBy("log_id", "gt_id").orderBy(F.desc("overlap"), "motif_id"))
    return t.withColumn("is_best_match", (first == 1) & (F.col("overlap") > 0))


def flag_overlaps(a: DataFrame, b: DataFrame, name: str = "grammar_match") -> DataFrame:
    """a with a flag: it shares an index with some interval of b."""
    hits = overlapping(a, b).select("log_id", "a_id").distinct().withColumn(name, F.lit(True))
    return a.join(hits, ["log_id", "a_id"], "left").fillna(False, [name])


def analyze_overlaps(motifs: DataFrame, core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both ways: motifs (a_*) with the cores they touch, {core: overlap}, the cores they contain and a status; cores (b_*) with
    the motifs that touch them, those that contain them, and a status."""
    pairs = overlapping(motifs, core).withColumn("_inside", F.expr("b_start >= a_start AND b_end <= a_end"))
    by_motif = pairs.groupBy("log_id", "a_id").agg(
        F.sort_array(F.collect_list("b_id")).alias("touched"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("b_id", "overlap")))).alias("overlaps"),
        F.sort_array(F.collect_list(F.when(F.col("_inside"), F.col("b_id")))).alias("contained"),
    )
    by_core = pairs.groupBy("log_id", "b_id").agg(F.sort_array(F.collect_list("a_id")).alias("touching"), F.sort_array(F.collect_list(F.when(F.col("_inside"), F.col("a_id")))).alias("containers"))
    text = F.when(F.col("touched").isNull(), "No Overlap").when(F.size("contained") > 0, F.format_string("Contains %d Cores Full", F.size("contained")))
    m = motifs.join(by_motif, ["log_id", "a_id"], "left").withColumn("status", text.otherwise(F.format_string("Partial Overlap with %d Cores", F.size("touched"))))
    names = F.concat(F.lit("["), F.array_join(F.col("containers").cast("array<string>"), ", "), F.lit("]"))
    text = F.when(F.col("touching").isNull(), "Isolated").when(F.size("containers") > 0, F.concat(F.lit("Fully inside Motif "), names))
    c = core.join(by_core, ["log_id", "b_id"], "left").withColumn("is_contained", F.coalesce(F.size("containers") > 0, F.lit(False)))
    c = c.withColumn("status", text.otherwise(F.format_string("Partial overlap with %d motifs", F.size("touching"))))
    return m, c


def merge_overlaps(spans: DataFrame, first_columns: tuple[str, ...] = (), long: bool = False) -> DataFrame:
    """Intervals (log_id, id, start, end, flag) that share an index become one: members, an or of flags, and first_columns of the first.

    Intervals that only touch, one ending before the other starts, stay apart. `long` deals the intervals of each log in blocks."""
    if long:
        told = running(numbered(spans, ["log_id"], ["start", "end", "id"], "_at"), ["log_id"], "_at", {"_reach": ("max", F.col("end"))}, itself=False)
        runs = running(told.withColumn("_new", F.coalesce(F.col("start") > F.col("_reach"), F.lit(True)).cast("long")), ["log_id"], "_at", {"_run": ("sum", F.col("_new"))})
    else:
        order = Window.partitionBy("log_id").orderBy("start", "end", "id")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        runs = spans.withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    firsts = [F.min_by(c, F.struct("start", "end", "id")).alias(c) for c in first_columns]
    out = runs.groupBy("log_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("id")).alias("members"), F.max("flag").alias("flag"), *firsts)
    return out.withColumn("length", F.expr("end - start + 1")).drop("_run")


def band_first(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """For each number of a (pos, num) the first of b (pos, num) within n: (a_pos, a_num, b_num, accuracy), accuracy being the distance.

    Only distinct numbers meet, those of b with their first place, so rows that share a number are never multiplied with each other."""
    x = a.select(F.col("num").alias("a_num")).distinct().withColumn("_bin", F.explode(F.sequence(F.floor((F.col("a_num") - n) / (n + 1)), F.floor((F.col("a_num") + n) / (n + 1)))))
    y = b.groupBy(F.col("num").alias("b_num")).agg(F.min(F.struct("pos"))["pos"].alias("b_pos")).withColumn("_bin", F.floor(F.col("b_num") / (n + 1)))
    near = x.join(y, "_bin").where(F.abs(F.col("a_num") - F.col("b_num")) <= n).groupBy("a_num").agg(F.min(F.struct("b_pos", "b_num")).alias("_b"))
    rows = a.select(F.col("pos").alias("a_pos"), F.col("num").alias("a_num")).join(near, "a_num")
    best = rows.groupBy("a_pos").agg(F.min(F.struct("_b", "a_num")).alias("_m")).select("a_pos", "_m.a_num", F.col("_m._b.b_num").alias("b_num"))
    return best.withColumn("accuracy", F.abs(F.col("a_num") - F.col("b_num")))


def band_score(found: DataFrame, spots: DataFrame, window: int, tolerance: int | None = None) -> DataFrame:
    """For each found start (num) the nearest spot (num) within the tolerance, half a window unless given: (num, spot, accuracy from 1 down to 0)."""
    t = window // 2 if tolerance is None else tolerance
    pairs = found.select("num").distinct().withColumn("_bin", F.explode(F.sequence(F.floor((F.col("num") - t) / (t + 1)), F.floor((F.col("num") + t) / (t + 1)))))
    pairs = pairs.join(spots.select(F.col("num").alias("spot")).distinct().withColumn("_bin", F.floor(F.col("spot") / (t + 1))), "_bin").where(F.abs(F.col("num") - F.col("spot")) <= t)
    best = F.row_number().over(Window.partitionBy("num").orderBy(F.abs(F.col("num") - F.col("spot")), "spot"))
    accuracy = F.lit(1.0) if not t else 1 - F.abs(F.col("num") - F.col("spot")) / t
    return pairs.withColumn("_n", best).where("_n = 1").select("num", "spot", accuracy.alias("accuracy"))


def best_coverage(truth: DataFrame, starts: DataFrame, window: int, threshold: float = 0.5) -> DataFrame:
    """For each found window the truth that it covers best: (log_id, start, gt_id, coverage), half-open intervals; truth has (log_id, gt_id, gt_start, gt_end).

    Coverage is 1 where either contains the other, else the overlap's share of the window; ties go to the smaller gt_id."""
    a = starts.select("log_id", F.col("start").alias("a_id"), F.col("start").alias("a_start"), (F.col("start") + window - 1).alias("a_end"))
    b = truth.select("log_id", F.col("gt_id").alias("b_id"), F.col("gt_start").alias("b_start"), (F.col("gt_end") - 1).alias("b_end"))
    pairs = overlapping(a.distinct(), b)
    inside = F.expr("(b_start >= a_start AND b_end <= a_end) OR (a_start >= b_start AND a_end <= b_end)")
    pairs = pairs.withColumn("coverage", F.when(inside, 1.0).otherwise(F.col("overlap") / window))
    best = F.row_number().over(Window.partitionBy("log_id", "a_id").orderBy(F.desc("coverage"), "b_id"))
    return pairs.withColumn("_n", best).where((F.col("_n") == 1) & (F.col("coverage") >= threshold)).select("log_id", F.col("a_start").alias("start"), F.col("b_id").alias("gt_id"), "coverage")


#: Rounds of mutual best pairs before what is left of a log is matched one pair after the other.
ROUNDS = 12


def _one_by_one(pairs: DataFrame) -> DataFrame:
    """Greedy matches by a loop over the pairs of each log."""
    ship(pairs.sparkSession)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        motifs, truths, keep = set(), set(), []
        p = p.sort_values(["overlap", "motif_id", "gt_id"], ascending=[False, True, True])
        for i, m, g in zip(p.index, p["motif_id"], p["gt_id"], strict=True):
            if m not in motifs and g not in truths:
                motifs.add(m)
                truths.add(g)
                keep.append(i)
        return p.loc[keep]

    return pairs.groupBy("log_id").applyInPandas(run, pairs.schema)


def greedy_matches(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One-to-one matches of pairs (log_id, motif_id, gt_id, overlap): the largest overlap first, ties to smaller ids.

    A pair that comes first for its motif and for its truth is one that the greedy choice takes; it goes out with all other pairs of both, and so
    on. Pairs are dealt by motif and by truth, not by log. Rounds are few, but for long chains of ever smaller overlaps: what is
    left after `rounds` of them is taken one by one, log by log."""
    left, out = written(pairs.select("log_id", "motif_id", "gt_id", "overlap"), "pairs"), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        by_motif, by_truth = Window.partitionBy("log_id", "motif_id"), Window.partitionBy("log_id", "gt_id")
        # of the pairs of one motif the order is (overlap, truth), of one truth (overlap, motif)
        first = left.withColumn("_m", F.row_number().over(by_motif.orderBy(F.desc("overlap"), "gt_id"))).withColumn("_g", F.row_number().over(by_truth.orderBy(F.desc("overlap"), "motif_id")))
        first = first.withColumn("_won", (F.col("_m") == 1) & (F.col("_g") == 1))
        told = first.withColumn("_done", F.max("_won").over(by_truth)).withColumn("_done", F.col("_done") | F.max("_won").over(by_motif))
        told = written(told.where("_won OR NOT _done").drop("_m", "_g", "_done"), "matches")
        out.append(told.where("_won").drop("_won"))
        left = told.where("NOT _won").drop("_won")
    else:
        out.append(_one_by_one(left))
    return reduce(DataFrame.unionByName, out, left.limit(0))


def map_motifs(motifs: DataFrame, reduced: DataFrame, case: str = "case_id") -> DataFrame:
    """Motifs (log_id, cluster_id, start, end), half-open in a reduced log, in original indices with the case ids of those rows.

    The range starts at the first row's original index and is as long as the motif, whatever was cut out in between."""
    at = reduced.select("log_id", F.col("event_index").alias("start"), "original_index")
    out = motifs.join(at, ["log_id", "start"]).withColumn("motif_length", F.expr("end - start"))
    out = out.withColumn("orig_start", F.col("original_index")).withColumn("orig_end", F.expr("original_index + motif_length - 1"))
    rows = out.select("log_id", "cluster_id", "start", F.explode(F.expr("sequence(start, end - 1)")).alias("event_index")).join(reduced.select("log_id", "event_index", F.col(case).cast("string").alias("_case")), ["log_id", "event_index"])
    cases = rows.groupBy("log_id", "cluster_id", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "_case"))), lambda x: x["_case"]).alias("case_ids"))
    return out.join(cases, ["log_id", "cluster_id", "start"], "left").drop("original_index")


def extend_by_anchors(motifs: DataFrame, core: DataFrame, most_gap: int = 2) -> DataFrame:
    """Motifs (a_*) joined and extended by the cores (b_*) that they touch: (log_id, id, members, start, end, flag).

    A core that several motifs touch joins neighbours at most most_gap indices apart, in order of their starts, and is absorbed
    by the one with the largest overlap, then smallest start and id; a core that one motif touches is absorbed by it. A
    group has the bounds of its members and of what they absorbed, and the smallest member's id. Motifs without a core are left out.

    Groups are the connected components of what cores join, found by rounds of joins: work is dealt by core and by motif, not by log."""
    pairs = overlapping(motifs, core).select("log_id", "a_id", "a_start", "a_end", "b_id", "b_start", "b_end", "overlap")
    pairs = written(pairs, "touching")
    order = Window.partitionBy("log_id", "b_id").orderBy("a_start", "a_id")
    win = F.row_number().over(Window.partitionBy("log_id", "b_id").orderBy(F.desc("overlap"), "a_start", "a_id")) == 1
    told = pairs.withColumns({"_win": win, "_prev": F.lag("a_id").over(order), "_gap": F.col("a_start") - F.lag("a_end").over(order) - 1})
    bounds = told.groupBy("log_id", "a_id").agg(
        F.least(F.min("a_start"), F.min(F.when(F.col("_win"), F.col("b_start")))).alias("lo"), F.greatest(F.max("a_end"), F.max(F.when(F.col("_win"), F.col("b_end")))).alias("hi")
    )
    joined = F.when(F.col("_gap") <= most_gap, F.col("_prev"))
    labels = component_labels(told.select("log_id", F.col("a_id").alias("a"), F.coalesce(joined, F.col("a_id")).alias("b")), ["log_id"])
    out = bounds.join(labels.withColumnRenamed("id", "a_id"), ["log_id", "a_id"]).groupBy("log_id", F.col("label").alias("id"))
    return out.agg(F.sort_array(F.collect_list("a_id")).alias("members"), F.min("lo").alias("start"), F.max("hi").alias("end")).withColumn("flag", F.lit(True))


def anchor_decisions(motifs: DataFrame, core: DataFrame, most_gap: int = 2) -> DataFrame:
    """Cores (b_*) with extension_decision, what extend_by_anchors() does with each, as text; cores come in order of their ids.

    A core that joins neighbours tells of those that no earlier core has joined already; the texts are fixed values."""
    pairs = written(overlapping(motifs, core).select("log_id", "a_id", "a_start", "a_end", "b_id", "overlap"), "touching")
    mine = Window.partitionBy("log_id", "b_id")
    order = mine.orderBy("a_start", "a_id")
    told = pairs.withColumns({"_at": F.row_number().over(order), "_prev": F.lag("a_id").over(order), "_gap": F.col("a_start") - F.lag("a_end").over(order) - 1})
    edges = told.where(F.col("_gap") <= most_gap).select("log_id", F.col("_prev").alias("a"), F.col("a_id").alias("b"), "b_id", "_at", "_gap")
    merged = joining_edges(edges, ["log_id"], ["b_id", "_at"])
    texts = merged.groupBy("log_id", "b_id").agg(F.sort_array(F.collect_list(F.struct("_at", F.format_string("Merged %d & %d (Gap %d)", "a", "b", "_gap").alias("t")))).alias("_t"))
    each = told.groupBy("log_id", "b_id").agg(F.count("*").alias("_n"), F.min("_gap").alias("_near"), F.min(F.struct((-F.col("overlap")).alias("o"), "a_start", "a_id")).alias("_win"))
    out = core.join(each, ["log_id", "b_id"], "left").join(texts, ["log_id", "b_id"], "left")
    text = F.when(F.col("_n").isNull(), "No Overlap").when(F.col("_n") == 1, F.format_string("Extended Motif %d", "_win.a_id"))
    text = text.when(F.col("_near") <= most_gap, F.coalesce(F.array_join("_t.t", "; "), F.lit(""))).otherwise(F.format_string("Gap > 2. Winner: %d", "_win.a_id"))
    return out.select(*core.columns, text.alias("extension_decision"))


def final_motifs(spans: DataFrame, least: int = 5) -> DataFrame:
    """Motifs that match a core and are long enough."""
    return spans.where(F.col("flag") & (F.expr("end - start + 1") >= least))
