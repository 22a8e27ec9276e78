"""Scores of found motifs against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rutine.operators.intervals import greedy_matches, overlap_table, overlapping
from rutine.plans.tables import written


def share(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """df with precision, recall and f1; a denominator of zero gives 0."""
    out = df.withColumn("precision", share(F.col(tp), F.col(tp) + F.col(fp))).withColumn("recall", share(F.col(tp), F.col(tp) + F.col(fn)))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate_motifs(motifs: DataFrame, truth: DataFrame, threshold: float = 0.5, kind: str = "ratio") -> tuple[DataFrame, DataFrame]:
    """(metrics of each log, matches) of motifs and truth as in overlap_table.

    A pair may match if its overlap is more than threshold of the truth's length ('ratio'), or at least threshold indices ('absolute'); matches
    are one-to-one, the largest overlap first. Only pairs that share an index are made, by bins, unless the threshold lets others match. Logs without motifs or without truth have rows too, with zeros."""
    if threshold < 0 or (kind != "ratio" and threshold <= 0):  # pairs without an index in common may match
        t = overlap_table(motifs, truth)
    else:
        spans = (motifs.select("log_id", F.col("motif_id").alias("a_id"), F.col("motif_start").alias("a_start"), F.col("motif_end").alias("a_end")), truth.select("log_id", F.col("gt_id").alias("b_id"), F.col("gt_start").alias("b_start"), F.col("gt_end").alias("b_end")))
        t = overlapping(*spans).select("log_id", F.col("a_id").alias("motif_id"), F.col("b_id").alias("gt_id"), "overlap", (F.col("overlap") / (F.col("b_end") - F.col("b_start") + 1)).alias("overlap_gt_ratio"))
    t = written(t.select("log_id", "motif_id", "gt_id", "overlap", "overlap_gt_ratio"), "overlaps")
    able = t.where(F.col("overlap_gt_ratio") > threshold if kind == "ratio" else F.col("overlap") >= threshold)
    matches = greedy_matches(able)
    tp = matches.groupBy("log_id").agg(F.count("*").alias("tp"))
    m = motifs.groupBy("log_id").agg(F.count("*").alias("motifs"))
    g = truth.groupBy("log_id").agg(F.count("*").alias("truths"))
    # means are over all motifs, and all truths, of logs that have both
    by_motif = motifs.join(g, "log_id").select("log_id", "motif_id", (F.col("motif_end") - F.col("motif_start") + 1).alias("motif_length"))
    by_motif = by_motif.join(t.groupBy("log_id", "motif_id").agg(F.sum("overlap").alias("o")), ["log_id", "motif_id"], "left").fillna(0, ["o"])
    over = by_motif.groupBy("log_id").agg(F.avg("o").alias("intersection_abs"), F.avg(F.col("o") / F.col("motif_length")).alias("intersection_ratio"), F.avg(F.col("motif_length") - F.col("o")).alias("over_detection_abs"), F.avg(1 - F.col("o") / F.col("motif_length")).alias("over_detection_ratio"))
    by_truth = truth.join(m, "log_id").select("log_id", "gt_id", (F.col("gt_end") - F.col("gt_start") + 1).alias("gt_length"))
    by_truth = by_truth.join(t.groupBy("log_id", "gt_id").agg(F.sum("overlap").alias("o")), ["log_id", "gt_id"], "left").fillna(0, ["o"])
    under = by_truth.groupBy("log_id").agg(F.avg(F.greatest(F.lit(0), F.col("gt_length") - F.col("o"))).alias("undercount_abs"), F.avg(F.greatest(F.lit(0.0), 1 - F.col("o") / F.col("gt_length"))).alias("undercount_ratio"))
    out = m.join(g, "log_id", "full_outer").join(tp, "log_id", "left").fillna(0, ["motifs", "truths", "tp"])
    out = out.withColumn("fp", F.col("motifs") - F.col("tp")).withColumn("fn", F.col("truths") - F.col("tp"))
    return scores(out).join(over, "log_id", "left").join(under, "log_id", "left"), matches


def join_discovery(matches: DataFrame, truth: DataFrame, motifs: DataFrame) -> DataFrame:
    """Best matches with all ground truth and all motifs, matched or not: two full outer joins."""
    out = matches.select("log_id", "gt_id", "motif_id", "overlap").join(truth, ["log_id", "gt_id"], "full_outer")
    return out.join(motifs, ["log_id", "motif_id"], "full_outer")


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, purity, size): the share of the most frequent label. A null label is one of its own; rows of a null cluster are left out."""
    n = df.where(F.col(cluster).isNotNull()).groupBy(cluster, label).agg(F.count("*").alias("n"))
    return n.groupBy(cluster).agg((F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("size"))


def cluster_metrics(df: DataFrame, cluster: str = "cluster_id", case: str = "case_id", required: str = "total_occurrences") -> DataFrame:
    """For each cluster: tp, its rows with a case; fp, those without; required, the largest of its cases; fn, what lacks."""
    some = df.where(F.col(cluster).isNotNull())
    out = some.groupBy(cluster).agg(F.count(case).alias("tp"), F.sum(F.col(case).isNull().cast("long")).alias("fp"), F.max(F.when(F.col(case).isNotNull(), F.col(required))).alias("required"))
    return scores(out.withColumn("required", F.coalesce("required", F.lit(0))).withColumn("fn", F.greatest(F.col("required") - F.col("tp"), F.lit(0))))


def motif_metrics(df: DataFrame, motif: str = "motif_id", cluster: str = "cluster_id", required: str = "total_occurrences") -> DataFrame:
    """For each motif: tp, its rows; fp, the rows of other motifs, or of none, in its clusters; fn, what lacks of its total. A last
    row UNMAPPED counts, as tp, rows without a motif."""
    own = df.where(F.col(motif).isNotNull())
    tp = own.groupBy(motif).agg(F.count("*").alias("tp"), F.max(required).alias("required"))
    per = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("all"))
    mine = own.where(F.col(cluster).isNotNull()).groupBy(motif, cluster).agg(F.count("*").alias("mine"))
    fp = mine.join(per, cluster).groupBy(motif).agg(F.sum(F.col("all") - F.col("mine")).alias("fp"))
    out = tp.join(fp, motif, "left").withColumn("fp", F.coalesce("fp", F.lit(0))).withColumn("fn", F.greatest(F.col("required") - F.col("tp"), F.lit(0)))
    out = scores(out).withColumn(motif, F.col(motif).cast("string"))
    lost = df.agg(F.sum(F.col(motif).isNull().cast("long")).alias("tp")).select(F.lit("UNMAPPED").alias(motif), "tp")
    return out.unionByName(lost, allowMissingColumns=True)
