"""The whole discovery: every stage is one job over all logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.operators import evaluation, features, grammar, intervals, motifs, sequence
from rutine.operators.scans import has_long
from rutine.plans.tables import written


def encoded(log: DataFrame, columns: list[str], method: int = 0) -> DataFrame:
    """log with `vector`: 0 row-sentence embedding, 1 log-sentence embedding, 2 hierarchy ids, 3 co-occurrence order."""
    if method == 0:
        return features.embed_rows(log, columns)
    if method == 1:
        return features.embed_sequence(log, columns)
    if method == 2:
        return sequence.hierarchy_ids(log, columns).withColumn("vector", F.array(F.col("hierarchy_id").cast("double")))
    if method == 3:
        return features.encode_cooccurrence_columns(log, columns).withColumn("vector", F.array(F.col("code").cast("double")))
    raise ValueError(f"no encoding {method}")


def discover(
    log: DataFrame, truth: DataFrame, columns: list[str], app: list[str], percentile: float = 0.8, share: float = 0.8, margin_factor: float = 2.0,
    rho: float = 0.8, encoding: int = 0, threshold: float = 0.8,
) -> DataFrame:
    """Result rows of logs (log_id, event_index, columns): symbols, grammar, density, cores, contexts, reduction, embedding, motif sets,
    alignment to cores, and scores against truth (log_id, gt_id, gt_start, gt_end).

    Logs are independent, the lengths that are searched too: processing them together gives what each gives alone, but for the two embeddings
    (encoding 0 and 1), which are trained on all. Everything before the search but the walks along paths, one task for each log, is dealt in blocks where a log has a
    million events or more, similarities of long reduced logs in tiles."""
    long = has_long(log)
    log = written(sequence.symbolize(log, columns, long), "log")
    rules, _ = grammar.re_pair(log, long=long)
    dense = written(grammar.density_of(log, rules, long=long), "dense")
    core = grammar.app_switches(dense, grammar.cores(dense, "percentile", percentile, long=long), app, long)
    core = written(grammar.path_walk(dense, core, app, share), "cores")
    reduced = written(grammar.reduce_log(dense, core, margin_factor, long=long), "reduced")
    if "case_id" not in reduced.columns:
        reduced = reduced.withColumn("case_id", F.lit(None).cast("string"))
    length = grammar.motif_length_bounds(core, margin_factor)
    length = length.select("log_id", F.greatest(F.lit(2), F.floor("l_min").cast("int")).alias("lo"), F.floor("l_max").cast("int").alias("hi"))
    length = length.withColumn("hi", F.greatest("lo", F.coalesce("hi", F.col("lo"))))
    found = motifs.motif_sets(encoded(reduced, columns, encoding).join(length, "log_id"), "lo", "hi", rho)
    mapped = written(intervals.map_motifs(found, reduced), "motifs")
    order = Window.partitionBy("log_id").orderBy("orig_start", "orig_end", "cluster_id")
    a = mapped.select("log_id", (F.row_number().over(order) - 1).cast("long").alias("a_id"), F.col("orig_start").alias("a_start"), F.col("orig_end").alias("a_end"))
    b = core.select("log_id", F.col("core_id").cast("long").alias("b_id"), F.col("start_index").alias("b_start"), F.col("end_index").alias("b_end"))
    final = intervals.final_motifs(intervals.merge_overlaps(intervals.extend_by_anchors(a, b).drop("members"), long=long))
    order = Window.partitionBy("log_id").orderBy("start")
    final = written(final.select("log_id", (F.row_number().over(order) - 1).cast("long").alias("motif_id"), F.col("start").alias("motif_start"), F.col("end").alias("motif_end")), "final")
    scores = written(evaluation.evaluate_motifs(final, written(truth, "truth"), threshold)[0], "scores")
    facts = dense.groupBy("log_id").agg(F.count("*").alias("log_length"), F.var_samp("rule_density_count").alias("grammar_variance"))
    facts = facts.join(reduced.groupBy("log_id").agg(F.count("*").alias("filtered_log_length")).hint("merge"), "log_id", "left")
    facts = facts.join(core.groupBy("log_id").agg(F.count("*").alias("cores")).hint("merge"), "log_id", "left")
    return facts.join(scores.hint("merge"), "log_id", "left")


def variance_study(log: DataFrame, columns: list[str]) -> DataFrame:
    """(log_id, log_length, rules, grammar_variance) without a motif search."""
    log = written(sequence.symbolize(log, columns), "log")
    rules, _ = grammar.re_pair(log)
    dense = grammar.density_of(log, rules)
    n = rules.groupBy("log_id").agg(F.count("*").alias("rules"), F.max("level").alias("levels"))
    return dense.groupBy("log_id").agg(F.count("*").alias("log_length"), F.var_samp("rule_density_count").alias("grammar_variance")).join(n.hint("merge"), "log_id", "left").fillna(0, ["rules", "levels"])
