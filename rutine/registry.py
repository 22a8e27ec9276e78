"""The library's registered queries over the shared test tables, with SQL that gives the same rows.

events stand in for interaction logs, one log for each user; islands of an event type for motifs; fixed blocks for ground truth."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.functions import scalars
from rutine.operators import clusters, evaluation, features, grammar, intervals, mining, motifs, reports, sequence, synthesis
from rutine.plans.pipeline import discover, variance_study
from rutine.plans.tables import shared_dir, written
from rutine.sources import datasets, logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, event_index, event_type, ts, value, k), a log for each user in the order of event_id."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 3
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("log_id"), (F.row_number().over(order) - F.lit(1).cast("long")).alias("event_index"), "event_type", "ts", "value", k.alias("k"))


def symbol_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.symbolize(event_log(spark, sf_dir), ["event_type", "k"])


def type_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of purchases and views as motifs: (log_id, motif_id, motif_start, motif_end)."""
    rows = event_log(spark, sf_dir).where("event_type IN ('purchase', 'view')")
    runs = sequence.islands(rows, merge_gap=2)
    order = Window.partitionBy("log_id").orderBy("start_index")
    return runs.select("log_id", (F.row_number().over(order) - 1).cast("long").alias("motif_id"), F.col("start_index").alias("motif_start"), F.col("end_index").alias("motif_end"))


def block_truth(spark: SparkSession, sf_dir: str, size: int = 10, every: int = 2) -> DataFrame:
    """Every second block of ten events as ground truth: (log_id, gt_id, gt_start, gt_end)."""
    ends = event_log(spark, sf_dir).groupBy("log_id").agg(F.max("event_index").alias("n"))
    rows = ends.withColumn("gt_id", F.explode(F.expr(f"sequence(0, CAST(floor(n / {size * every}) AS BIGINT))")))
    return rows.select("log_id", F.col("gt_id").cast("long").alias("gt_id"), (F.col("gt_id") * size * every).alias("gt_start"), F.least(F.col("gt_id") * size * every + size - 1, F.col("n")).alias("gt_end"))


LOG = "log AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_index, event_type, ts, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 AS k FROM events)"
SYMBOLS = LOG + """, keyed AS (SELECT *, event_type || '|' || coalesce(CAST(k AS VARCHAR), 'nan') AS key FROM log),
    keys AS (SELECT log_id, key, count(event_type) AS n, row_number() OVER (PARTITION BY log_id ORDER BY key) - 1 AS code FROM keyed GROUP BY log_id, key),
    symbols AS (SELECT x.*, n AS "count", CAST(code AS INT) AS symbol_code, chr(CAST(65 + code AS INT)) AS symbol FROM keyed x JOIN keys USING (log_id, key))"""
ISLANDS = "runs AS (SELECT log_id, min(event_index) AS start_index, max(event_index) AS end_index, count(*) AS length FROM (SELECT log_id, event_index, event_index - row_number() OVER (PARTITION BY log_id ORDER BY event_index) AS g FROM picked) GROUP BY log_id, g)"
MERGED = ISLANDS + """, gaps AS (SELECT *, CASE WHEN start_index - lag(end_index) OVER (PARTITION BY log_id ORDER BY start_index) <= 2 THEN 0 ELSE 1 END AS far FROM runs),
    merged AS (SELECT log_id, min(start_index) AS start_index, max(end_index) AS end_index, CAST(sum(length) AS BIGINT) AS length FROM (SELECT *, sum(far) OVER (PARTITION BY log_id ORDER BY start_index) AS g FROM gaps) GROUP BY log_id, g)"""
PICKED = LOG + ", picked AS (SELECT * FROM log WHERE event_type IN ('purchase', 'view'))"
MOTIFS = PICKED + ", " + MERGED + ", motifs AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY start_index) - 1 AS motif_id, start_index AS motif_start, end_index AS motif_end FROM merged)"
TRUTH = "ends AS (SELECT log_id, max(event_index) AS n FROM log GROUP BY log_id), truth AS (SELECT log_id, g AS gt_id, g * 20 AS gt_start, least(g * 20 + 9, n) AS gt_end FROM (SELECT log_id, n, unnest(range(0, CAST(floor(n / 20) AS BIGINT) + 1)) AS g FROM ends))"
OVERLAPS = MOTIFS + ", " + TRUTH + """, pairs AS (SELECT log_id, motif_id, gt_id, motif_start, motif_end, gt_start, gt_end, motif_end - motif_start + 1 AS motif_length, gt_end - gt_start + 1 AS gt_length,
    greatest(0, least(motif_end, gt_end) - greatest(motif_start, gt_start) + 1) AS overlap FROM motifs JOIN truth USING (log_id))"""


# sequences


@query("q_symbolize", f"WITH {SYMBOLS} SELECT log_id, event_index, symbol_code, symbol, \"count\" FROM symbols")
def q_symbolize(spark, sf_dir):
    return symbol_log(spark, sf_dir).select("log_id", "event_index", "symbol_code", "symbol", "count")


@query("q_symbol_count", f"WITH {SYMBOLS} SELECT log_id, count(DISTINCT symbol) AS symbols, count(*) AS events FROM symbols GROUP BY log_id")
def q_symbol_count(spark, sf_dir):
    return symbol_log(spark, sf_dir).groupBy("log_id").agg(F.countDistinct("symbol").alias("symbols"), F.count("*").alias("events"))


@query("q_factorize", f"WITH {LOG}, f AS (SELECT log_id, event_type, k, CAST(row_number() OVER (PARTITION BY log_id ORDER BY min(event_index)) - 1 AS INT) AS code FROM log GROUP BY log_id, event_type, k) SELECT log_id, event_index, code FROM log JOIN f USING (log_id, event_type, k)")
def q_factorize(spark, sf_dir):
    return sequence.factorize(event_log(spark, sf_dir), ["event_type", "k"]).select("log_id", "event_index", "code")


@query("q_hierarchy_id", f"WITH {LOG}, f AS (SELECT log_id, k, event_type, CAST(row_number() OVER (PARTITION BY log_id ORDER BY k, event_type) - 1 AS INT) AS hierarchy_id FROM log GROUP BY log_id, event_type, k) SELECT log_id, event_index, hierarchy_id FROM log JOIN f USING (log_id, event_type, k)")
def q_hierarchy_id(spark, sf_dir):
    return sequence.hierarchy_ids(event_log(spark, sf_dir), ["k", "event_type"]).select("log_id", "event_index", "hierarchy_id")


@query("q_bigram_top", f"""WITH {SYMBOLS}, p AS (SELECT log_id, event_index, symbol AS "left", lead(symbol) OVER (PARTITION BY log_id ORDER BY event_index) AS "right" FROM symbols)
    SELECT log_id, "left", "right", count(*) AS "count", min(event_index) AS first_pos FROM p WHERE "right" IS NOT NULL GROUP BY ALL""")
def q_bigram_top(spark, sf_dir):
    return sequence.bigram_table(symbol_log(spark, sf_dir), positions=False)


@query("q_bigram_positions", f"""WITH {SYMBOLS}, p AS (SELECT log_id, event_index, symbol AS "left", lead(symbol) OVER (PARTITION BY log_id ORDER BY event_index) AS "right" FROM symbols)
    SELECT log_id, "left", "right", array_to_string(list_sort(list(event_index)), ',') AS positions FROM p WHERE "right" IS NOT NULL GROUP BY log_id, "left", "right" """)
def q_bigram_positions(spark, sf_dir):
    return sequence.bigram_table(symbol_log(spark, sf_dir)).select("log_id", "left", "right", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("q_cooccurrence_n", f"""WITH {LOG}, c AS (SELECT *, max(event_index) OVER (PARTITION BY log_id) AS n FROM log)
    SELECT a.log_id, a.event_type AS a, b.event_type AS b, count(*) AS "count" FROM c a JOIN c b ON a.log_id = b.log_id AND a.event_index <> b.event_index AND abs(a.event_index - b.event_index) <= 2 WHERE a.event_index < a.n GROUP BY 1, 2, 3""")
def q_cooccurrence_n(spark, sf_dir):
    return sequence.cooccurrence(event_log(spark, sf_dir), "event_type", 2)


@query("q_islands", f"WITH {PICKED}, {ISLANDS} SELECT * FROM runs")
def q_islands(spark, sf_dir):
    return sequence.islands(event_log(spark, sf_dir).where("event_type IN ('purchase', 'view')"))


@query("q_islands_merge_gap", f"WITH {PICKED}, {MERGED} SELECT * FROM merged")
def q_islands_merge_gap(spark, sf_dir):
    return sequence.islands(event_log(spark, sf_dir).where("event_type IN ('purchase', 'view')"), merge_gap=2)


GAPS = LOG + ", g AS (SELECT log_id, event_index, coalesce((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 0.0) AS total FROM log WINDOW w AS (PARTITION BY log_id ORDER BY event_index)), s AS (SELECT *, CAST(((floor(total) % 86400) + 86400) % 86400 AS BIGINT) AS sec FROM g)"


@query("q_time_gap_static", f"WITH {GAPS} SELECT log_id, event_index, sec AS gap_seconds, total > 3600 AS gap_static FROM s")
def q_time_gap_static(spark, sf_dir):
    return sequence.time_gaps(event_log(spark, sf_dir)).select("log_id", "event_index", "gap_seconds", "gap_static")


@query("q_time_gap_rolling", f"""WITH {GAPS}, r AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(least(greatest(CAST(sec AS DOUBLE), 0), 3600)) OVER w END AS m FROM s WINDOW w AS (PARTITION BY log_id ORDER BY event_index ROWS 4 PRECEDING))
    SELECT log_id, event_index, m AS gap_mean, coalesce(m < sec, false) AS gap_dynamic FROM r""")
def q_time_gap_rolling(spark, sf_dir):
    return sequence.time_gaps(event_log(spark, sf_dir), n=5).select("log_id", "event_index", "gap_mean", "gap_dynamic")


@query("q_break_window", f"""WITH {LOG}, g AS (SELECT log_id, event_index, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY log_id ORDER BY event_index))) / 1e6 AS gap FROM log),
    f AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY event_index) - 1 AS place FROM g WHERE gap <= 100000), q AS (SELECT log_id, quantile_cont(gap, 0.75) AS quantile FROM f GROUP BY log_id),
    b AS (SELECT log_id, place - lag(place) OVER (PARTITION BY log_id ORDER BY place) - 1 AS step FROM f JOIN q USING (log_id) WHERE gap = quantile), c AS (SELECT log_id, count(*) AS breaks, avg(step) AS window_size FROM b GROUP BY log_id)
    SELECT log_id, quantile, coalesce(breaks, 0) AS breaks, window_size FROM q LEFT JOIN c USING (log_id)""")
def q_break_window(spark, sf_dir):
    return sequence.break_window(event_log(spark, sf_dir), threshold=100000)


@query("q_nearest_boundary", f"""WITH {LOG}, b AS (SELECT *, event_type = 'purchase' AS bd FROM log)
    SELECT log_id, event_index, CASE WHEN NOT bd THEN min(CASE WHEN bd THEN event_index END) OVER (PARTITION BY log_id ORDER BY event_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS next_boundary,
           max(CASE WHEN bd THEN event_index END) OVER (PARTITION BY log_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_boundary FROM b""")
def q_nearest_boundary(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("is_boundary", F.col("event_type") == "purchase")
    return sequence.nearest_boundaries(log).select("log_id", "event_index", "next_boundary", "previous_boundary")


WINDOWS = LOG + ", ends AS (SELECT log_id, max(event_index) AS n FROM log GROUP BY log_id), starts AS (SELECT log_id, unnest(range(0, n + 1, 7)) AS s FROM ends), kept AS (SELECT log_id, s, row_number() OVER (PARTITION BY log_id ORDER BY s) - 1 AS c FROM starts)"


def _starts(log: DataFrame, step: int = 7) -> DataFrame:
    """Every step-th place of each log, from its first to its last."""
    ends = log.groupBy("log_id").agg(F.max("event_index").alias("n"))
    return ends.select("log_id", F.explode(F.expr(f"sequence(0L, n, {step}L)")).alias("start_index"))


@query("q_window_extract", f"WITH {WINDOWS} SELECT log_id, s AS window_start, CAST(c AS VARCHAR) AS case_number, event_index, event_type FROM kept JOIN log USING (log_id) WHERE event_index BETWEEN s AND s + 9")
def q_window_extract(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return sequence.extract_windows(log, _starts(log), 10).select("log_id", "window_start", "case_number", "event_index", "event_type")


@query("q_window_mean", f"WITH {WINDOWS} SELECT log_id, s AS window_start, avg(value) AS mean_value, avg(CAST(k AS DOUBLE)) AS mean_k FROM kept JOIN log USING (log_id) WHERE event_index BETWEEN s AND s + 9 GROUP BY log_id, s HAVING count(*) = 10")
def q_window_mean(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("vector", F.array("value", F.col("k").cast("double")))
    out = sequence.window_means(log, _starts(log), 10)
    return out.select("log_id", "window_start", F.get("mean", F.lit(0)).alias("mean_value"), F.get("mean", F.lit(1)).alias("mean_k"))


@query("q_case_list", f"WITH {LOG} SELECT log_id, event_type AS case_id, min(event_index) AS start_index, count(*) AS length FROM log GROUP BY log_id, event_type")
def q_case_list(spark, sf_dir):
    return sequence.case_list(event_log(spark, sf_dir).withColumnRenamed("event_type", "case_id"))


@query("q_identifier_positions", f"WITH {LOG} SELECT log_id, event_type, array_to_string(list_sort(list(event_index)), ',') AS positions FROM log GROUP BY log_id, event_type")
def q_identifier_positions(spark, sf_dir):
    return sequence.identifier_positions(event_log(spark, sf_dir), "event_type").select("log_id", "event_type", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("q_union_logs", "SELECT l AS log_id, row_number() OVER (PARTITION BY l ORDER BY part, i) - 1 AS event_index, kind, role FROM (SELECT user_id AS l, 0 AS part, event_id AS i, event_type AS kind, NULL AS role FROM events UNION ALL SELECT conv_id, 1, turn, NULL, role FROM conversations)")
def q_union_logs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("event_index"), F.col("event_type").alias("kind"))
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("log_id"), F.col("turn").alias("event_index"), "role")
    return sequence.union_logs(e, c)


@query("q_resume_antijoin", f"WITH {LOG}, c AS (SELECT log_id, count(*) AS n FROM log GROUP BY log_id) SELECT log_id, n, CASE WHEN n > 70 THEN 'n ' || n || ' is over 70' END AS error_message FROM c WHERE log_id % 3 <> 0")
def q_resume_antijoin(spark, sf_dir):
    n = event_log(spark, sf_dir).groupBy("log_id").agg(F.count("*").alias("n"))
    run, over = logs.to_process(n, n.where("log_id % 3 = 0"), "log_id", "n", 70)
    return run.unionByName(over, allowMissingColumns=True)


@query("q_folder_budget", """WITH p AS (SELECT *, user_id % 8 AS part FROM events), n AS (SELECT part, sum(count(*)) OVER (ORDER BY part) AS total FROM p GROUP BY part),
    kept AS (SELECT part FROM n WHERE total <= (SELECT count(*) * 6 // 10 FROM events))
    SELECT row_number() OVER (ORDER BY part, event_id) - 1 AS event_index, CAST(event_id AS VARCHAR) AS event_id, event_type, CASE WHEN part % 2 = 1 THEN CAST(user_id AS VARCHAR) END AS user_id FROM p JOIN kept USING (part)""")
def q_folder_budget(spark, sf_dir):
    """Events written as a folder of CSV files with two headers, and read back up to before the file that would exceed six tenths of all rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("part", F.format_string("%02d", F.col("user_id") % 8))
    path = f"{shared_dir(spark)}/rutine-folder-{uuid.uuid4().hex}"
    for odd, columns in ((0, ["event_id", "event_type"]), (1, ["event_id", "event_type", "user_id"])):
        some = events.where(F.col("user_id") % 2 == odd).select("part", *columns)
        some.repartition("part").sortWithinPartitions("part", F.col("event_id")).write.mode("append").partitionBy("part").option("header", True).csv(path)
    most = events.count() * 6 // 10
    return logs.read_folder(spark, f"{path}/part=*", most).select("event_index", "event_id", "event_type", "user_id")


@query("q_epoch_truth", f"""WITH {LOG}, ends AS (SELECT log_id, max(event_index) AS n FROM log GROUP BY log_id), starts AS (SELECT log_id, unnest(range(0, n + 1, 12)) AS s FROM ends),
    seq AS (SELECT s.log_id, row_number() OVER (PARTITION BY s.log_id ORDER BY s) - 1 AS caseid, a.ts AS t0, b.ts AS t1 FROM starts s JOIN log a ON a.log_id = s.log_id AND a.event_index = s LEFT JOIN log b ON b.log_id = s.log_id AND b.event_index = s + 5),
    f AS (SELECT log_id, ts, min(event_index) AS p FROM log GROUP BY log_id, ts)
    SELECT seq.log_id, caseid, x.p AS start_index, y.p - x.p + 1 AS length, y.p AS end_index FROM seq LEFT JOIN f x ON x.log_id = seq.log_id AND x.ts = t0 LEFT JOIN f y ON y.log_id = seq.log_id AND y.ts = t1""")
def q_epoch_truth(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumnRenamed("ts", "epoch")
    at = log.select("log_id", "event_index", "epoch")
    rows = _starts(log, 12).join(at.withColumnsRenamed({"event_index": "start_index", "epoch": "initepoch"}), ["log_id", "start_index"])
    ends = at.select("log_id", (F.col("event_index") - 5).alias("start_index"), F.col("epoch").alias("endepoch"))
    rows = rows.join(ends, ["log_id", "start_index"], "left")
    return datasets.truth_by_epoch(log, rows, ["start_index"]).select("log_id", "caseid", "start_index", "length", "end_index")


@query("q_pattern_text", f"""WITH {LOG}, spans AS (SELECT log_id, unnest(range(0, max(event_index) + 1, 12)) AS s FROM log GROUP BY log_id),
    w AS (SELECT log_id, s, string_agg(event_type, ' -1 ' ORDER BY event_index) || ' -1 -2' AS line FROM spans JOIN log USING (log_id) WHERE event_index BETWEEN s AND s + 2 GROUP BY log_id, s)
    SELECT log_id, line, min(s) AS first_index FROM w GROUP BY log_id, line""")
def q_pattern_text(spark, sf_dir):
    log = event_log(spark, sf_dir)
    truth = _starts(log, 12).withColumn("length", F.lit(3).cast("long"))
    return logs.pattern_lines(log, truth, "event_type")


# scalar functions


@query("q_num_to_letters", "WITH RECURSIVE l AS (SELECT p_partkey, p_partkey AS n, '' AS w FROM part UNION ALL SELECT p_partkey, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INT)) || w FROM l WHERE n > 0) SELECT p_partkey, w AS letters FROM l WHERE n = 0")
def q_num_to_letters(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scalars.num_to_letters(F.col("p_partkey") - 1).alias("letters"))


@query("q_label_clean", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(replace(x, 'nan', ''), '(.)([A-Z][a-z]+)', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-zA-Z]', ' ', 'g'), ' +', ' ', 'g')) AS label
    FROM (SELECT p_partkey, p_name || 'SaveButton' || p_brand || 'finance' AS x FROM part)""")
def q_label_clean(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", scalars.clean_label(F.concat("p_name", F.lit("SaveButton"), "p_brand", F.lit("finance"))).alias("label"))


#: The forms with the day and the year first use look-ahead and back references, which the other engine lacks. Both are of whole values, which no
#: document is; tests/test_library.py holds them against another implementation.
DATES = " OR ".join(f"regexp_matches(text, '{scalars.DATE_FORMS[i]}')" for i in (0, 3, 4))


@query("q_date_flag", f"SELECT doc_id, coalesce({DATES}, false) AS has_date FROM documents")
def q_date_flag(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.coalesce(scalars.has_date(F.col("text")), F.lit(False)).alias("has_date"))


@query("q_path_tokens", "SELECT p_partkey, 'p_brand=' || replace(p_brand, '=', '\\=') || '|' || 'p_size=' || p_size || '#' || 'p_type=' || replace(replace(p_type, '|', '\\|'), '=', '\\=') AS path FROM part")
def q_path_tokens(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.array_join(scalars.level_path([["p_brand", "p_size"], ["p_type"]]), "#").alias("path"))


TERMS = ", ".join(f"'{t}'" for t in scalars.MISSING)


@query("q_event_tuple", f"""SELECT conv_id, turn, concat_ws('*#*', CASE WHEN role IS NULL THEN 'nan' WHEN role NOT IN ({TERMS}) THEN role END, CASE WHEN kind IS NULL THEN 'nan' WHEN kind NOT IN ({TERMS}) THEN kind END, CAST(turn AS VARCHAR)) AS event_tuple,
    concat_ws(',', CASE WHEN role NOT IN ({TERMS}) THEN role END, CASE WHEN kind NOT IN ({TERMS}) THEN kind END) AS value_tuple
    FROM (SELECT *, CASE turn % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'Unknown' WHEN 2 THEN '0;n/a' END AS kind FROM conversations)""")
def q_event_tuple(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c = c.withColumn("kind", F.when(F.col("turn") % 4 == 0, "unknown").when(F.col("turn") % 4 == 1, "Unknown").when(F.col("turn") % 4 == 2, "0;n/a"))
    return c.select("conv_id", "turn", scalars.event_tuple("role", "kind", "turn").alias("event_tuple"), F.array_join(scalars.value_tuple("role", "kind"), ",").alias("value_tuple"))


@query("q_dictionary_lookup", f"WITH {LOG}, d AS (SELECT event_type, k, row_number() OVER (ORDER BY min(event_id)) - 1 AS id FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 AS k FROM events WHERE user_id % 2 = 0 AND event_type <> 'error') GROUP BY event_type, k) SELECT log_id, event_index, coalesce(d.id, -1) AS id FROM log LEFT JOIN d ON log.event_type = d.event_type AND log.k IS NOT DISTINCT FROM d.k")
def q_dictionary_lookup(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 2 = 0 AND event_type <> 'error'").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 3)
    known = sequence.dictionary(e, ["event_type", "k"], "event_id")
    return sequence.lookup(event_log(spark, sf_dir), known, ["event_type", "k"]).select("log_id", "event_index", "id")


@query("q_latex_name", "SELECT DISTINCT l_returnflag, l_linestatus, 'TotalFOnePointZero' || l_returnflag || l_linestatus AS name FROM lineitem")
def q_latex_name(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus").distinct()
    return rows.withColumn("name", scalars.latex_name(F.concat(F.lit("total_f1.0_"), "l_returnflag", F.lit("_"), "l_linestatus")))


# grammar


def _level_one(log: DataFrame) -> DataFrame:
    """The five most frequent pairs of each log as rules of length 2."""
    order = Window.partitionBy("log_id").orderBy(F.desc("count"), "first_pos")
    pairs = sequence.bigram_table(log, positions=False).withColumn("r", F.row_number().over(order)).where("r <= 5")
    return pairs.select("log_id", F.array("left", "right").alias("expansion"))


DENSITY = SYMBOLS + """, e AS (SELECT log_id, event_index, symbol AS l, lead(symbol) OVER (PARTITION BY log_id ORDER BY event_index) AS r FROM symbols),
    top AS (SELECT log_id, l, r FROM (SELECT log_id, l, r, row_number() OVER (PARTITION BY log_id ORDER BY count(*) DESC, min(event_index)) AS n FROM e WHERE r IS NOT NULL GROUP BY log_id, l, r) WHERE n <= 5),
    hit AS (SELECT log_id, event_index, CASE WHEN top.l IS NULL THEN 0 ELSE 1 END AS h FROM e LEFT JOIN top USING (log_id, l, r)),
    density AS (SELECT log_id, event_index, CAST(h + coalesce(lag(h) OVER (PARTITION BY log_id ORDER BY event_index), 0) AS BIGINT) AS rule_density_count FROM hit)"""


def dense_log(spark, sf_dir) -> DataFrame:
    log = written(symbol_log(spark, sf_dir), "symbols")
    return grammar.rule_density(log, _level_one(log))


@query("q_density_fixed_rules", f"WITH {DENSITY} SELECT * FROM density")
def q_density_fixed_rules(spark, sf_dir):
    return dense_log(spark, sf_dir).select("log_id", "event_index", "rule_density_count")


@query("q_repair_rules")
def q_repair_rules(spark, sf_dir):
    return grammar.re_pair(symbol_log(spark, sf_dir))[0]


@query("q_repair_sequence")
def q_repair_sequence(spark, sf_dir):
    return grammar.re_pair(symbol_log(spark, sf_dir))[1]


@query("q_rule_expand", f"WITH {SYMBOLS} SELECT log_id, event_index, symbol FROM symbols")
def q_rule_expand(spark, sf_dir):
    """The encoded sequences with all rules expanded: the raw symbols again."""
    rules, seq = grammar.re_pair(symbol_log(spark, sf_dir))
    return grammar.expand(seq, rules)


@query("q_rule_closure")
def q_rule_closure(spark, sf_dir):
    return grammar.rules_with(grammar.re_pair(symbol_log(spark, sf_dir))[0], "A", recursive=True)


@query("q_grammar_density")
def q_grammar_density(spark, sf_dir):
    log = written(symbol_log(spark, sf_dir), "symbols")
    return grammar.density_of(log, grammar.re_pair(log)[0]).select("log_id", "event_index", "symbol", "rule_density_count")


CORE_ISLANDS = ISLANDS + ", cores AS (SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY start_index) - 1 AS INT) AS core_id FROM runs)"


@query("q_cores_percentile", f"WITH {DENSITY}, c AS (SELECT log_id, quantile_cont(rule_density_count, 0.8) AS cutoff FROM density GROUP BY log_id), picked AS (SELECT d.* FROM density d JOIN c USING (log_id) WHERE rule_density_count >= cutoff), {CORE_ISLANDS} SELECT * FROM cores")
def q_cores_percentile(spark, sf_dir):
    return grammar.cores(dense_log(spark, sf_dir), "percentile", 0.8)


@query("q_cores_threshold", f"WITH {DENSITY}, c AS (SELECT log_id, max(rule_density_count) * 0.9 AS cutoff FROM density GROUP BY log_id), picked AS (SELECT d.* FROM density d JOIN c USING (log_id) WHERE rule_density_count >= cutoff), {CORE_ISLANDS} SELECT * FROM cores")
def q_cores_threshold(spark, sf_dir):
    return grammar.cores(dense_log(spark, sf_dir), "relative", 0.9)


@query("q_cores_mad", f"""WITH {DENSITY}, m AS (SELECT log_id, quantile_cont(rule_density_count, 0.5) AS m FROM density WHERE rule_density_count <> 0 GROUP BY log_id),
    c AS (SELECT log_id, m + 3 * quantile_cont(abs(rule_density_count - m), 0.5) AS cutoff FROM density JOIN m USING (log_id) WHERE rule_density_count <> 0 GROUP BY log_id, m),
    picked AS (SELECT d.* FROM density d JOIN c USING (log_id) WHERE rule_density_count >= cutoff), {CORE_ISLANDS} SELECT * FROM cores""")
def q_cores_mad(spark, sf_dir):
    return grammar.cores(dense_log(spark, sf_dir), "mad")


SWITCH = f"""{DENSITY}, c AS (SELECT log_id, quantile_cont(rule_density_count, 0.8) AS cutoff FROM density GROUP BY log_id), picked AS (SELECT d.* FROM density d JOIN c USING (log_id) WHERE rule_density_count >= cutoff), {CORE_ISLANDS},
    ch AS (SELECT log_id, event_index, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY log_id ORDER BY event_index) AS f, event_type IS DISTINCT FROM lead(event_type) OVER (PARTITION BY log_id ORDER BY event_index) AS l FROM log),
    b AS (SELECT log_id, event_index, max(CASE WHEN f THEN event_index END) OVER (PARTITION BY log_id ORDER BY event_index ROWS UNBOUNDED PRECEDING) AS f,
          min(CASE WHEN l THEN event_index END) OVER (PARTITION BY log_id ORDER BY event_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM ch),
    sw AS (SELECT c.*, CASE WHEN x.f = start_index THEN start_index ELSE x.f + 1 END AS lower_app_switch, CASE WHEN y.l = end_index THEN end_index ELSE y.l - 1 END AS upper_app_switch
           FROM cores c JOIN b x ON x.log_id = c.log_id AND x.event_index = start_index JOIN b y ON y.log_id = c.log_id AND y.event_index = end_index)"""


def _switched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    log = written(dense_log(spark, sf_dir), "dense")
    return log, grammar.app_switches(log, grammar.cores(log, "percentile", 0.8), ["event_type"])


@query("q_app_switch", f"WITH {SWITCH} SELECT log_id, core_id, start_index, end_index, lower_app_switch, upper_app_switch FROM sw")
def q_app_switch(spark, sf_dir):
    return _switched(spark, sf_dir)[1].select("log_id", "core_id", "start_index", "end_index", "lower_app_switch", "upper_app_switch")


@query("q_path_walk", f"""WITH RECURSIVE {SWITCH}, all_cores AS (SELECT log_id, count(*) AS n FROM sw GROUP BY log_id),
    w(log_id, core_id, step, p, d) AS (SELECT log_id, core_id, unnest([-1, 1]), unnest([lower_app_switch, upper_app_switch]), 0 FROM sw
      UNION ALL SELECT log_id, core_id, step, p, d FROM (
        SELECT w.log_id, w.core_id, w.step, w.p + w.step AS p, w.d + 1 AS d, count(*) OVER (PARTITION BY w.log_id, w.step, coalesce(l.event_type, 'nan')) >= CAST(0.3 AS DOUBLE) * a.n AS enough
        FROM w JOIN all_cores a ON a.log_id = w.log_id JOIN log l ON l.log_id = w.log_id AND l.event_index = w.p + w.step) WHERE enough)
    SELECT log_id, core_id, min(p) FILTER (step = -1) AS lower_pattern_switch, max(p) FILTER (step = 1) AS upper_pattern_switch FROM w GROUP BY log_id, core_id""")
def q_path_walk(spark, sf_dir):
    log, core = _switched(spark, sf_dir)
    return grammar.path_walk(log, core, ["event_type"], 0.3).select("log_id", "core_id", "lower_pattern_switch", "upper_pattern_switch")


@query("q_reduce_log", f"""WITH {SWITCH}, r AS (SELECT log_id, greatest(0, lower_app_switch - 2 * (upper_app_switch - lower_app_switch)) AS lo, least(upper_app_switch + 2 * (upper_app_switch - lower_app_switch), n) AS hi
      FROM sw JOIN (SELECT log_id, max(event_index) AS n FROM log GROUP BY log_id) USING (log_id)),
    kept AS (SELECT log_id, event_index, event_type FROM log l WHERE EXISTS (SELECT 1 FROM r WHERE r.log_id = l.log_id AND event_index >= lo AND event_index < hi))
    SELECT log_id, event_index AS original_index, row_number() OVER (PARTITION BY log_id ORDER BY event_index) - 1 AS event_index, event_type FROM kept""")
def q_reduce_log(spark, sf_dir):
    log, core = _switched(spark, sf_dir)
    return grammar.reduce_log(log, core, 2.0, "lower_app_switch", "upper_app_switch").select("log_id", "original_index", "event_index", "event_type")


# intervals


def _ab(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = type_motifs(spark, sf_dir).toDF("log_id", "a_id", "a_start", "a_end")
    return a, block_truth(spark, sf_dir).toDF("log_id", "b_id", "b_start", "b_end")


@query("q_overlap_table", f"""WITH {OVERLAPS} SELECT *, overlap / motif_length AS overlap_motif_ratio, overlap / gt_length AS overlap_gt_ratio,
    row_number() OVER (PARTITION BY log_id, gt_id ORDER BY overlap DESC, motif_id) = 1 AND overlap > 0 AS is_best_match FROM pairs""")
def q_overlap_table(spark, sf_dir):
    return intervals.overlap_table(type_motifs(spark, sf_dir), block_truth(spark, sf_dir))


@query("q_overlap_join", f"WITH {OVERLAPS} SELECT log_id, motif_id AS a_id, gt_id AS b_id, overlap FROM pairs WHERE overlap > 0")
def q_overlap_join(spark, sf_dir):
    return intervals.overlapping(*_ab(spark, sf_dir)).select("log_id", "a_id", "b_id", "overlap")


@query("q_overlap_flag", f"WITH {OVERLAPS} SELECT log_id, motif_id AS a_id, max(overlap) > 0 AS grammar_match FROM pairs GROUP BY log_id, motif_id")
def q_overlap_flag(spark, sf_dir):
    return intervals.flag_overlaps(*_ab(spark, sf_dir)).select("log_id", "a_id", "grammar_match")


@query("q_overlap_analyze", f"""WITH {OVERLAPS}, o AS (SELECT log_id, motif_id, count(*) AS t, count(*) FILTER (gt_start >= motif_start AND gt_end <= motif_end) AS c, string_agg(gt_id, ',' ORDER BY gt_id) AS touched FROM pairs WHERE overlap > 0 GROUP BY log_id, motif_id)
    SELECT log_id, motif_id AS a_id, touched, CASE WHEN t IS NULL THEN 'No Overlap' WHEN c > 0 THEN 'Contains ' || c || ' Cores Full' ELSE 'Partial Overlap with ' || t || ' Cores' END AS status FROM motifs LEFT JOIN o USING (log_id, motif_id)""")
def q_overlap_analyze(spark, sf_dir):
    m, _ = intervals.analyze_overlaps(*_ab(spark, sf_dir))
    return m.select("log_id", "a_id", F.when(F.col("touched").isNotNull(), F.array_join(F.col("touched").cast("array<string>"), ",")).alias("touched"), "status")


@query("q_overlap_analyze_cores", f"""WITH {OVERLAPS}, o AS (SELECT log_id, gt_id, count(*) AS t, count(*) FILTER (gt_start >= motif_start AND gt_end <= motif_end) AS c, string_agg(motif_id, ', ' ORDER BY motif_id) FILTER (gt_start >= motif_start AND gt_end <= motif_end) AS inside FROM pairs WHERE overlap > 0 GROUP BY log_id, gt_id)
    SELECT log_id, gt_id AS b_id, coalesce(c > 0, false) AS is_contained, CASE WHEN t IS NULL THEN 'Isolated' WHEN c > 0 THEN 'Fully inside Motif [' || inside || ']' ELSE 'Partial overlap with ' || t || ' motifs' END AS status FROM truth LEFT JOIN o USING (log_id, gt_id)""")
def q_overlap_analyze_cores(spark, sf_dir):
    return intervals.analyze_overlaps(*_ab(spark, sf_dir))[1].select("log_id", "b_id", "is_contained", "status")


WIDE = MOTIFS + ", wide AS (SELECT log_id, motif_id AS id, motif_start - 1 AS s, motif_end + 2 AS e, motif_id % 2 = 0 AS flag FROM motifs)"


def _wide(spark, sf_dir) -> DataFrame:
    return type_motifs(spark, sf_dir).select("log_id", F.col("motif_id").alias("id"), (F.col("motif_start") - 1).alias("start"), (F.col("motif_end") + 2).alias("end"), (F.col("motif_id") % 2 == 0).alias("flag"))


@query("q_merge_overlaps", f"""WITH {WIDE}, n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY log_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM wide),
    g AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY s, e, id) AS run FROM n)
    SELECT log_id, min(s) AS "start", max(e) AS "end", string_agg(id, ',' ORDER BY id) AS members, bool_or(flag) AS flag, max(e) - min(s) + 1 AS length FROM g GROUP BY log_id, run""")
def q_merge_overlaps(spark, sf_dir):
    out = intervals.merge_overlaps(_wide(spark, sf_dir))
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


ANCHORS = "RECURSIVE " + OVERLAPS + """, hit AS (SELECT * FROM pairs WHERE overlap > 0),
    won AS (SELECT log_id, motif_id, gt_start, gt_end FROM (SELECT *, row_number() OVER (PARTITION BY log_id, gt_id ORDER BY overlap DESC, motif_start, motif_id) AS n FROM hit) WHERE n = 1),
    bounds AS (SELECT h.log_id, h.motif_id, least(min(motif_start), min(w.gt_start)) AS lo, greatest(max(motif_end), max(w.gt_end)) AS hi FROM hit h LEFT JOIN won w ON w.log_id = h.log_id AND w.motif_id = h.motif_id GROUP BY h.log_id, h.motif_id),
    links AS (SELECT log_id, motif_id AS a, lag(motif_id) OVER w AS b, motif_start - lag(motif_end) OVER w - 1 AS gap FROM hit WINDOW w AS (PARTITION BY log_id, gt_id ORDER BY motif_start, motif_id)),
    both_ways AS (SELECT log_id, a, b FROM links WHERE gap <= 2 UNION SELECT log_id, b, a FROM links WHERE gap <= 2),
    reach(log_id, a, b) AS (SELECT log_id, motif_id, motif_id FROM bounds UNION SELECT r.log_id, r.a, l.b FROM reach r JOIN both_ways l ON l.log_id = r.log_id AND l.a = r.b),
    named AS (SELECT log_id, a AS motif_id, min(b) AS id FROM reach GROUP BY log_id, a),
    anchored AS (SELECT log_id, id, string_agg(motif_id, ',' ORDER BY motif_id) AS members, min(lo) AS s, max(hi) AS e FROM named JOIN bounds USING (log_id, motif_id) GROUP BY log_id, id)"""


@query("q_anchor_extend", f"""WITH {ANCHORS} SELECT log_id, id, members, s AS "start", e AS "end", true AS flag FROM anchored""")
def q_anchor_extend(spark, sf_dir):
    out = intervals.extend_by_anchors(*_ab(spark, sf_dir))
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("q_final_motifs", f"""WITH {ANCHORS}, n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY log_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM anchored),
    g AS (SELECT *, sum(new) OVER (PARTITION BY log_id ORDER BY s, e, id) AS run FROM n), m AS (SELECT log_id, min(s) AS s, max(e) AS e, string_agg(id, ',' ORDER BY id) AS members FROM g GROUP BY log_id, run)
    SELECT log_id, s AS "start", e AS "end", members, true AS flag, e - s + 1 AS length FROM m WHERE e - s + 1 >= 5""")
def q_final_motifs(spark, sf_dir):
    out = intervals.final_motifs(intervals.merge_overlaps(intervals.extend_by_anchors(*_ab(spark, sf_dir)).drop("members")))
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


BAND = "a AS (SELECT event_id AS pos, event_id * 7 % 5000 AS num FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS pos, event_id * 11 % 5000 AS num FROM events WHERE event_type = 'error')"


def _band(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pick = lambda kind, f: e.where(F.col("event_type") == kind).select(F.col("event_id").alias("pos"), (F.col("event_id") * f % 5000).alias("num"))
    return pick("purchase", 7), pick("error", 11)


@query("q_band_match", f"WITH {BAND}, p AS (SELECT a.pos AS a_pos, a.num AS a_num, b.num AS b_num, abs(a.num - b.num) AS accuracy, row_number() OVER (PARTITION BY a.pos ORDER BY b.pos) AS n FROM a JOIN b ON abs(a.num - b.num) <= 3) SELECT a_pos, a_num, b_num, accuracy FROM p WHERE n = 1")
def q_band_match(spark, sf_dir):
    return intervals.band_first(*_band(spark, sf_dir), 3)


@query("q_band_match_score", f"WITH {BAND}, p AS (SELECT a.num, b.num AS spot, 1 - abs(a.num - b.num) / 5 AS accuracy, row_number() OVER (PARTITION BY a.num ORDER BY abs(a.num - b.num), b.num) AS n FROM (SELECT DISTINCT num FROM a) a JOIN (SELECT DISTINCT num FROM b) b ON abs(a.num - b.num) <= 5) SELECT num, spot, accuracy FROM p WHERE n = 1")
def q_band_match_score(spark, sf_dir):
    return intervals.band_score(*_band(spark, sf_dir), 10)


@query("q_coverage_best", f"""WITH {MOTIFS}, {TRUTH}, p AS (SELECT m.log_id, motif_start AS "start", gt_id, CASE WHEN (gt_start >= motif_start AND gt_end <= motif_start + 8) OR (motif_start >= gt_start AND motif_start + 8 <= gt_end) THEN 1.0 ELSE CAST(least(motif_start + 8, gt_end) - greatest(motif_start, gt_start) AS DOUBLE) / 8 END AS coverage
      FROM (SELECT DISTINCT log_id, motif_start FROM motifs) m JOIN truth t ON m.log_id = t.log_id AND motif_start < gt_end AND gt_start < motif_start + 8 AND gt_start < gt_end),
    r AS (SELECT *, row_number() OVER (PARTITION BY log_id, "start" ORDER BY coverage DESC, gt_id) AS n FROM p) SELECT log_id, "start", gt_id, coverage FROM r WHERE n = 1 AND coverage >= 0.5""")
def q_coverage_best(spark, sf_dir):
    starts = type_motifs(spark, sf_dir).select("log_id", F.col("motif_start").alias("start"))
    return intervals.best_coverage(block_truth(spark, sf_dir), starts, 8)


# evaluation


@query("q_eval_metrics", f"""WITH RECURSIVE {OVERLAPS}, able AS (SELECT log_id, motif_id, gt_id, row_number() OVER (PARTITION BY log_id ORDER BY overlap DESC, motif_id, gt_id) AS n FROM pairs WHERE overlap / gt_length > 0.5),
    walk(log_id, n, ms, gs) AS (SELECT DISTINCT log_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM able
        UNION ALL SELECT w.log_id, w.n + 1, CASE WHEN list_contains(ms, motif_id) OR list_contains(gs, gt_id) THEN ms ELSE list_append(ms, motif_id) END,
               CASE WHEN list_contains(ms, motif_id) OR list_contains(gs, gt_id) THEN gs ELSE list_append(gs, gt_id) END FROM walk w JOIN able a ON a.log_id = w.log_id AND a.n = w.n + 1),
    tp AS (SELECT log_id, max(len(ms)) AS tp FROM walk GROUP BY log_id), m AS (SELECT log_id, count(*) AS motifs FROM motifs GROUP BY log_id), g AS (SELECT log_id, count(*) AS truths FROM truth GROUP BY log_id),
    om AS (SELECT log_id, motif_id, motif_length AS l, sum(overlap) AS o FROM pairs GROUP BY ALL), og AS (SELECT log_id, gt_id, gt_length AS l, sum(overlap) AS o FROM pairs GROUP BY ALL),
    a AS (SELECT log_id, avg(o) AS intersection_abs, avg(o / l) AS intersection_ratio, avg(l - o) AS over_detection_abs, avg(1 - o / l) AS over_detection_ratio FROM om GROUP BY log_id),
    b AS (SELECT log_id, avg(greatest(0, l - o)) AS undercount_abs, avg(greatest(0, 1 - o / l)) AS undercount_ratio FROM og GROUP BY log_id),
    s AS (SELECT log_id, coalesce(motifs, 0) AS motifs, coalesce(truths, 0) AS truths, coalesce(tp, 0) AS tp, coalesce(motifs, 0) - coalesce(tp, 0) AS fp, coalesce(truths, 0) - coalesce(tp, 0) AS fn FROM m FULL JOIN g USING (log_id) LEFT JOIN tp USING (log_id)),
    p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM s)
    SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1 FROM p LEFT JOIN a USING (log_id) LEFT JOIN b USING (log_id)""")
def q_eval_metrics(spark, sf_dir):
    return evaluation.evaluate_motifs(type_motifs(spark, sf_dir), block_truth(spark, sf_dir), 0.5)[0]


@query("q_eval_overlap_means", f"""WITH {OVERLAPS}, m AS (SELECT log_id, motif_id, motif_length, sum(overlap) AS o FROM pairs GROUP BY ALL), g AS (SELECT log_id, gt_id, gt_length, sum(overlap) AS o FROM pairs GROUP BY ALL),
    a AS (SELECT log_id, avg(o) AS intersection_abs, avg(motif_length - o) AS over_detection_abs FROM m GROUP BY log_id), b AS (SELECT log_id, avg(greatest(0, gt_length - o)) AS undercount_abs FROM g GROUP BY log_id)
    SELECT log_id, intersection_abs, over_detection_abs, undercount_abs FROM a JOIN b USING (log_id)""")
def q_eval_overlap_means(spark, sf_dir):
    out = evaluation.evaluate_motifs(type_motifs(spark, sf_dir), block_truth(spark, sf_dir), 0.5)[0]
    return out.where("intersection_abs IS NOT NULL").select("log_id", "intersection_abs", "over_detection_abs", "undercount_abs")


@query("q_join_discovery", f"""WITH {OVERLAPS}, best AS (SELECT log_id, motif_id, gt_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY log_id, gt_id ORDER BY overlap DESC, motif_id) AS n FROM pairs WHERE overlap > 0) WHERE n = 1),
    x AS (SELECT coalesce(b.log_id, t.log_id) AS log_id, coalesce(b.gt_id, t.gt_id) AS gt_id, motif_id, overlap, gt_start FROM best b FULL JOIN truth t ON b.log_id = t.log_id AND b.gt_id = t.gt_id)
    SELECT coalesce(x.log_id, m.log_id) AS log_id, coalesce(x.motif_id, m.motif_id) AS motif_id, gt_id, overlap, gt_start, motif_start FROM x FULL JOIN motifs m ON x.log_id = m.log_id AND x.motif_id = m.motif_id""")
def q_join_discovery(spark, sf_dir):
    m, t = type_motifs(spark, sf_dir), block_truth(spark, sf_dir)
    best = intervals.overlap_table(m, t).where("is_best_match")
    return evaluation.join_discovery(best, t, m).select("log_id", "motif_id", "gt_id", "overlap", "gt_start", "motif_start")


LABELLED = "lab AS (SELECT event_id, user_id % 20 AS cluster_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS case_id, CASE WHEN event_id % 7 <> 0 THEN event_id % 5 END AS motif_id, event_id % 90 AS total_occurrences FROM events)"


def _labelled(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (F.col("user_id") % 20).alias("cluster_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("case_id"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5).alias("motif_id"), (F.col("event_id") % 90).alias("total_occurrences"))


SCORES = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"
F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"


@query("q_purity", f"WITH {LABELLED}, n AS (SELECT cluster_id, case_id, count(*) AS n FROM lab GROUP BY ALL) SELECT cluster_id, max(n) / sum(n) AS purity, CAST(sum(n) AS BIGINT) AS size FROM n GROUP BY cluster_id")
def q_purity(spark, sf_dir):
    return evaluation.purity(_labelled(spark, sf_dir), "cluster_id", "case_id")


@query("q_cluster_metrics", f"WITH {LABELLED}, c AS (SELECT cluster_id, count(case_id) AS tp, count(*) - count(case_id) AS fp, coalesce(max(total_occurrences) FILTER (case_id IS NOT NULL), 0) AS required FROM lab GROUP BY cluster_id), d AS (SELECT *, greatest(required - tp, 0) AS fn FROM c), e AS (SELECT *, {SCORES} FROM d) SELECT *, {F1} FROM e")
def q_cluster_metrics(spark, sf_dir):
    return evaluation.cluster_metrics(_labelled(spark, sf_dir))


@query("q_motif_metrics", f"""WITH {LABELLED}, t AS (SELECT motif_id, count(*) AS tp, max(total_occurrences) AS required FROM lab WHERE motif_id IS NOT NULL GROUP BY motif_id),
    f AS (SELECT m.motif_id, count(*) AS fp FROM (SELECT DISTINCT motif_id, cluster_id FROM lab WHERE motif_id IS NOT NULL) m JOIN lab l ON l.cluster_id = m.cluster_id AND l.motif_id IS DISTINCT FROM m.motif_id GROUP BY m.motif_id),
    d AS (SELECT motif_id, tp, required, coalesce(fp, 0) AS fp, greatest(required - tp, 0) AS fn FROM t LEFT JOIN f USING (motif_id)), e AS (SELECT *, {SCORES} FROM d)
    SELECT CAST(motif_id AS VARCHAR) AS motif_id, tp, required, CAST(fp AS BIGINT) AS fp, fn, precision, recall, {F1} FROM e UNION ALL SELECT 'UNMAPPED', count(*) FILTER (motif_id IS NULL), NULL, NULL, NULL, NULL, NULL, NULL FROM lab""")
def q_motif_metrics(spark, sf_dir):
    return evaluation.motif_metrics(_labelled(spark, sf_dir))


# reports


def _results(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 11).alias("total_tp"), (F.col("o_custkey") % 5).alias("total_fp"), (F.col("o_orderkey") % 3).alias("total_fn"), "o_totalprice")


RESULTS = "res AS (SELECT o_orderpriority, o_orderstatus, o_orderkey % 11 AS total_tp, o_custkey % 5 AS total_fp, o_orderkey % 3 AS total_fn, o_totalprice FROM orders)"
SUMS = "CAST(sum(total_tp) AS BIGINT) AS total_tp, CAST(sum(total_fp) AS BIGINT) AS total_fp, CAST(sum(total_fn) AS BIGINT) AS total_fn"
TOTAL_SCORES = "CASE WHEN total_tp + total_fp > 0 THEN total_tp / (total_tp + total_fp) ELSE 0 END AS precision, CASE WHEN total_tp + total_fn > 0 THEN total_tp / (total_tp + total_fn) ELSE 0 END AS recall"


@query("q_pivot_metrics", f"WITH {RESULTS}, s AS (SELECT o_orderpriority, {SUMS}, count(total_tp) AS \"count\" FROM res GROUP BY o_orderpriority), e AS (SELECT *, {TOTAL_SCORES} FROM s) SELECT *, {F1} FROM e")
def q_pivot_metrics(spark, sf_dir):
    return reports.pivot_with_count(_results(spark, sf_dir), "o_orderpriority")


@query("q_grouping_sets_metrics", f"WITH {RESULTS}, s AS (SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'o_orderstatus' END AS index_name, coalesce(o_orderpriority, o_orderstatus) AS index_value, {SUMS} FROM res GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))), e AS (SELECT *, {TOTAL_SCORES} FROM s) SELECT *, {F1} FROM e")
def q_grouping_sets_metrics(spark, sf_dir):
    return reports.grouping_sets(_results(spark, sf_dir), ["o_orderpriority", "o_orderstatus"])


@query("q_overall", f"WITH {RESULTS}, s AS (SELECT {SUMS} FROM res), e AS (SELECT *, {TOTAL_SCORES} FROM s) SELECT *, {F1} FROM e")
def q_overall(spark, sf_dir):
    return reports.overall(_results(spark, sf_dir))


PER_PART = "pp AS (SELECT l_partkey, sum(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY l_partkey)"


def _per_part(spark, sf_dir) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))


@query("q_corr", f"WITH {PER_PART}, r AS (SELECT q, p, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS rq, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rp FROM pp) SELECT count(*) AS n, round(corr(q, p), 9) AS pearson, round(corr(rq, rp), 9) AS spearman FROM r")
def q_corr(spark, sf_dir):
    out = reports.correlations(_per_part(spark, sf_dir).withColumn("p", F.col("p")), "q", "p")
    return out.select("n", F.round("pearson", 9).alias("pearson"), F.round("spearman", 9).alias("spearman"))


@query("q_hist_bins", f"WITH {OVERLAPS}, h AS (SELECT CAST(greatest(ceil(round(overlap / gt_length * 10, 9)), 1) AS INT) AS bin, count(*) AS \"count\" FROM pairs GROUP BY 1) SELECT bin, \"count\", 100 * \"count\" / sum(\"count\") OVER () AS percent FROM h")
def q_hist_bins(spark, sf_dir):
    return reports.histogram(intervals.overlap_table(type_motifs(spark, sf_dir), block_truth(spark, sf_dir)), "overlap_gt_ratio")


@query("q_qcut_bins", f"WITH {PER_PART}, e AS (SELECT list_distinct(quantile_cont(q, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS edges FROM pp) SELECT l_partkey, CAST(greatest(len(list_filter(edges, lambda x: x < q)), 1) AS INT) AS bin FROM pp, e")
def q_qcut_bins(spark, sf_dir):
    return reports.quantile_bins(_per_part(spark, sf_dir), "q").select("l_partkey", "bin")


@query("q_density_quantiles", f"WITH {DENSITY} SELECT log_id, quantile_cont(rule_density_count, 0.25) AS p25, quantile_cont(rule_density_count, 0.5) AS p50, quantile_cont(rule_density_count, 0.75) AS p75, quantile_cont(rule_density_count, 0.9) AS p90, quantile_cont(rule_density_count, 0.99) AS p99 FROM density GROUP BY log_id")
def q_density_quantiles(spark, sf_dir):
    return reports.density_quantiles(dense_log(spark, sf_dir))


@query("q_density_distribution", f"""WITH {DENSITY}, n AS (SELECT log_id, rule_density_count AS "value", count(*) AS "count" FROM density GROUP BY ALL)
    SELECT *, CAST(sum("count") OVER (PARTITION BY log_id ORDER BY "value") AS BIGINT) AS cumulative, sum("count") OVER (PARTITION BY log_id ORDER BY "value") / sum("count") OVER (PARTITION BY log_id) AS share FROM n""")
def q_density_distribution(spark, sf_dir):
    return reports.density_distribution(dense_log(spark, sf_dir))


@query("q_density_variance", f"WITH {DENSITY} SELECT log_id, var_samp(rule_density_count) AS grammar_variance FROM density GROUP BY log_id")
def q_density_variance(spark, sf_dir):
    return dense_log(spark, sf_dir).groupBy("log_id").agg(F.var_samp("rule_density_count").alias("grammar_variance"))


@query("q_group_means", "SELECT o_orderstatus, avg(o_totalprice) AS mean_o_totalprice FROM orders GROUP BY o_orderstatus")
def q_group_means(spark, sf_dir):
    return reports.group_means(_results(spark, sf_dir), "o_orderstatus", "o_totalprice")


@query("q_latex_report")
def q_latex_report(spark, sf_dir):
    return reports.latex_definitions(reports.pivot_with_count(_results(spark, sf_dir), "o_orderstatus"), "o_orderstatus", "orders")


@query("q_cov_stats")
def q_cov_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "vector")
    stats = reports.covariance_stats(e)
    return spark.createDataFrame([tuple(stats.values())], ", ".join(f"{k} double" for k in stats))


# features and motifs


def _levels(spark, sf_dir) -> DataFrame:
    """A two-level path of each event as codes by first appearance, for the first twelve logs."""
    log = event_log(spark, sf_dir).withColumn("path", scalars.level_path([["event_type"], ["k"]]))
    return features.level_codes(log, "path")


@query("q_level_codes", f"""WITH {LOG}, a AS (SELECT log_id, event_type, row_number() OVER (PARTITION BY log_id ORDER BY min(event_index)) - 1 AS x FROM log GROUP BY log_id, event_type), b AS (SELECT log_id, k, row_number() OVER (PARTITION BY log_id ORDER BY min(event_index)) - 1 AS y FROM log GROUP BY log_id, k)
    SELECT log_id, event_index, x || ',' || y AS levels FROM log JOIN a USING (log_id, event_type) JOIN b USING (log_id, k)""")
def q_level_codes(spark, sf_dir):
    return _levels(spark, sf_dir).select("log_id", "event_index", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))


HIER = f"{LOG}, v AS (SELECT DISTINCT log_id, event_type, k FROM log), cost AS (SELECT a.log_id, a.event_type || a.k AS a, b.event_type || b.k AS b, CASE WHEN a.event_type <> b.event_type THEN 2.0 * (1 - (CASE WHEN a.k = b.k THEN 1 ELSE 0 END) / 3) ELSE 0.0 END + CASE WHEN a.k <> b.k THEN 1.0 ELSE 0.0 END AS cost FROM v a JOIN v b ON a.log_id = b.log_id)"


@query("q_hier_distance", f"WITH {HIER} SELECT log_id, a, b, cost FROM cost")
def q_hier_distance(spark, sf_dir):
    v = event_log(spark, sf_dir).select("log_id", F.concat("event_type", F.col("k").cast("string")).alias("symbol_id"), F.array(F.xxhash64("event_type"), "k").alias("levels")).distinct()
    return features.cost_matrix(v, features.hierarchy_weights(2))


@query("q_group_distance", f"""WITH {LOG}, g AS MATERIALIZED (SELECT log_id, event_index // 10 AS g, event_index % 10 AS o, event_type, k FROM log)
    SELECT a.log_id, a.g AS g1, b.g AS g2, avg(CASE WHEN a.event_type <> b.event_type THEN 2.0 * (1 - (CASE WHEN a.k = b.k THEN 1 ELSE 0 END) / 3) ELSE 0.0 END + CASE WHEN a.k <> b.k THEN 1.0 ELSE 0.0 END) AS distance FROM g a JOIN g b ON a.log_id = b.log_id AND a.o = b.o AND a.g <= b.g GROUP BY 1, 2, 3""")
def q_group_distance(spark, sf_dir):
    g = event_log(spark, sf_dir).select("log_id", F.floor(F.col("event_index") / 10).alias("group_id"), (F.col("event_index") % 10).alias("ordinal"), F.array(F.xxhash64("event_type"), "k").alias("levels"))
    return features.group_distances(g, features.hierarchy_weights(2))


@query("q_matrix_profile", f"""WITH {LOG}, d AS (SELECT a.log_id, a.event_index AS i, b.event_index AS j, CASE WHEN a.event_type <> b.event_type THEN 2.0 * (1 - (CASE WHEN a.k = b.k THEN 1 ELSE 0 END) / 3) ELSE 0.0 END + CASE WHEN a.k <> b.k THEN 1.0 ELSE 0.0 END AS c FROM log a JOIN log b ON a.log_id = b.log_id),
    w AS (SELECT log_id, i, j, avg(c) OVER p AS m, count(*) OVER p AS n FROM d WINDOW p AS (PARTITION BY log_id, j - i ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
    SELECT log_id, i, round(min(m), 9) AS distance FROM w WHERE n = 8 AND abs(i - j) > 2 GROUP BY log_id, i""")
def q_matrix_profile(spark, sf_dir):
    out = motifs.matrix_profile(_levels(spark, sf_dir), features.hierarchy_weights(2), 8)
    return out.where("neighbours[0] >= 0").select("log_id", "i", F.round(F.get("distances", F.lit(0)), 9).alias("distance"))


@query("q_join_profile", f"""WITH {LOG}, d AS (SELECT a.log_id, a.event_index AS i, b.event_index AS j, CASE WHEN a.event_type <> b.event_type THEN 2.0 * (1 - (CASE WHEN a.k = b.k THEN 1 ELSE 0 END) / 3) ELSE 0.0 END + CASE WHEN a.k <> b.k THEN 1.0 ELSE 0.0 END AS c FROM log a JOIN log b ON b.log_id = a.log_id + 1 WHERE a.log_id % 2 = 0),
    w AS (SELECT log_id, i, j, avg(c) OVER p AS m, count(*) OVER p AS n FROM d WINDOW p AS (PARTITION BY log_id, j - i ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    r AS (SELECT log_id, i, round(m, 9) AS m, row_number() OVER (PARTITION BY log_id, i ORDER BY m) AS n FROM w WHERE n = 8)
    SELECT log_id, i, max(m) FILTER (n = 1) AS first, max(m) FILTER (n = 2) AS second FROM r GROUP BY log_id, i""")
def q_join_profile(spark, sf_dir):
    """Each window of an even log among those of the next log, two neighbours each."""
    log = event_log(spark, sf_dir).select("log_id", "event_index", F.array(F.xxhash64("event_type"), "k").alias("levels"))  # codes of one log mean nothing in another
    other = log.where("log_id % 2 = 1").withColumn("log_id", F.col("log_id") - 1)
    out = motifs.join_profile(log.where("log_id % 2 = 0"), other, features.hierarchy_weights(2), 8, 2)
    place = lambda i: F.get("distances", F.lit(i))
    return out.select("log_id", "i", F.round(place(0), 9).alias("first"), F.round(F.when(place(1) != float("inf"), place(1)), 9).alias("second"))


@query("q_profile_smallest")
def q_profile_smallest(spark, sf_dir):
    return motifs.smallest(motifs.matrix_profile(_levels(spark, sf_dir), features.hierarchy_weights(2), 8), 5)


@query("q_topk_exclusion")
def q_topk_exclusion(spark, sf_dir):
    return motifs.profile_motifs(_levels(spark, sf_dir), features.hierarchy_weights(2), 8)


PAN = " UNION ALL ".join(f"""SELECT log_id, {m} AS m, i, round(min(a), 9) AS distance FROM (SELECT log_id, i, j, avg(c) OVER p AS a, count(*) OVER p AS n FROM d WINDOW p AS (PARTITION BY log_id, j - i ORDER BY i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING))
    WHERE n = {m} AND abs(i - j) > {-(-m // 4)} GROUP BY log_id, i""" for m in range(5, 10))


def _pan(spark, sf_dir) -> DataFrame:
    return motifs.pan_profile(_levels(spark, sf_dir), features.hierarchy_weights(2), 5, 9)


@query("q_pan_profile", f"""WITH {LOG}, d AS (SELECT a.log_id, a.event_index AS i, b.event_index AS j, CASE WHEN a.event_type <> b.event_type THEN 2.0 * (1 - (CASE WHEN a.k = b.k THEN 1 ELSE 0 END) / 3) ELSE 0.0 END + CASE WHEN a.k <> b.k THEN 1.0 ELSE 0.0 END AS c FROM log a JOIN log b ON a.log_id = b.log_id) {PAN}""")
def q_pan_profile(spark, sf_dir):
    return _pan(spark, sf_dir).where("neighbour >= 0").select("log_id", "m", "i", F.round("distance", 9).alias("distance"))


@query("q_pan_motifs")
def q_pan_motifs(spark, sf_dir):
    return motifs.pan_motifs(_pan(spark, sf_dir).select("log_id", "m", "i", "distance", "neighbour"))


def _label_series(spark, sf_dir) -> DataFrame:
    """embeddings as series, one for each label, in the order of vec_id."""
    order = Window.partitionBy("label").orderBy("vec_id")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("label").cast("long").alias("log_id"), (F.row_number().over(order) - F.lit(1).cast("long")).alias("event_index"), F.col("embedding").alias("vector"))


@query("q_vector_profile")
def q_vector_profile(spark, sf_dir):
    return motifs.vector_profile(_label_series(spark, sf_dir), 6)


@query("q_vector_motifs")
def q_vector_motifs(spark, sf_dir):
    return motifs.vector_motifs(_label_series(spark, sf_dir), 6)


def _numbered(spark, sf_dir) -> DataFrame:
    """Events as short vectors."""
    log = event_log(spark, sf_dir)
    hot = [(F.col("event_type") == t).cast("double") for t in ("click", "error", "purchase", "signup", "view")]
    return log.withColumn("vector", F.array(*hot, F.col("k").cast("double") / 2))


@query("q_motif_sets")
def q_motif_sets(spark, sf_dir):
    return motifs.motif_sets(_numbered(spark, sf_dir), 5, 20, 0.8)


@query("q_w2v_embed")
def q_w2v_embed(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return features.embed_rows(log, ["event_type", "k"]).select("log_id", "event_index", "vector")


@query("q_w2v_sequence")
def q_w2v_sequence(spark, sf_dir):
    return features.embed_sequence(event_log(spark, sf_dir), ["event_type", "k"], size=8).select("log_id", "event_index", "vector")


@query("q_cooccurrence_code")
def q_cooccurrence_code(spark, sf_dir):
    return features.encode_cooccurrence_columns(event_log(spark, sf_dir), ["event_type", "k"], 2).select("log_id", "event_index", "code")


TYPE_MEANS = ", ".join(f"avg(CAST(event_type = '{t}' AS DOUBLE)) AS m{i}" for i, t in enumerate(("click", "error", "purchase", "signup", "view"))) + ", avg(CAST(k AS DOUBLE) / 2) AS m5"
TYPE_SCALED = ", ".join(f"CASE WHEN stddev_pop(m{i}) OVER l > 0 THEN (m{i} - avg(m{i}) OVER l) / stddev_pop(m{i}) OVER l ELSE 0 END AS m{i}" for i in range(6))


@query("q_motif_cluster", f"""WITH RECURSIVE {WINDOWS}, means AS (SELECT log_id, s, {TYPE_MEANS} FROM kept JOIN log USING (log_id) WHERE event_index BETWEEN s AND s + 9 GROUP BY log_id, s HAVING count(*) = 10),
    z AS (SELECT log_id, s, {TYPE_SCALED} FROM means WINDOW l AS (PARTITION BY log_id)),
    near AS (SELECT a.log_id, a.s AS a, b.s AS b FROM z a JOIN z b ON a.log_id = b.log_id AND a.s <> b.s AND sqrt({" + ".join(f"(a.m{i} - b.m{i}) * (a.m{i} - b.m{i})" for i in range(6))}) <= 1.2),
    reach(log_id, id, root) AS (SELECT log_id, s, s FROM z UNION SELECT r.log_id, n.b, r.root FROM reach r JOIN near n ON n.log_id = r.log_id AND n.a = r.id),
    parts AS (SELECT log_id, id, min(root) AS label FROM reach GROUP BY log_id, id),
    named AS (SELECT log_id, label, row_number() OVER (PARTITION BY log_id ORDER BY label) - 1 AS c FROM parts GROUP BY log_id, label HAVING count(*) > 1)
    SELECT log_id, id AS window_start, CAST(coalesce(c, -1) AS INTEGER) AS cluster FROM parts LEFT JOIN named USING (log_id, label)""")
def q_motif_cluster(spark, sf_dir):
    log = _numbered(spark, sf_dir)
    return clusters.cluster_windows(sequence.window_means(log, _starts(log), 10))


# micro-tasks


def _tasks(spark, sf_dir) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("is_boundary", F.col("event_type") == "purchase").withColumn("case_id", F.floor(F.col("event_index") / 20))
    return mining.micro_tasks(log, "event_type")


TASKS = LOG + ", b AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY event_index) AS segment FROM log), tasks AS (SELECT log_id, CAST(segment AS BIGINT) AS segment, min(event_index) AS start_index, max(event_index) AS end_index, arg_min(event_index // 20, event_index) AS case_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM b GROUP BY log_id, segment)"


@query("q_microtasks", f"WITH {TASKS} SELECT * FROM tasks")
def q_microtasks(spark, sf_dir):
    return _tasks(spark, sf_dir).withColumn("items", F.array_join("items", ","))


@query("q_tasks_per_case", f"WITH {TASKS} SELECT log_id, case_id, string_agg(DISTINCT items, ';' ORDER BY items) AS tasks FROM tasks GROUP BY log_id, case_id HAVING count(*) >= 2")
def q_tasks_per_case(spark, sf_dir):
    return mining.tasks_per_case(_tasks(spark, sf_dir)).withColumn("tasks", F.array_join("tasks", ";"))


@query("q_frequent_itemsets", f"""WITH {TASKS}, i AS (SELECT log_id, segment, unnest(string_split(items, ',')) AS item FROM tasks), n AS (SELECT count(*) AS n FROM tasks),
    u AS (SELECT DISTINCT item FROM i), t AS (SELECT *, row_number() OVER (ORDER BY item) - 1 AS b FROM u),
    sets AS (SELECT m, array_to_string(list(item ORDER BY item), ',') AS items, count(*) AS size FROM t, (SELECT unnest(range(1, CAST(pow(2, count(*)) AS BIGINT))) AS m FROM u) WHERE (m >> b) & 1 = 1 GROUP BY m),
    own AS (SELECT log_id, segment, CAST(sum(1 << b) AS BIGINT) AS mask FROM i JOIN t USING (item) GROUP BY log_id, segment), s AS (SELECT items, count(*) AS freq FROM sets JOIN own ON (mask & m) = m GROUP BY items)
    SELECT items, freq, freq / n AS support FROM s, n WHERE freq >= ceil(0.05 * n)""")
def q_frequent_itemsets(spark, sf_dir):
    found = mining.frequent_itemsets(_tasks(spark, sf_dir).select("items"), "items", 0.05)
    return found.withColumn("items", F.array_join("items", ","))


@query("q_task_vectors")
def q_task_vectors(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return mining.feature_vectors(_tasks(spark, sf_dir), mining.vocabulary(log, "event_type")).select("log_id", "segment", "vector")


# synthesis


@query("q_random_log")
def q_random_log(spark, sf_dir):
    return synthesis.random_log(event_log(spark, sf_dir), 50)


@query("q_shuffle_share", f"WITH {LOG} SELECT log_id, count(*) AS n, CAST(sum(event_index) AS BIGINT) AS places, round(sum(value), 6) AS total, CAST(floor(count(*) * 0.2) AS BIGINT) AS most_moved, true AS moved, array_to_string(list_sort(list(event_type || '|' || coalesce(CAST(k AS VARCHAR), '') || '|' || CAST(epoch_us(ts) AS VARCHAR))), ',') AS rows FROM log GROUP BY log_id")
def q_shuffle_share(spark, sf_dir):
    """The rows of each log are those that were there, and places 0 to n - 1 are each taken once; some rows, at most a fifth, are at other places."""
    before = event_log(spark, sf_dir)
    log = synthesis.shuffle_share(before, 0.2)
    row = F.concat_ws("|", "event_type", F.coalesce(F.col("k").cast("string"), F.lit("")), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    facts = log.groupBy("log_id").agg(F.count("*").alias("n"), F.sum_distinct(F.col("event_index").cast("long")).alias("places"), F.round(F.sum("value"), 6).alias("total"), F.array_join(F.sort_array(F.collect_list(row)), ",").alias("rows"))
    old = before.select("log_id", F.col("event_index").cast("long").alias("event_index"), F.struct("event_type", "k", "ts", "value").alias("old"))
    other = log.join(old, ["log_id", "event_index"]).where(~F.struct("event_type", "k", "ts", "value").eqNullSafe(F.col("old"))).groupBy("log_id").agg(F.count("*").alias("other"))
    most = F.floor(F.col("n") * 0.2)
    return facts.join(other, "log_id", "left").select("log_id", "n", "places", "total", most.alias("most_moved"), (F.coalesce("other", F.lit(0)).between(1, most) | (most < 2)).alias("moved"), "rows")


@query("q_remove_percent", f"WITH {LOG} SELECT log_id, count(*) - CAST(floor(count(*) * 0.1) AS BIGINT) AS n, count(*) - CAST(floor(count(*) * 0.1) AS BIGINT) AS kept, count(*) - CAST(floor(count(*) * 0.1) AS BIGINT) - 1 AS last_index, true AS in_order FROM log GROUP BY log_id")
def q_remove_percent(spark, sf_dir):
    """What is left are rows of the log, in their order, with places from 0 without a gap."""
    before = event_log(spark, sf_dir)
    log = synthesis.remove_percent(before, 10)
    old = before.select("log_id", "ts", "event_type", "value", F.col("event_index").alias("old"))
    found = log.join(old, ["log_id", "ts", "event_type", "value"]).groupBy("log_id", "event_index").agg(F.min("old").alias("old"))
    step = F.lag("old").over(Window.partitionBy("log_id").orderBy("event_index"))
    found = found.withColumn("ahead", F.coalesce(F.col("old") >= step, F.lit(True)))
    ordered = found.groupBy("log_id").agg(F.count("*").alias("kept"), F.max("event_index").alias("last_index"), F.min("ahead").alias("in_order"))
    return log.groupBy("log_id").agg(F.count("*").alias("n")).join(ordered, "log_id")


def _planted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    types = ["click", "view", "purchase", "error", "signup", "view", "click", "error"]
    m = spark.createDataFrame([(n, i, types[(i * (n + 1)) % 8], float(n)) for n in range(2) for i in range(8)], "motif_number int, seq long, event_type string, value double")
    return synthesis.plant_motifs(event_log(spark, sf_dir), m, 3)


@query("q_plant_motifs", f"""WITH {LOG}, n AS (SELECT log_id, count(*) + 48 AS log_length, string_agg(event_type, ',' ORDER BY event_index) AS noise FROM log GROUP BY log_id) SELECT log_id, log_length, 2 AS motifs, 6 AS occurrences, 100 * 48 / log_length AS motif_percent, noise,
    '0:8:click,view,purchase,error,signup,view,click,error;1:8:click,purchase,signup,click,click,purchase,signup,click' AS planted FROM n""")
def q_plant_motifs(spark, sf_dir):
    """Beside the catalogue the noise, in its order, and what every occurrence, without a gap, consists of."""
    out, truth = _planted(spark, sf_dir)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "event_type"))), lambda x: x["event_type"]), ",")
    noise = out.where("NOT inserted").groupBy("log_id").agg(text.alias("noise"))
    each = out.where("inserted").groupBy("log_id", "motif_number", "occurrence").agg((F.max("event_index") - F.min("event_index") + 1).alias("span"), text.alias("events"))
    planted = each.groupBy("log_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "motif_number", "span", "events"))), ";").alias("planted"))
    return synthesis.catalogue(truth, out).join(noise, "log_id").join(planted, "log_id")


@query("q_truth_by_markers", f"""WITH {LOG}, b AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM log)
    SELECT log_id, CAST(c AS BIGINT) AS case_number, min(event_index) AS start_index, count(*) AS length, CASE WHEN count(*) > 10 THEN 'RT' ELSE 'SR' END AS motif FROM b GROUP BY log_id, c HAVING bool_or(event_type = 'signup')""")
def q_truth_by_markers(spark, sf_dir):
    return synthesis.truth_by_markers(event_log(spark, sf_dir), F.col("event_type") == "signup", 10)


@query("q_label_tasks", f"WITH {LOG} SELECT log_id, event_index, CASE WHEN k = 0 THEN 'zero' WHEN event_type = 'click' THEN 'click' ELSE '' END AS task FROM log")
def q_label_tasks(spark, sf_dir):
    return synthesis.label_tasks(event_log(spark, sf_dir), [(F.col("event_type") == "click", "click"), (F.col("k") == 0, "zero")]).select("log_id", "event_index", "task")


# whole pipelines


@query("q_discover")
def q_discover(spark, sf_dir):
    """The whole discovery over all logs at once, against planted motifs."""
    out, truth = _planted(spark, sf_dir)
    truth = truth.select("log_id", (F.row_number().over(Window.partitionBy("log_id").orderBy("start_index")) - 1).cast("long").alias("gt_id"), F.col("start_index").alias("gt_start"), F.col("end_index").alias("gt_end"))
    return discover(out.select("log_id", "event_index", "event_type", "k"), truth, ["event_type", "k"], ["event_type"])


@query("q_variance_study")
def q_variance_study(spark, sf_dir):
    return variance_study(event_log(spark, sf_dir), ["event_type", "k"])
