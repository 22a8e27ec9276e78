"""Registered queries look at whole inputs: small tables with logs longer, or vectors wider, than any fixed bound."""

import datetime
import itertools
import math

import duckdb
import numpy as np
import pytest

from rutine.operators import motifs
from rutine.registry import LOG, QUERIES

TYPES = ("click", "error", "purchase", "signup", "view")


@pytest.fixture
def tables(spark, tmp_path):
    """Writes events, a list of (event type, number) for each user, and returns the folder."""

    def write(*users) -> str:
        start = datetime.datetime(2024, 1, 1)
        rows = [(u * 1000 + i, start + datetime.timedelta(minutes=i), u, t, float(i * i % 17), f'{{"k": {k}}}') for u, events in enumerate(users) for i, (t, k) in enumerate(events)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)

    return write


def same(spark, name: str, folder: str, sql: str) -> list:
    """The query's rows, which must be those of sql over the whole input."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted(tuple(plain(x[c]) for c in names) for x in QUERIES[name](spark, folder).collect())
    assert got == sorted(tuple(plain(v) for v in x) for x in found.fetchall())
    return got


def mixed(n: int) -> list:
    return [(TYPES[i * i % 5], i * 7 % 11 % 3) for i in range(n)]


def test_motif_sets_after_event_60(spark, tables):
    events = [(TYPES[i * i % 5], i * 7 % 11 % 3) for i in range(64)]
    routine = [(TYPES[i % 5], i % 3) for i in range(15)]
    found = QUERIES["q_motif_sets"](spark, tables(events + routine + events[:3] + routine)).collect()
    assert max(x.end for x in found) > 80


def test_group_distances_of_all_groups(spark, tables):
    sql = f"""WITH {LOG}, g AS (SELECT log_id, event_index // 10 AS g, event_index % 10 AS o, event_type, k FROM log)
        SELECT a.log_id, a.g AS g1, b.g AS g2, avg(CASE WHEN a.event_type <> b.event_type THEN 2.0 * (1 - (CASE WHEN a.k = b.k THEN 1 ELSE 0 END) / 3) ELSE 0.0 END + CASE WHEN a.k <> b.k THEN 1.0 ELSE 0.0 END) AS distance
        FROM g a JOIN g b ON a.log_id = b.log_id AND a.o = b.o AND a.g <= b.g GROUP BY 1, 2, 3"""
    assert len(same(spark, "q_group_distance", tables(mixed(87), mixed(12)), sql)) == 9 * 10 // 2 + 3


def test_vector_profile_of_all_dimensions(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(30, 9)).astype("float32")
    rows = [(i, 1, v) for i, v in enumerate(x.tolist())]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["q_vector_profile"](spark, str(tmp_path)).orderBy("i").collect()
    distances, neighbours = motifs.series_profile(x.astype(float), 6)
    assert np.allclose([r.distances for r in found], distances.T) and len(found[0].distances) == 9
    assert [r.neighbours for r in found] == neighbours.T.tolist()


WINDOWS = LOG + """, ends AS (SELECT log_id, max(event_index) AS n FROM log GROUP BY log_id), starts AS (SELECT log_id, unnest(range(0, n + 1, 7)) AS s FROM ends),
    kept AS (SELECT log_id, s, row_number() OVER (PARTITION BY log_id ORDER BY s) - 1 AS c FROM starts)"""


def test_windows_cover_whole_logs(spark, tables):
    folder = tables(mixed(95), mixed(23))
    rows = same(spark, "q_window_extract", folder, f"WITH {WINDOWS} SELECT log_id, s AS window_start, CAST(c AS VARCHAR) AS case_number, event_index, event_type FROM kept JOIN log USING (log_id) WHERE event_index BETWEEN s AND s + 9")
    assert {x[3] for x in rows if x[0] == 0} == set(range(95))
    same(spark, "q_window_mean", folder, f"WITH {WINDOWS} SELECT log_id, s AS window_start, avg(value) AS mean_value, avg(CAST(k AS DOUBLE)) AS mean_k FROM kept JOIN log USING (log_id) WHERE event_index BETWEEN s AND s + 9 GROUP BY log_id, s HAVING count(*) = 10")
    clustered = {(x.log_id, x.window_start) for x in QUERIES["q_motif_cluster"](spark, folder).collect()}
    assert clustered == {(0, s) for s in range(0, 86, 7)} | {(1, 0), (1, 7)}


def test_patterns_of_whole_logs(spark, tables):
    sql = f"""WITH {LOG}, spans AS (SELECT log_id, unnest(range(0, max(event_index) + 1, 12)) AS s FROM log GROUP BY log_id),
        w AS (SELECT log_id, s, string_agg(event_type, ' -1 ' ORDER BY event_index) || ' -1 -2' AS line FROM spans JOIN log USING (log_id) WHERE event_index BETWEEN s AND s + 2 GROUP BY log_id, s)
        SELECT log_id, line, min(s) AS first_index FROM w GROUP BY log_id, line"""
    late = [("error", 0), ("signup", 0), ("error", 0)]
    rows = same(spark, "q_pattern_text", tables([("view", 0)] * 84 + late), sql)
    assert (0, "error -1 signup -1 error -1 -2", 84) in rows


def test_itemsets_of_all_sizes(spark, tables):
    events = [(t, 0) for n in range(3) for t in ("purchase", *TYPES[:2], *TYPES[3:])] + [("purchase", 0), ("view", 0)] + mixed(40)
    folder = tables(events, mixed(33))
    tasks = [set(x["items"].split(",")) for x in QUERIES["q_microtasks"](spark, folder).collect()]
    least = math.ceil(0.05 * len(tasks))
    want = {}
    for n in range(1, 6):
        for items in itertools.combinations(TYPES, n):
            freq = sum(set(items) <= t for t in tasks)
            if freq >= least:
                want[",".join(items)] = (freq, freq / len(tasks))
    assert {len(x.split(",")) for x in want} == {1, 2, 3, 4, 5}
    assert {x["items"]: (x.freq, x.support) for x in QUERIES["q_frequent_itemsets"](spark, folder).collect()} == want
