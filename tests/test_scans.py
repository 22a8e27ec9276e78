"""Numbering and running values over blocks, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rutine.operators import grammar, intervals, scans, sequence


def test_numbered(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(40)]), i) for i in range(3000)] + [("hot", r.randrange(10**6), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, t int, i int").repartition(3)
    got = scans.numbered(df, ["k"], ["t", "i"], parts=7).collect()
    want, seen = {}, {}
    for k, t, i in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        want[(k, t, i)] = seen[k] = seen.get(k, -1) + 1
    assert {(x.k, x.t, x.i): x.place for x in got} == want and len(got) == len(rows)
    assert scans.numbered(df.limit(0), ["k"], ["t"]).count() == 0


@pytest.mark.parametrize(("block", "itself"), [(3, True), (5, False), (1000, True)])
def test_running(spark, block, itself):
    r = random.Random(block)
    at = {k: r.sample(range(-60, 60), 40) for k in ("a", None)}
    rows = [(k, t, r.choice([None, None, r.randrange(-9, 9)])) for k, ts in at.items() for t in ts]
    df = spark.createDataFrame(rows, "k string, t int, v long").repartition(3)
    values = {kind: (kind, F.col("v")) for kind in ("sum", "max", "min", "count", "last")}
    got = {(x.k, x.t): x for x in scans.running(df, ["k"], "t", values, block, itself).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        v = [x for kk, tt, x in sorted(rows, key=lambda x: x[1]) if kk == k and (tt < t or (itself and tt == t)) and x is not None]
        x = got[(k, t)]
        assert (x["sum"], x["max"], x["min"], x["count"], x["last"]) == (sum(v) if v else None, max(v, default=None), min(v, default=None), len(v), v[-1] if v else None)


@pytest.fixture
def blocks_of_four(monkeypatch):
    for module in (scans, sequence, grammar):
        monkeypatch.setattr(module, "BLOCK", 4)
    for f in (scans.running, scans.beside):
        monkeypatch.setattr(f, "__defaults__", tuple(4 if d == 1 << 14 else d for d in f.__defaults__))


def as_rows(df):
    return sorted((tuple(str(x[c]) for c in sorted(df.columns)) for x in df.collect()))


def test_long_logs_give_what_short_ones_give(spark, blocks_of_four):
    r = random.Random(12)
    raw = [[r.choice("ABCD"[:k]) for _ in range(n)] for k, n in ((2, 60), (3, 41), (4, 30), (1, 19), (2, 1))]
    rows = [(i, t, s, f"2024-01-0{r.randrange(1, 9)} 10:{r.randrange(60):02d}:00") for i, x in enumerate(raw) for t, s in enumerate(x)]
    log = spark.createDataFrame(rows, "log_id long, event_index long, symbol string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    some = log.where("symbol <> 'B' OR event_index % 3 = 0")
    both = lambda f, df: [as_rows(f(df, long=x)) for x in (False, True)]
    for f, df in (
        (sequence.reindex, some), (sequence.bigrams, some), (sequence.islands, some), (lambda d, long: sequence.islands(d, 3, long), some), (lambda d, long: sequence.time_gaps(d, n=6, long=long), some),
        (lambda d, long: sequence.within_ranges(d, d.where("event_index % 7 = 1").select("log_id", F.col("event_index").alias("lo"), (F.col("event_index") + F.length("symbol") * 5).alias("hi")), long), log),
        (lambda d, long: grammar.re_pair(d, long=long)[0], log), (lambda d, long: grammar.re_pair(d, long=long)[1], log),
        (lambda d, long: grammar.density_of(d, grammar.re_pair(d)[0], long=long), log),
    ):
        short, blocked = both(f, df)
        assert short == blocked and short
    spans = log.select("log_id", F.col("event_index").alias("id"), (F.col("event_index") * 3 % 50).alias("start"), (F.col("event_index") * 3 % 50 + F.col("event_index") % 4).alias("end"), (F.col("event_index") % 2 == 0).alias("flag"))
    assert as_rows(intervals.merge_overlaps(spans)) == as_rows(intervals.merge_overlaps(spans, long=True))
    assert scans.has_long(log, least=60) and not scans.has_long(log, least=61)


def test_dictionary_of_many_parts(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "a", "b", "c"]), r.randrange(40)) for i in range(2000)]
    got = sequence.dictionary(spark.createDataFrame(rows, "at long, a string, b int").repartition(5), ["a", "b"], "at").collect()
    want = {k: n for n, k in enumerate(dict.fromkeys((a, b) for _, a, b in rows))}
    assert {(x.a, x.b): x.id for x in got} == want
