"""Conversation tries, line dedup and spelling variants against plain Python, with edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rutine.llm import line_dedup, spelling, turn_trie

# conversation tries

TURNS = "conv_id long, turn long, role string, text string, conv int, name string, place int"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, mine in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for node, convs in members.items():
        under = [u for u in members if u[: len(node)] == node]
        kids = [u for u in under if len(u) == len(node) + 1]
        leaves = [u for u in under if not any(len(v) == len(u) + 1 and v[: len(u)] == u for v in under)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in under if u)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie_of(spark, df):
    out = turn_trie.prefix_trie(*turn_trie.rebuilt(turn_trie.named_turns(df)))
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("block", [1 << 12, 4])
def test_trie_is_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(turn_trie, "BLOCK", block)
    monkeypatch.setattr(turn_trie, "PIECE", 3)
    r = random.Random(block)
    rows = []
    for c in [*range(0, 12), *range(100, 130), *range(-130, -110), 205, 399, 2**40]:
        for t in range(r.choice([1, 2, 3, 5, 8, 13, 21])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "bot", None, ""]), r.choice(["hi", "há", "", None, "x" * 9]), 1, "n", 7))
    rows += [(7, t, "user", "again", 1, None, None) for t in range(70)] + [(None, 1, "user", "no one", 1, "n", 1)]
    rows += rows[:5]
    assert trie_of(spark, spark.createDataFrame(rows, TURNS).repartition(5)) == plain_trie(rows)


def test_trie_of_little(spark):
    df = spark.createDataFrame([(None, 1, "a", "b", 1, "n", 1)], TURNS)
    assert trie_of(spark, df) == trie_of(spark, df.limit(0)) == []
    rows = [(3, None, None, None, 1, "n", 1)]  # 3 has h > 0 or not: either way it is what plain Python says
    assert trie_of(spark, spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_dense_names(spark):
    df = spark.createDataFrame([(i % 7, str(i % 3)) for i in range(50)], "a int, b string").repartition(6)
    got = turn_trie.dense_names(df, ["a", "b"], in_order=True).orderBy("a", "b").collect()
    assert [r.name for r in got] == list(range(21))


# line dedup

DOCS = "doc_id long, text string, id long, sig string, at int"


def plain_lines(rows, least_docs=3, least_chars=20):
    owners = defaultdict(set)
    key = lambda line: line.strip(line_dedup.BLANKS).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    rank = lambda i: (i is not None, i or 0)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                owners[key(line)].add(rank(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(owners[key(x)]) < least_docs or rank(i) == max(owners[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def lines_of(df):
    out = line_dedup.drop_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_lines_are_plain_python(spark, monkeypatch, ranges):
    monkeypatch.setattr(line_dedup, "parts", lambda df, size: ranges)
    r = random.Random(ranges)
    pool = [f"a line that is long enough {i}" for i in range(12)] + ["short", "", " " * 30, "É" * 19, "é" * 20, "x" * 20]
    dress = lambda s: r.choice([s, s.upper() if "é" not in s and "É" not in s else s, f"  {s}\t", f"\r{s}\x0b"])
    rows = [(i, "\n".join(dress(r.choice(pool[: r.choice([3, len(pool)])])) for _ in range(r.randint(0, 9))), 1, "s", 2) for i in range(60)]
    rows += [(60, None, 1, "s", 2), (61, "", 1, "s", 2), (None, "\n".join(pool), 1, None, 2), (None, pool[0], 1, None, 2), (5, "\n".join(pool), 1, None, 2), rows[7], rows[7]]
    rows += [(70 + i, "the one that everyone has got\n" * 40 + "\n", 1, "s", 2) for i in range(30)] + [(-4, "\n" * 3000 + pool[2], 1, "s", 2)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert lines_of(df) == plain_lines(rows)


def test_streams_in_small_batches():
    import pyarrow as pa

    r = random.Random(3)
    for _ in range(200):
        rows = sorted(((r.randint(0, 4), 0, r.choice([None, 1, 2, 3, 4]), 0, i) for i in range(r.randint(1, 30))), key=lambda x: (x[0], x[2] is None, -(x[2] or 0), x[4]))
        names = ["h1", "h2", "id", "sig", "at"]
        whole = pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
        cuts = sorted({0, len(rows), *(r.randrange(len(rows)) for _ in range(4))})
        stream, told = line_dedup._Stream(3), []
        for a, b in itertools.pairwise(cuts):
            told += stream.add(whole.slice(a, b - a))
        told += stream.add(whole.slice(0, 0), last=True)
        told = [x for t in told for x in t.to_pylist()]
        gone = {x["at"] for x in told if x["state"] == line_dedup.DROP}
        counts = {x["h1"]: x["n"] for x in told if x["state"] == line_dedup.COUNT}
        open_ = {x["at"] for x in told if x["state"] == line_dedup.OPEN}
        ids = defaultdict(set)
        for k, _, i, _, _ in rows:
            ids[k].add(-1 if i is None else i)
        for k, _, i, _, at in rows:
            should = len(ids[k]) >= 3 and (-1 if i is None else i) < max(ids[k])
            assert should == (at in gone or (at in open_ and counts[k] >= 3 and (-1 if i is None else i) < max(ids[k])))
        assert set(counts) == {rows[0][0], rows[-1][0]}


def test_bitmaps(spark):
    import numpy as np

    for gone in ([0], [7], [8], [3, 900], list(range(5000))):
        n = max(gone) + 3
        assert np.flatnonzero(~line_dedup.unpack(line_dedup.pack(np.array(gone)), n)).tolist() == gone
    df = spark.createDataFrame([], DOCS)
    assert lines_of(df) == [] and line_dedup.line_bitmaps(df).count() == 0


# spelling variants


def plain_variants(counts):
    words, near = sorted(counts), defaultdict(set)
    cuts = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cuts[(i, w[:i] + w[i + 1 :])].add(w)
    for (_, cut), ws in cuts.items():
        for a, b in itertools.permutations(ws, 2):
            near[a].add(b)
        if cut in counts:
            for a in ws:
                near[a].add(cut)
                near[cut].add(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_variants_are_plain_python(spark):
    r = random.Random(8)
    counts = {}
    for _ in range(150):
        w = "".join(r.choice("abéñ") for _ in range(r.randint(4, 12)))
        counts[w] = r.choice([2, 30, 400, 5000, 10**9])
        for _ in range(r.randint(0, 12)):
            i, kind = r.randrange(len(w)), r.randrange(3)
            v = w[:i] + w[i + 1 :] if kind == 0 else w[:i] + r.choice("abéñ") + w[i + (kind == 1) :]
            if len(v) >= 4:
                counts.setdefault(v, r.choice([1, 2, 3, 50]))
                w = r.choice([w, v])
    for a, b in zip("abcdefgh", "bcdefghi", strict=False):  # a chain of forms
        counts[f"chains{a}x"[: 8]] = 10 ** (ord(a) - 97)
        assert b
    counts |= {"a" * 30: 5, "a" * 31: 60, "a" * 29: 1, "ab" * 2000: 2, "ab" * 1999 + "a": 50, "×÷×÷×÷×": 2}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert sorted(tuple(x) for x in spelling.variants(df).collect()) == plain_variants(counts)
    assert spelling.variants(df.limit(0)).count() == 0


def test_letter_words(spark):
    r = random.Random(9)
    rows = [(i if i % 9 else None, " ".join("".join(r.choice("abcdeABÉéÿĀ1'") for _ in range(r.randint(1, 14))) for _ in range(60)), 1, "x", 1) for i in range(40)]
    rows += [(50, None, 1, "x", 1), (51, "", 1, "x", 1), (52, "z" * 100_000, 1, "x", 1)]
    want = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = spelling.letter_words(spark.createDataFrame(rows, DOCS)).collect()
    assert {x.word: x.n for x in got} == dict(want)
    assert {x.word for x in spelling.letter_words(spark.createDataFrame([(1, "Abcdefg abc", 1, "", 1)], DOCS), slips=None).collect()} == {"abcdefg"}
