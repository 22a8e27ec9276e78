"""Suffix and window dedup against brute force, with edge cases."""

import hashlib
import random
import re

import numpy as np
from rutine.llm import repeats, symbols
from rutine.llm.substring import dedup_windows
from rutine.llm.suffix_dedup import LoserTree, Run, dedup_substrings, front_coded


def removed(items, length):
    """{id: which of its symbols go} by definition; items is {id: sequence}."""
    first = {}
    for d in sorted(items):
        s = items[d]
        for i in range(len(s) - length + 1):
            first.setdefault(s[i : i + length], d)
    out = {}
    for d, s in items.items():
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if first[s[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        out[d] = gone
    return out


def texts(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(40))
    line = " ".join(word() for _ in range(14))
    out = {}
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 30)))]
        if i % 3 == 0:
            parts.insert(r.randint(0, 1), passage[r.randint(0, 30) :])
        if i % 2:
            parts += [line, " ".join(word() for _ in range(r.randint(0, 5)))]
        out[i * 7 % 61] = r.choice([" ", "\n", "\t "]).join(parts)
    out |= {100: out[0], 101: out[7], 102: "", 103: None, 104: "ab" * 200, 105: "x" + "ab" * 100, 106: "a" * 300, 107: "a" * 60, 108: "\x00" * 70, 109: "b\x00" + "\x00" * 60, 110: " \n\t "}
    return out


def test_against_brute_force(spark):
    docs = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, id string, n int").repartition(3)
    got = {r.doc_id: r for r in dedup_substrings(df, length=20, gram=8).collect()}
    want = removed({i: (t or "").encode() for i, t in docs.items()}, 20)
    for i, gone in want.items():
        raw = (docs[i] or "").encode()
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall("1+", "".join("01"[g] for g in gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(raw), sum(gone), spans, kept), i
    got = {r.doc_id: r for r in dedup_windows(df, length=6, gram=3).collect()}
    words = {i: tuple(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in docs.items()}
    for i, gone in removed(words, 6).items():
        kept = " ".join(w for w, g in zip(words[i], gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, bytes(got[i].kept).decode()) == (len(words[i]), sum(gone), kept), i


def test_common_grams_go_window_by_window(monkeypatch):
    """Both ways of exchanging families give the same bits."""
    docs = {i: (t or "").encode() for i, t in texts(2).items()}
    shape = repeats.Shape(words=False, length=20, gram=8)
    ids = sorted(docs)
    raws = [docs[i] for i in ids]
    want = removed(docs, 20)
    for limit in (0, 100):
        monkeypatch.setattr(repeats, "_COMMON_CLASS", limit)
        symbols, counts = shape.symbols(raws)
        sent = shape.hashes([r.decode() for r in raws])[1]
        owner, p, low, high, route = shape.suspects(symbols, counts, bytes([1] * int(sent.sum())))
        ends = np.cumsum(counts)
        keys = shape.keys(symbols, ends[owner], p, low, high, route)
        order = np.argsort(repeats.as_text(keys), kind="stable")
        left = keys[order][:, shape.head : -3]
        bits = np.empty(len(order), np.uint32)
        bits[order] = repeats.earlier(shape, repeats.common_prefixes(keys[order][:, : shape.head]), left, keys[order][:, -3:-1], np.array(ids)[owner[order]])
        for i, d in enumerate(ids):
            mine = owner == i
            start = ends[i] - counts[i]
            cover = repeats.covered(int(counts[i]), shape, p[mine] - start, low[mine] - start, high[mine] - start, bits[mine])
            assert cover.tolist() == want[d], (limit, d)


def test_loser_tree_merges_as_sorting_does():
    r = random.Random(3)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(9)) for _ in range(r.randint(0, 40))) for _ in range(7)]
    coded = [front_coded(np.frombuffer(b"".join(x), np.uint8).reshape(-1, 9)) for x in runs]
    order, shared = LoserTree([Run(*c, 9) for c in coded]).merged()
    at, merged = [0] * len(runs), []
    for i in order:
        merged.append(runs[i][at[i]])
        at[i] += 1
    assert merged == sorted(x for run in runs for x in run)
    for i in range(1, len(merged)):
        n = next((k for k in range(9) if merged[i][k] != merged[i - 1][k]), 9)
        assert shared[i] == n


def test_null_and_repeated_ids_and_empty_tables(spark):
    t = "some words that are long enough to be found again and again by anyone who looks for them"
    df = spark.createDataFrame([(None, t), (None, t), (5, t), (5, t), (6, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in dedup_substrings(df).collect())
    assert got == [(-1, 0), (-1, 0), (5, 0), (5, 0), (6, len(t))]
    got = sorted((r.doc_id or -1, r.n_removed) for r in dedup_windows(df).collect())
    assert got == [(-1, 0), (-1, 0), (5, 0), (5, 0), (6, len(t.split()))]
    none = df.where("doc_id > 99")
    assert dedup_substrings(none).count() == dedup_windows(none).count() == 0


def test_digest(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert bytes(dedup_windows(df, digest=True).first().kept).decode() == hashlib.sha256(b"a b").hexdigest()


def test_texts_of_several_parts(spark):
    """Texts longer than what is worked on at once, with passages that repeat across the cuts."""
    r = random.Random(9)
    text = "".join(r.choice("abcdefgh ") for _ in range(5 * repeats.PART))
    docs = {1: text, 2: "x" * 11 + text[1000 : 3 * repeats.PART] + "y" * 5 + text[2 * repeats.PART :], 3: "ab" * repeats.PART, 4: "a" + "ab" * repeats.PART}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: x for x in dedup_substrings(df).collect()}
    for i, gone in removed({i: t.encode() for i, t in docs.items()}, 50).items():
        kept = bytes(b for b, g in zip(docs[i].encode(), gone, strict=True) if not g)
        assert (got[i].n_removed, bytes(got[i].kept)) == (sum(gone), kept), i
    got = {x.doc_id: x for x in dedup_windows(df).collect()}
    words = {i: tuple(t.split()) for i, t in docs.items()}
    for i, gone in removed(words, 13).items():
        assert (got[i].n_words, got[i].n_removed) == (len(words[i]), sum(gone)), i


def test_long_words_with_hard_hashes(spark):
    """Pairs of words that collide under any polynomial modulo a power of two with an odd base."""
    x, y = "a", "b"
    for _ in range(12):
        x, y = x + y, y + x
        if len(x) >= 1024:
            assert symbols.words(x.encode())[0][0] != symbols.words(y.encode())[0][0], len(x)
    frame = "one two three four five six {} seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, frame.format(x)), (2, frame.format(y))], "doc_id long, text string")
    assert [r.n_removed for r in dedup_windows(df).collect()] == [0, 0]
