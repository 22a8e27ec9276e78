"""The n-gram join against brute force."""

import random
import re

import numpy as np

from rutine.llm import ngram_join
from rutine.llm.components import components
from rutine.llm.ngram_join import Trie, needed, similar_classes


def classes(docs, n, percent):
    sets = {}
    for i, t in docs.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in docs}


def test_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcd") for _ in range(3))
    base = [[word() for _ in range(r.randint(3, 60))] for _ in range(8)]
    docs = {}
    for i in range(70):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        docs[i * 3 % 211] = r.choice([" ", "\n"]).join(w) if i % 5 else " ".join(w).upper()
    docs |= {300: None, 301: "", 302: " ", 303: "one two", 304: "One TWO", 305: "one two three"}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs.items()], "doc_id long, text string, n int, label int").repartition(3)
    for n, percent in ((4, 85), (5, 80), (2, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_classes(df, n, percent).collect()}
        assert got == classes(docs, n, percent)


def test_null_ids_repeated_rows_and_no_rows(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (9, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in similar_classes(df).collect())
    assert got == [(-1, -1), (4, 4), (4, 4), (9, 4)]
    assert similar_classes(df.where("doc_id > 99")).count() == 0


def test_trie_finds_what_counting_finds():
    r = random.Random(1)
    order = np.array(r.sample(range(10**6), 60), np.uint64)
    sets = [order[sorted(r.sample(range(60), r.randint(1, 40)))] for _ in range(80)]
    trie = Trie(sets, [len(s) for s in sets])
    for probe in sets[:20]:
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(s, probe)) >= needed(len(s), len(probe), 40)]
        assert sorted(trie.similar(probe, len(probe), 40)) == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, i) for i in range(51, 70)] + [(80, 80)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 50 for i in range(50, 70)}}


def passages(n, seed=4):
    """n documents of several shared passages each: every one shares much with many and is similar to none."""
    r = random.Random(seed)
    pool = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(40)]
    return {i: " ".join(r.sample(pool, 9)) for i in range(n)}


def test_shared_passages_make_few_candidates(spark, monkeypatch):
    seen, real = {}, ngram_join.written

    def counted(df, name, *by):
        out = real(df, name, *by)
        if name in ("stars", "more"):
            seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    for n in (300, 1200):
        seen.clear()
        docs = passages(n)
        copy = docs[5].split()
        copy[-1] = "other"
        docs[n + 1] = " ".join(copy)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {x.doc_id: x.component_id for x in similar_classes(df, 4, 85).collect()}
        assert got == {**{i: i for i in docs}, n + 1: 5}
        assert sum(seen.values()) < n, seen


def test_sketches_never_hide_a_link():
    r = np.random.default_rng(2)
    for size in (3, 60, 900, 5000):
        a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size * 9 // 10], r.integers(0, 2**63, size // 10, dtype=np.uint64)]))
        k = ngram_join.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert np.bitwise_count(k[0] ^ k[1]).sum() <= len(np.setxor1d(a, b))
