"""N-gram Jaccard join by prefix trees.

A document's set holds hashes of its distinct word n-grams, in one global order: grams of few documents first (census), then by hash. Two
sets that are similar enough share a gram among the first few of each, so a set whose first few grams are all its own has no
partner, and goes no further. Equal sets are folded to the smallest id.

Sets that share a gram in front are compared first with one of them only, the most ordinary one. For that, the sets to be compared
with it are stored as a trie in global order and traversed once: sets with equal beginnings share the overlap counted so far, and a
subtree ends as soon as the lengths that remain, in it and in the probe, can't reach the overlap that its smallest set needs. Links found
join sets into components; whatever still shares a gram in front but is in different components is then compared likewise. No link
between components is lost, and the copies of a large group are never paired with each other.

Sets that share a passage and little else never become a pair: each set has a sketch, the parity of its grams in each of BITS cells. Two
sketches differ in no more cells than the sets have different grams, so sets whose sketches differ too much are dissimilar for certain. That
is tested inside the joins, before anything is put out; a gram in very many sets is dealt over as many keys as keep one small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.llm.census import census
from rutine.llm.common import arrow_batches, drop, lean_batches, small_batches, table, written
from rutine.llm.components import components
from rutine.llm.symbols import distinct_by_owner, grams, mix, words_of_all

#: Sets in a trie, about; those to be compared with one probe are dealt over as many tries as it takes.
TRIE = 256
#: Cells of a sketch, in eight longs.
BITS = 512
#: Sets behind a gram that one key of the last comparison may hold on its smaller side.
BLOCK = 4096
#: Characters of texts whose n-grams are sorted at once: a batch has some ten times as many, and sorting takes many times the space of its texts.
AT_ONCE = 1 << 19


def _few(texts: list[str]) -> Iterator[list[str]]:
    """texts in runs of about AT_ONCE characters, one run at least; a text is never cut."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= AT_ONCE:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts) or not texts:
        yield texts[start:]


def gram_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text's n-grams, one text after the other; how many each has). A text with fewer words has all of them as one."""
    hashes, sizes = zip(*(_gram_sets(few, words) for few in _few(texts)), strict=True)
    return np.concatenate(hashes), np.concatenate(sizes)


def _gram_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    w, n = words_of_all([x.encode() for x in texts], lower=True)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), n)
    h = grams(w, words)
    whole = np.flatnonzero(np.arange(len(h)) + words <= ends[owner[: len(h)]])
    h, owner = h[whole], owner[whole]
    few = np.flatnonzero((n > 0) & (n < words))
    short = [grams(w[ends[i] - n[i] : ends[i]], int(n[i])) for i in few]
    h, owner = np.concatenate([h, *short]), np.concatenate([owner, few])
    return distinct_by_owner(owner, h, len(n))[:2]


def needed(a, b, percent: int):
    """The smallest overlap of sets of sizes a and b at which 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def front(n: int, percent: int) -> int:
    """How many of n grams in order must hold one that any similar set has too."""
    return n - -(-percent * n // 100) + 1


class Trie:
    """Sets in a global order, as sorted rows with the lengths of their common beginnings: a path-compressed trie."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.order, self.sets = order, [sets[i] for i in order]
        self.length = np.array([len(s) for s in self.sets], np.int64)
        self.size = np.array([sizes[i] for i in order], np.int64)
        self.shared = np.zeros(len(order), np.int64)  # grams in common with the one before, from the start
        for i in range(1, len(order)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            self.shared[i] = int(differ.argmax()) if differ.any() else n

    def similar(self, probe: np.ndarray, size: int, percent: int) -> list[int]:
        """The places, as given, of the sets that are similar to a probe of `size` grams, of which these may be shared."""
        need = needed(self.size, size, percent)
        by_hash = np.argsort(probe, kind="stable")
        sorted_ = probe[by_hash]
        out, stack = [], [(0, len(self.sets), 0, 0, -1)]
        while stack:
            lo, hi, depth, overlap, last = stack.pop()
            if lo == hi:
                continue
            most = min(int(self.length[lo:hi].max()) - depth, len(probe) - 1 - last)
            if overlap + most < need[lo:hi].min():
                continue
            end = int(self.shared[lo + 1 : hi].min()) if hi - lo > 1 else int(self.length[lo])
            end = min(end, int(self.length[lo]))
            if end > depth and len(probe):
                part = self.sets[lo][depth:end]
                at = np.minimum(np.searchsorted(sorted_, part), len(sorted_) - 1)
                hit = sorted_[at] == part
                count = int(hit.sum())
                if count:
                    overlap += count
                    last = int(by_hash[at[hit]].max())
            done = lo
            while done < hi and self.length[done] == end:  # sets that end here sort first
                if overlap >= need[done]:
                    out.append(self.order[done])
                done += 1
                if done < hi and self.shared[done] < end:
                    break
            if done < hi:
                cuts = [done, *(np.flatnonzero(self.shared[done + 1 : hi] <= end) + done + 1).tolist(), hi]
                stack += [(a, b, end, overlap, last) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out


SKETCH = [f"k{i}" for i in range(BITS // 64)]
SETS = "id long, n long, s1 long, s2 long, own int, front int, grams binary, " + ", ".join(f"{k} long" for k in SKETCH)


def sketches(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parities of each set's grams by cell: rows of eight longs."""
    cell = np.repeat(np.arange(len(sizes)) * BITS, sizes) + (h >> np.uint64(23)).astype(np.int64) % BITS
    odd = (np.bincount(cell, minlength=len(sizes) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8").reshape(len(sizes), len(SKETCH))


def may_link(percent: int) -> str:
    """SQL: whether two sets can be similar, by their sizes (n, n2), grams that only one document has (own, own2) and sketches (k0.., l0..)."""
    need = f"CAST(ceil({percent} * (n + n2) / {100 + percent}) AS BIGINT)"
    differ = " + ".join(f"bit_count(k{i} ^ l{i})" for i in range(len(SKETCH)))
    return f"100 * least(n, n2) >= {percent} * greatest(n, n2) AND least(n - own, n2 - own2) >= {need} AND {differ} <= n + n2 - 2 * {need}"


def _sets(words: int, percent: int):
    """Rows of SETS of (id, text, codes); grams holds those that others have too, in order, and is null where no partner can be."""

    def run(batches):
        for b in small_batches(batches):
            out = []
            all_, sizes = gram_sets([x or "" for x in b.column(1).to_pylist()], words)
            marks = sketches(all_, sizes)
            for id_, codes, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), np.split(all_, np.cumsum(sizes)[:-1]), strict=True):
                n = len(h)
                code = np.frombuffer(codes or b"", np.uint8)
                own, ahead = int((code == 0).sum()), front(n, percent)
                with np.errstate(over="ignore"):
                    s1, s2 = (int(x.view(np.int64)) for x in (mix(h).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(h ^ np.uint64(0x5BF03635)), initial=np.uint64(0))))
                if not n or id_ is None or own >= ahead:
                    out.append((id_, n, s1, s2, own, 0, None))
                else:
                    order = np.lexsort((h, code))[own:]
                    out.append((id_, n, s1, s2, own, ahead - own, h[order].astype("<u8").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, np.ascontiguousarray(marks.T))], names=["id", "n", "s1", "s2", "own", "front", "grams", *SKETCH])

    return run


def _postings(batches):
    """A row (gram, id, n, own, place) for each gram in front of a set; place counts the set's own grams before it."""
    for b in batches:
        id_, n, own, ahead = (b.column(i).to_numpy() for i in range(4))
        each = [np.frombuffer(x, "<i8")[:k] for x, k in zip(b.column(4).to_pylist(), ahead.tolist(), strict=True)]
        size = [len(x) for x in each]
        place = np.concatenate([np.arange(len(x)) for x in each]) if each else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each) if each else np.zeros(0, np.int64)), *(pa.array(np.repeat(x, size).astype(np.int64)) for x in (id_, n, own)), pa.array(place + np.repeat(own, size))], names=["gram", "id", "n", "own", "place"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets (id, n, grams) are similar. b is the probe of tries that hold the a of its pairs."""
    tries = pairs.groupBy("b").agg(F.ceil(F.count("*") / TRIE).alias("tries"))
    pairs = pairs.join(tries, "b").withColumn("trie", F.pmod(F.xxhash64("a"), "tries")).select("a", "b", "trie")
    body = lambda key: sets.select(F.col("id").alias(key), "n", "grams")
    stored = pairs.join(body("a"), "a").select("b", "trie", "a", "n", "grams")
    probes = pairs.select("b", "trie").distinct().join(body("b"), "b").select("b", "trie", F.lit(None).cast("long").alias("a"), "n", "grams")

    def run(group: pa.Table) -> pa.Table:
        a, n, body = (group.column(x).to_pylist() for x in ("a", "n", "grams"))
        probe = a.index(None)
        rest = [i for i in range(len(a)) if i != probe]
        trie = Trie([np.frombuffer(body[i], "<u8") for i in rest], [n[i] for i in rest])
        found = [a[rest[i]] for i in trie.similar(np.frombuffer(body[probe], "<u8"), n[probe], percent)]
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([group.column("b")[0].as_py()] * len(found), pa.int64())})

    return stored.unionByName(probes).groupBy("b", "trie").applyInArrow(run, "a long, b long")


def _marked(sets: DataFrame, id_: str, n: str, own: str, sketch: str) -> DataFrame:
    """What may_link() asks of a set, by names for its side."""
    return sets.select(F.col("id").alias(id_), F.col("n").alias(n), F.col("own").alias(own), *[F.col(k).alias(f"{sketch}{i}") for i, k in enumerate(SKETCH)])


def similar_classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by similar n-gram sets: (id, n_shingles, component_id), one row for each row of docs.

    Two documents link when 100 * |both| >= percent * |either|, sets being the distinct runs of `words` words, A to Z in lower case; with
    fewer words, all of them as one. component_id is the smallest id that links lead to, its own included. A text that is null or without a
    word has an empty set and links with nothing, not even its like. Rows that repeat an id are one document if their
    sets are equal. A row with a null id links with nothing and has no component."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = census(rows, lambda texts: gram_sets(texts, words)).select("id", "text", "codes")
    found = written(counted.mapInArrow(lean_batches(_sets(words, percent)), SETS), "sets")
    partners = found.where("grams IS NOT NULL")
    same = partners.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"))
    sets = partners.join(same, ["id", "n", "s1", "s2"], "left_semi").dropDuplicates(["id", "n", "s1", "s2"])
    sets = written(sets, "folded")
    posts = written(sets.select("id", "n", "own", "front", "grams").mapInArrow(lean_batches(_postings), "gram long, id long, n long, own long, place long"), "postings")
    one, other = _marked(sets, "a", "n", "own", "k"), _marked(sets, "b", "n2", "own2", "l")
    # each set with the most ordinary one behind the same gram
    hubs = posts.groupBy("gram").agg(F.min(F.struct("own", "id")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    stars = posts.select("gram", F.col("id").alias("a")).join(hubs.select("gram", F.col("hub.id").alias("b")), "gram").where("a <> b").select("a", "b").distinct()
    stars = written(stars.join(one, "a").join(other, "b").where(F.expr(may_link(percent))).select("a", "b"), "stars")
    links = written(_verified(stars, sets, percent), "links")
    labels = written(components(links), "labels")
    # what shares a gram in front and is not connected yet
    named = posts.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = written(named, "named")
    mixed = named.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("x <> y")
    rest = named.select("gram", F.col("id").alias("a"), "place", "label").join(mixed.select("gram", "blocks"), "gram").join(one, "a")
    rest = written(rest, "rest")
    left = rest.withColumn("block", F.pmod(F.xxhash64("a"), "blocks")).drop("blocks")
    right = rest.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks")
    right = right.withColumnsRenamed({"a": "b", "place": "place2", "label": "label2", "n": "n2", "own": "own2", **{k: f"l{i}" for i, k in enumerate(SKETCH)}})
    reach = f"least(n - place, n2 - place2) >= ceil({percent} * (n + n2) / {100 + percent})"
    more = left.join(right, ["gram", "block"]).where(F.expr(f"a < b AND label <> label2 AND {reach} AND {may_link(percent)}"))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(more.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "more")
    links = links.unionByName(_verified(more, sets, percent))
    labels = components(links).withColumnRenamed("id", "rep")
    whole = same.withColumnRenamed("id", "rep").join(labels, "rep", "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("component_id"))
    joined = partners.select("id", "n", "s1", "s2").join(written(whole, "classes"), ["n", "s1", "s2"]).select("id", "n", "component_id")
    drop(sets, posts, stars, named, rest, more)
    alone = found.where("grams IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return alone.unionByName(joined).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op1_trie_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents", "doc_id", "text"), words=4, percent=85)
