"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to. A flow network leads from
each pattern, whose capacity comes in layers (the first pass over its words, the second, ...) with convex costs, to the
quotas of its sources. The cheapest flow says how many words each pattern gives and to which source; then seeded
documents of the pattern are chosen until that number is met as nearly as whole documents allow.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.llm.common import WORD, free, table, written

#: Hash buckets of a pattern; one bucket's documents are ranked in one task.
BUCKETS = 4096
#: Plans and marks of more patterns than this are not marked for broadcast.
BROADCAST_PATTERNS = 20_000


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Split share * sum(sizes) by weight; none gets over most * its size, and what is over goes to the others by weight."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def flow_by_component(supplies: list[int], sides: list[list[int]], quotas: list[int], layers: int) -> dict[tuple[int, int], int]:
    """min_cost_flow(), solved for each connected part of the network by itself: patterns that share no source don't meet.

    The cheapest flow of the whole is that of its parts, so this is exact; a million sources without overlap are a million tiny networks."""
    parent = list(range(len(quotas)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for own in sides:
        for s in own[1:]:
            parent[find(s)] = find(own[0])
    parts: dict[int, list[int]] = {}
    for p, own in enumerate(sides):
        if own:
            parts.setdefault(find(own[0]), []).append(p)
    out = {}
    for patterns in parts.values():
        sources = sorted({s for p in patterns for s in sides[p]})
        at = {s: i for i, s in enumerate(sources)}
        flow = min_cost_flow([supplies[p] for p in patterns], [[at[s] for s in sides[p]] for p in patterns], [quotas[s] for s in sources], layers)
        out |= {(patterns[p], sources[s]): words for (p, s), words in flow.items()}
    return out


def min_cost_flow(supplies: list[int], sides: list[list[int]], quotas: list[int], layers: int) -> dict[tuple[int, int], int]:
    """Words from each pattern to each source: {(pattern, source): words}.

    A pattern p may give supplies[p] words in each of the layers; a word of layer k costs k * k, so repetition is
    spread evenly before anything is repeated again. As much of the quotas is met as can be, at the least cost.
    Successive shortest paths with potentials; capacities are integers, so the flow is whole."""
    start, end = 0, 1 + len(supplies) + len(quotas)
    to, cap, cost, at = [], [], [], [[] for _ in range(end + 1)]

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, z in ((b, c, w), (a, 0, -w)):
            at[a if x == b else b].append(len(to))
            to.append(x)
            cap.append(y)
            cost.append(z)
        return len(to) - 2

    for p, supply in enumerate(supplies):
        for k in range(layers):
            edge(start, 1 + p, supply, k * k)
    sent = {(p, s): edge(1 + p, 1 + len(supplies) + s, layers * supplies[p], 0) for p, own in enumerate(sides) for s in own}
    for s, quota in enumerate(quotas):
        edge(1 + len(supplies) + s, end, quota, 0)
    height = [0] * (end + 1)
    while True:
        far, by, heap = [None] * (end + 1), [-1] * (end + 1), [(0, start)]
        far[start] = 0
        while heap:
            d, a = heappop(heap)
            if d > far[a]:
                continue
            for e in at[a]:
                if cap[e]:
                    x = d + cost[e] + height[a] - height[to[e]]
                    if far[to[e]] is None or x < far[to[e]]:
                        far[to[e]], by[to[e]] = x, e
                        heappush(heap, (x, to[e]))
        if far[end] is None:
            return {k: cap[e ^ 1] for k, e in sent.items() if cap[e ^ 1]}
        height = [h + (f if f is not None else far[end]) for h, f in zip(height, far, strict=True)]
        path, a = [], end
        while a != start:
            path.append(by[a])
            a = to[by[a] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def _place(id_: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")))


def _bucket(place: Column, buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned(place, 40), F.lit(buckets))


def _pattern(sources: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(sources)), F.array().cast("array<string>"))


def _key(place: Column, id_: Column, buckets: int) -> Column:
    """Where a document stands in the seeded order."""
    return F.struct(_bucket(place, buckets).cast("int").alias("bucket"), place.alias("place"), id_.alias("id"))


def _times(place: Column, id_: Column, size: Column, buckets: int, mark: str) -> Column:
    """How many times a document is taken, by its pattern's mark."""
    key = _key(place, id_, buckets)
    within = lambda runs: F.coalesce(F.exists(runs, lambda r: (size <= r["most"]) & (r["after"].isNull() | (key > r["after"])) & (r["before"].isNull() | (key < r["before"]))), F.lit(False))
    once = (within(f"{mark}.runs") & ~within(f"{mark}.drops")) | (F.col(f"{mark}.extra").isNotNull() & key.eqNullSafe(F.col(f"{mark}.extra")))
    return F.coalesce(f"{mark}.times", F.lit(0)) + once.cast("long")


#: A pattern's choice goes on until it misses what the flow asks of it by no more than this share, or no document fits.
NEAR = 0.001


def _run(rows: DataFrame, open_: DataFrame, buckets: int) -> dict:
    """{sources: (words taken, the document that fits no more or None)} of a pass along the seeded order over documents that are no larger than the gap and lie behind `after`.

    Sums of buckets tell in which one the gap is filled; only that one's documents are ranked."""
    key = _key(F.col("place"), F.col("id"), buckets)
    some = rows.join(open_, "sources").where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.col("after").isNull() | (key > F.col("after"))))
    some = some.withColumn("bucket", _bucket(F.col("place"), buckets).cast("int")).select("sources", "gap", "bucket", "place", "id", "size")
    layers = written(some.groupBy("sources", "gap", "bucket").agg(F.sum("size").alias("words")), "layers")
    order = Window.partitionBy("sources").orderBy("bucket")
    upto = F.sum("words").over(order)
    layers = layers.withColumn("below", upto - F.col("words"))
    cut = written(layers.where("below <= gap AND gap < below + words").select("sources", "bucket", "below"), "cut")  # at most one row for each pattern
    here = Window.partitionBy("sources").orderBy("place", "id")
    edge = some.join(cut, ["sources", "bucket"]).withColumn("reach", F.col("below") + F.sum("size").over(here))
    edge = edge.groupBy("sources", "below").agg(F.max(F.when(F.col("reach") <= F.col("gap"), F.col("reach"))).alias("reach"), F.min(F.when(F.col("reach") > F.col("gap"), F.struct("bucket", "place", "id"))).alias("stop"))
    whole = layers.groupBy("sources").agg(F.sum("words").alias("words"))
    found = whole.join(edge, "sources", "left").select("sources", F.when(F.col("stop").isNull(), F.col("words")).otherwise(F.coalesce("reach", "below")).alias("words"), "stop")
    return {tuple(r.sources): (r.words, r.stop) for r in found.collect()}


def _marks(rows: DataFrame, targets, repeats: int, buckets: int) -> tuple[DataFrame, dict, dict]:
    """(marks, wanted, sizes) of rows (id, size, sources, place).

    A mark says of a pattern how many times all of its documents are taken, and which are taken once more: those of the seeded order up to the one that
    fits no more, behind it those small enough for what is missing, up to the next that fits no more, and so on. If too much is missing still, the smallest document left goes in,
    and others go out for it in the same way, if that comes nearer. The driver holds a row for each pattern, some 300 bytes, and solves their network; rows by pattern are broadcast only if they are few."""
    patterns = rows.groupBy("sources").agg(F.sum("size").alias("words")).orderBy("sources").collect()
    names = sorted({s for r in patterns for s in r.sources}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for r in patterns:
        for s in r.sources:
            sizes[s] += r.words
    wanted = targets(sizes)
    at = {s: i for i, s in enumerate(names)}
    flow = flow_by_component([r.words for r in patterns], [[at[s] for s in r.sources] for r in patterns], [round(wanted[s]) for s in names], repeats)
    given = [0] * len(patterns)
    for (p, _), words in flow.items():
        given[p] += words
    small = F.broadcast if len(patterns) <= BROADCAST_PATTERNS else lambda df: df
    keys = [tuple(r.sources) for r in patterns]
    times = {k: g // r.words if r.words else 0 for k, r, g in zip(keys, patterns, given, strict=True)}
    gap = {k: g % r.words if r.words else 0 for k, r, g in zip(keys, patterns, given, strict=True)}
    near = {k: NEAR * g for k, g in zip(keys, given, strict=True)}
    place = f"struct<bucket:int,place:bigint,id:{rows.schema['id'].dataType.simpleString()}>"
    table = rows.sparkSession.createDataFrame

    def fill(rows: DataFrame, gap: dict) -> tuple[dict, dict]:
        """(runs of documents, what is still missing) of each pattern, in rounds."""
        gap, runs, after, open_ = dict(gap), {k: [] for k in gap}, dict.fromkeys(gap), {k for k in gap if gap[k] > near[k]}
        while open_:
            asked = table([(list(k), gap[k], after[k]) for k in sorted(open_, key=str)], f"sources array<string>, gap long, after {place}")
            found = _run(rows, small(asked), buckets)
            for k in list(open_):
                words, stop = found.get(k, (0, None))
                if words:
                    runs[k].append((gap[k], after[k], stop))
                gap[k], after[k] = gap[k] - words, stop
                if stop is None or gap[k] <= near[k]:
                    open_.discard(k)
        return runs, gap

    run = f"array<struct<most:bigint,after:{place},before:{place}>>"

    def marked(runs: dict, drops: dict, extra: dict) -> DataFrame:
        rows_ = [(list(k), (times[k], runs[k], drops.get(k, []), extra.get(k))) for k in keys]
        return table(rows_, f"sources array<string>, mark struct<times:bigint,runs:{run},drops:{run},extra:{place}>")

    runs, gap = fill(rows, gap)
    short = {k: g for k, g in gap.items() if g > near[k] and times[k] < repeats}
    drops, extra = {}, {}
    if short:  # nothing that is left fits: the smallest of it goes in, and as much of the others out as it is too large
        taken = _times(F.col("place"), F.col("id"), F.col("size"), buckets, "mark") - F.col("mark.times")
        known = rows.join(small(table([(list(k), g) for k, g in short.items()], "sources array<string>, gap long")), "sources").join(small(marked(runs, {}, {})), "sources").withColumn("taken", taken)
        known = written(known.select("sources", "size", "place", "id", "gap", "taken"), "known")
        left = known.where("taken = 0 AND size > gap").groupBy("sources").agg(F.min(F.struct("size", _key(F.col("place"), F.col("id"), buckets).alias("key"))).alias("x"))
        found = {tuple(r.sources): r.x for r in left.collect()}
        cuts, over = fill(known.where("taken = 1").select("sources", "size", "place", "id"), {k: x.size - short[k] for k, x in found.items()})
        for k in found:
            if over[k] < gap[k]:
                drops[k], extra[k] = cuts[k], tuple(found[k].key)
    return small(written(marked(runs, drops, extra), "marks")), wanted, sizes


def mix(docs: DataFrame, size: Column, sources: Column, targets, repeats: int = 2, seed: int = 7, id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """Choose documents so that each source's words come near its target.

    sources is an array of the sources that a document belongs to (null elements are a source of their own;
    a null or empty array belongs to none and gives nothing). targets maps {source: words there} to
    {source: words wanted}. Returns (id, size, sources, taken), one row for each row of docs: taken is 0, size or a whole
    multiple of size up to repeats. A pattern's choice misses its flow by a thousandth (NEAR) at most, or, where its documents are few and large, by less than the smallest that could still go in, or out. The order of choice is a
    seeded hash of the id (rows that repeat an id and a size share a fate), so reruns agree and no task sorts a whole source. A null size gives nothing;
    an empty table gives an empty one.
    Also returns, as attributes _targets and _sizes of the result, the tables of both by source."""
    rows = docs.select(F.col(id_col).alias("id"), size.cast("long").alias("size"), _pattern(sources).alias("sources")).withColumn("place", _place(F.col("id"), seed))
    rows = written(rows, "sized")
    marks, wanted, sizes = _marks(rows, targets, repeats, buckets)
    out = rows.join(marks, "sources", "left")
    out = out.select(F.col("id").alias(id_col), "size", "sources", (F.col("size") * _times(F.col("place"), F.col("id"), F.col("size"), buckets, "mark")).alias("taken"))
    out._targets, out._sizes = wanted, sizes
    return out


def mixed_rows(docs: DataFrame, size: Column, sources: Column, targets, repeats: int = 2, seed: int = 7, id_col: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """The mix itself: rows of docs as many times as mix() takes them, with the columns of docs. Rows do not move."""
    rows = docs.select(F.col(id_col).alias("id"), size.cast("long").alias("size"), _pattern(sources).alias("sources")).withColumn("place", _place(F.col("id"), seed))
    marks, _, _ = _marks(written(rows, "sized"), targets, repeats, buckets)
    pattern, mark, copy = (free(docs.columns, x) for x in ("pattern", "mark", "copy"))
    out = docs.join(marks.toDF(pattern, mark), _pattern(sources) == F.col(pattern), "left")
    times = _times(_place(F.col(id_col), seed), F.col(id_col), F.coalesce(size.cast("long"), F.lit(0)), buckets, mark)
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


#: Weights that sources get in their order, repeating.
CYCLE = (5, 2, 1)


def cyclic_targets(share: float = 1.5, most: float = 2.0):
    """Targets of sources in order of code points, null last, by the weights of CYCLE."""

    def targets(sizes: dict) -> dict:
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        return dict(zip(names, water_fill([sizes[s] for s in names], [CYCLE[i % len(CYCLE)] for i in range(len(names))], share, most), strict=True))

    return targets


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    out = mix(docs, word_count("text"), F.array("source"), cyclic_targets())
    facts = spark.createDataFrame([(s, out._sizes[s], float(t)) for s, t in out._targets.items()], "source string, source_size long, target double")
    out = out.withColumn("source", F.element_at("sources", 1))
    few = F.broadcast if facts.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS else lambda df: df
    out = out.join(few(facts), out["source"].eqNullSafe(facts["source"]), "left")
    return out.select("doc_id", "size", "source_size", "target", "taken")
