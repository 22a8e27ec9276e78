"""The prefix trie of conversations, by prefix-doubling names.

Turns get dense names, then adjacent pairs of them, then pairs of those, so that after a logarithmic number of join rounds each block
of a power of two of turns that starts at a multiple of its size has a name: equal names mean equal turns and the reverse. The first d turns of a conversation are the
blocks of d's binary digits, longest first, and their names make up the name of the prefix; grouping prefixes by it gives the nodes.

What is summed over a subtree is summed along conversations: each node counts in the row of its smallest member, sums run from the end of each
conversation to its start, and a node adds up its members. Rows are dealt by conversation and place, in blocks, so neither a node that
most conversations pass nor a conversation that has most of all turns lies in one task."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.llm.common import arrow_batches, drop, table, written
from rutine.llm.spelling import CRC32
from rutine.operators.scans import numbered

#: Places of a conversation that one task scans at once, a power of two; and what one row of a block is spread to at once.
BLOCK = 1 << 12
#: Ids in one piece of a list of ids.
PIECE = 1 << 14


def dense_names(rows: DataFrame, keys: list[str], *facts: Column, in_order: bool = False) -> DataFrame:
    """The distinct keys, or facts of them, with names 0, 1, ...: numbers within each task, behind those of the tasks before.

    With in_order, names follow the order of the keys."""
    found = rows.select(*keys).distinct()
    if in_order:
        found = found.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    found = found.sortWithinPartitions(*keys).withColumn("_in", F.monotonically_increasing_id())
    found = written(found.select(*(facts or keys), "_in"), "named").withColumn("_part", F.shiftright("_in", 33))
    parts = found.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row for each task
    starts, at = [], 0
    for r in parts:
        starts.append((r["_part"], at - (r["_part"] << 33)))
        at += r.n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _base long")
    return found.join(starts, "_part").withColumn("name", F.col("_in") + F.col("_base")).drop("_in", "_part", "_base")


def _hashes(role: str, text: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed + i), role, text).alias(f"h{i + 1}") for i in range(2)]


def named_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, name, size) of each turn: its place from 0 in its conversation, the name of its role and text, the text's code points.

    Turns follow turn_col, nulls first; of several at one turn, role and text decide. A null role or text is an empty one. Rows
    without a conversation are left out. Texts travel once, folded, to be named; turns are joined by two hashes that the naming has shown to mean one content."""
    turns = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    seed = 0
    while True:
        names = written(dense_names(turns, ["role", "text"], *_hashes("role", "text", seed), in_order=True), "turnnames")
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
        drop(names)
        seed += 2
    rows = turns.select("conv", "turn", *_hashes("role", "text", seed), F.length("text").cast("long").alias("size")).join(names, ["h1", "h2"])
    rows = written(rows.select("conv", "turn", "name", "size"), "turnrows")
    return numbered(rows, ["conv"], ["turn", "name"]).select("conv", "place", "name", "size")


def _blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each power of two the named blocks (conv, length, at, name) that start at multiples of their size, at being their number."""
    levels = [turns.select("conv", "length", F.col("place").alias("at"), "name")]
    while longest >> len(levels):
        below, odd = levels[-1], F.col("at") % 2 == 1
        pairs = below.groupBy("conv", "length", F.shiftright("at", 1).alias("at")).agg(F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("right"))
        pairs = written(pairs.where("left IS NOT NULL AND right IS NOT NULL"), "pairs")
        levels.append(written(pairs.join(dense_names(pairs, ["left", "right"]), ["left", "right"]).select("conv", "length", "at", "name"), "blocks"))
        drop(pairs)
    return levels


def _prefixes(convs: DataFrame, turns: DataFrame, longest: int) -> DataFrame:
    """(conv, length, depth, names, size): the names of the blocks that make up each prefix, longest first, and its last turn's code points.

    A block of 2^k turns at an even number is the digit 2^k of the prefixes that end in the 2^k places behind it, so blocks are spread to them, long ranges in steps, without a join."""
    pieces = [
        convs.select("conv", "length", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("struct<k:int,name:bigint>").alias("piece"), F.lit(0).cast("long").alias("size")),
        turns.select("conv", "length", (F.col("place") + 1).alias("depth"), F.lit(None).cast("struct<k:int,name:bigint>").alias("piece"), "size"),
    ]
    for k, level in enumerate(_blocks(turns, longest)):
        lo, hi = (F.col("at") + 1) * (1 << k), F.least(F.col("length"), (F.col("at") + 2) * (1 << k) - 1)
        rows = level.where("at % 2 = 0").select("conv", "length", "name", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
        if 1 << k > BLOCK:
            step = rows.withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(BLOCK))))
            rows = step.withColumn("hi", F.least("hi", F.col("lo") + BLOCK - 1)).repartition("conv", "lo")
        spread = rows.select("conv", "length", F.explode(F.sequence("lo", "hi")).alias("depth"), F.struct(F.lit(-k).alias("k"), "name").alias("piece"), F.lit(None).cast("long").alias("size"))
        pieces.append(spread)
    all_ = pieces[0]
    for p in pieces[1:]:
        all_ = all_.unionByName(p)
    made = all_.groupBy("conv", "length", "depth").agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.max("size").alias("size"))
    return written(made.select("conv", "length", "depth", F.col("pieces.name").alias("names"), "size"), "prefixes")


def _scanned(members: DataFrame) -> DataFrame:
    """members with parent, the smallest member of the prefix that is one turn shorter, and saved and leaf, summed from each prefix to the conversation's end.

    Within blocks by windows; from block to block by a row for each."""
    block = F.shiftright("depth", BLOCK.bit_length() - 1)
    rows = members.withColumn("block", block).withColumn("border", F.lit(False))
    after = rows.where((F.col("depth") + 1) % BLOCK == 0).withColumns({"block": F.col("block") + 1, "border": F.lit(True), "saved": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")})
    whole = rows.groupBy("conv", "block").agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaf"))
    rest = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    whole = whole.withColumns({"all_saved": F.sum("all_saved").over(rest), "all_leaf": F.sum("all_leaf").over(rest)})
    inside = Window.partitionBy("conv", "block").orderBy("depth")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    near = rows.unionByName(after).withColumns({
        "parent": F.lag("rep").over(inside), "before_saved": F.coalesce(F.sum("saved").over(before), F.lit(0)), "before_leaf": F.coalesce(F.sum("leaf").over(before), F.lit(0)),
    })
    out = near.where("NOT border").join(whole, ["conv", "block"])
    return out.withColumns({"saved": F.col("all_saved") - F.col("before_saved"), "leaf": F.col("all_leaf") - F.col("before_leaf")}).select("conv", "depth", "length", "rep", "n", "parent", "saved", "leaf")


def _id_digests(ends: DataFrame) -> DataFrame:
    """(rep, depth, sha256) of the ids of each node in ascending order, comma-joined.

    Ids are sorted by ranges of (node, id), so that those of one node lie in many tasks, and joined to long pieces there; only the pieces of a
    node meet in one task, which hashes them one after the other: a digest is sequential, and nothing else is."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = ends.repartitionByRange(n, "rep", "depth", "conv").sortWithinPartitions("rep", "depth", "conv")

    def pieces(batches):
        for b in batches:
            rep, depth, conv = (b.column(i).to_pylist() for i in range(3))
            out, start = [], 0
            for i in range(1, len(conv) + 1):
                if i == len(conv) or i - start == PIECE or rep[i] != rep[start] or depth[i] != depth[start]:
                    out.append((rep[start], depth[start], conv[start], ",".join(map(str, conv[start:i]))))
                    start = i
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else
                                             [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["rep", "depth", "first", "ids"])

    def digests(batches):
        node, h = None, None
        for b in batches:
            out = []
            for rep, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (rep, depth) != node:
                    if node is not None:
                        out.append((*node, h.hexdigest()))
                    node, h = (rep, depth), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _digest_rows(out)
        if node is not None:
            yield _digest_rows([(*node, h.hexdigest())])

    made = ids.select("rep", "depth", "conv").mapInArrow(pieces, "rep long, depth long, first long, ids string")
    dealt = made.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first")
    return dealt.mapInArrow(digests, "rep long, depth long, sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rep", "depth", "sha256"])


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations convs (conv) with turns (conv, place, name, size), places from 0 without gaps, equal names for equal turns.

    Returns, one row for each node, (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a node being
    named by its depth and its smallest member. A conversation without turns is a member of the root only. Conversations without
    end are more rows; ties there are none. Without conversations there is no node, not even the root."""
    arrow_batches(convs.sparkSession)
    turns = written(turns, "rebuilt")
    lengths = turns.groupBy("conv").agg(F.count("*").alias("length"))
    convs = written(convs.select("conv").distinct().join(lengths, "conv", "left").select("conv", F.coalesce("length", F.lit(0)).cast("long").alias("length")), "convs")
    turns = written(turns.join(convs, "conv"), "turns")
    root = convs.agg(F.min("conv").alias("rep"), F.count("*").alias("n"), F.max("length").alias("deepest")).first()
    prefixes = _prefixes(convs, turns, root.deepest or 0)
    nodes = prefixes.where("depth > 0").groupBy("depth", "names").agg(F.min("conv").alias("rep"), F.count("*").alias("n"), F.max("length").alias("deepest"))
    nodes = written(nodes, "nodes")  # by itself, so that the join of a node that most conversations pass can be split
    members = prefixes.where("depth > 0").join(nodes, ["depth", "names"]).drop("names")
    at_root = [F.lit(root[x]).cast("long").alias(x) for x in ("rep", "n", "deepest")]
    members = members.unionByName(prefixes.where("depth = 0").select("conv", "length", "depth", "size", *at_root))
    own, childless = F.col("conv") == F.col("rep"), (F.col("deepest") == F.col("depth")) & (F.col("length") == F.col("depth"))
    members = members.withColumns({"saved": F.when(own, (F.col("n") - 1) * F.col("size")).otherwise(0).cast("long"), "leaf": F.when(own & childless, 1).otherwise(0).cast("long")})
    members = written(members.drop("size", "deepest"), "members")
    drop(prefixes)
    rows = written(_scanned(members), "scanned")
    out = rows.groupBy("rep", "depth").agg(
        F.max(F.when(F.col("conv") == F.col("rep"), F.col("parent"))).alias("parent_conv_id"), F.max("n").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    children = rows.where("conv = rep AND depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = _id_digests(rows.where("depth = length").select("rep", "depth", "conv"))
    out = out.join(children, ["rep", "depth"], "left").join(ends, ["rep", "depth"], "left")
    return out.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of named turns, where each conversation c begins with the first h turns of conversation c - c % every, if it is there, and goes on with
    its own behind its first h; h is crc32 of c in decimal, modulo most.

    A conversation that has h turns or fewer, and no one to begin with, is left without turns. Of the first turns of a conversation at most `most` are handed out, to at most twice `every` others."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"base": F.col("conv") - F.col("conv") % every, "h": h})
    convs = written(convs, "bases")
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = written(convs.select("conv", "base", "h", "given"), "given")
    first = turns.where((F.col("conv") % every == 0) & (F.col("place") < most)).select(F.col("conv").alias("base"), "place", "name", "size")
    given = convs.where("given > 0").join(first, "base").where("place < given").select("conv", "place", "name", "size")
    own = turns.join(convs, "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "name", "size")
    return convs.select("conv"), given.unionByName(own)


def op11_turn_trie(spark, sf_dir: str) -> DataFrame:
    named = written(named_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), "namedturns")
    return prefix_trie(*rebuilt(named))


ORACLE = {
    "op11_turn_trie": """
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
                          {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT c, list(x ORDER BY p) AS own, c::VARCHAR AS s FROM t GROUP BY c),
        h AS (SELECT c, own, (""" + CRC32.format(text="s") + """ % 6)::INT AS h FROM k),
        r AS (SELECT a.c, coalesce(b.own[:a.h], []) || a.own[a.h + 1:] AS x FROM h a LEFT JOIN h b ON b.c = a.c - a.c % 100),
        p AS (SELECT c, len(x) AS l, x[:d] AS x, d FROM r, unnest(range(len(x) + 1)) AS u(d)),
        n AS (SELECT x, d, min(c) AS c, count(*) AS n, count(*) FILTER (WHERE l > d) AS more, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE l = d) AS ends FROM p GROUP BY x, d),
        kids AS (SELECT x[:d - 1] AS x, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
        up AS (SELECT n.x, n.d, n.n, n.more, n.x[:e] AS top FROM n, unnest(range(n.d + 1)) AS u(e)),
        sums AS (SELECT top, count(*) FILTER (WHERE more = 0) AS leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(x[d].t) END)::BIGINT AS saved FROM up GROUP BY top)
        SELECT n.c AS conv_id, n.d AS depth, q.c AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens,
               sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM n LEFT JOIN n q ON q.x = n.x[:n.d - 1] AND q.d = n.d - 1 LEFT JOIN kids ON kids.x = n.x JOIN sums ON sums.top = n.x""",
}
