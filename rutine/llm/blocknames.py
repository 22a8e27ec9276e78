"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted and each gets an integer
name; then adjacent names are paired, the distinct pairs are sorted and named, and so on until each text has
one name. Equal names mean equal texts and the reverse: contents are compared, never only hashes.

Every document is named. Blocks travel once, folded before they are exchanged; what comes back to a document is joined by two hashes of the
block, which the naming has shown to belong to one content only (with other seeds, should they not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rutine.llm.common import drop, free, table, written

BLOCK_BYTES = 1024


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys with integer names, which follow the sort order within each part of the keys' hash."""
    return df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(body: Column, block_bytes: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / block_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(body, i * block_bytes + 1, F.lit(block_bytes)))


def _named_blocks(bodies: DataFrame, block_bytes: int, seed: int) -> DataFrame | None:
    """(h1, h2, name) of each distinct block of bodies (body), or none if two blocks share both hashes."""
    blocks = bodies.select(F.explode(_blocks(F.col("body"), block_bytes)).alias("block"))
    names = _numbered(blocks, ["block"]).select(*_hashes(F.col("block"), seed), "name")
    names = written(names, "blocks")
    if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
        return names
    drop(names)
    return None


def _hashes(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed + i), block).alias(f"h{i + 1}") for i in range(2)]


def block_names(docs: DataFrame, facts: list[Column], body: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(level, name) with the given facts, one row for each row of docs: bodies are equal if and only if both level and name are.

    The number of rounds is the logarithm of the longest body's number of blocks; a round exchanges integers only. Joins on a name that very
    many rows share are plain sort-merge joins of such integers, which adaptive execution splits. An empty body is one empty block."""
    bodies, seed = docs.select(body.alias("body")), 0
    while (names := _named_blocks(bodies, block_bytes, seed)) is None:
        seed += 2
    pieces = F.transform(_blocks(body, block_bytes), lambda block: F.struct(*_hashes(block, seed)))
    rows = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*facts).alias("facts"), pieces.alias("pieces")), "hashed")  # key is fixed from here on
    at = rows.select("key", (F.size("pieces") - 1).alias("last"), F.posexplode("pieces").alias("at", "h"))
    longest = rows.agg(F.max(F.size("pieces"))).first()[0] or 1
    current = at.select("key", "last", "at", "h.h1", "h.h2").join(names, ["h1", "h2"]).select("key", "last", "at", "name")
    level, done = 0, None
    while True:
        ended = current.where("last = 0").select("key", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        if (longest - 1) >> level == 0:
            return rows.select("key", "facts").join(done, "key").select("facts.*", "level", "name")
        odd = F.col("at") % 2 == 1
        pairs = current.where("last > 0").groupBy("key", F.shiftright("last", 1).alias("last"), F.shiftright("at", 1).alias("at"))
        pairs = written(pairs.agg(F.max(F.when(~odd, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right")), "pairs")
        names = written(_numbered(pairs, ["left", "right"]), "pairnames")
        current = pairs.join(names, ["left", "right"]).select("key", "last", "at", "name")
        level += 1


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of equal texts: returns (id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    normalise maps the text column before texts are compared; by default nothing is changed. A null text counts as an
    empty one. Of equal texts the row with the largest id stays; rows that repeat an id with the same text are one
    document and share its fate. A row with a null id stays only if no equal text has an id. group_size counts rows. A very long text
    is only more blocks; an empty table gives an empty one; other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = (normalise(text) if normalise else text).cast("binary")
    names = block_names(docs, [F.col(id_col).alias("id"), F.sha2(body, 256).alias("text_sha256")], body, block_bytes)
    names = written(names, "named")
    groups = names.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    out = names.join(groups, ["level", "name"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() does not keep; all columns stay.

    What goes is matched by a merge join at every size, so that cost grows as the input does."""
    key, mark = free(docs.columns, "gone_id"), free(docs.columns, "gone_text")
    gone = exact_groups(docs, id_col, text_col).where("NOT kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(mark)).distinct()
    text = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return docs.join(written(gone, "gone").hint("merge"), F.col(id_col).eqNullSafe(F.col(key)) & (text == F.col(mark)), "left_anti")


def op6_block_naming(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = {
    "op6_block_naming": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
}
