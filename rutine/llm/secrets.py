"""Secret scans with corpus-wide ownership frequency.

Each text is scanned once for the base kinds and for further strings that look like live credentials. The hashes of
all found values are counted by distinct owners and repositories over the whole corpus: a value under many owners is a
widely copied example; one that only a few owners have, and that looks live, is added to the findings.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rutine.llm.common import arrow_batches, table, written

#: Kinds in the order in which they are listed; the last is the one that the method adds.
KINDS = ("assign", "access", "hex", "owned")
#: A value under more owners than this is a copied example.
MOST_OWNERS = 2
#: A value of few owners that is in more repositories than this is shared among them.
MOST_REPOSITORIES = 3
#: Bits a character, over the value's own characters, below which a value does not look live.
LEAST_BITS = 3.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{16,}")  # the same as [0-9a-f]+ of 16 or more: a match is a whole run
OTHER = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WORDS = re.compile("password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Mixed characters without an obvious filler."""
    some = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return some and bits(value) >= LEAST_BITS and not re.search("example|placeholder|xxxx|0000|1234", value, re.IGNORECASE)


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every base finding and of every other candidate that looks live, by start and kind.

    Offsets are code points, ends exclusive. Candidates that overlap a base finding are left to it."""
    found = []
    if WORDS.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted(found)
    at = 0
    for m in OTHER.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        if not any(b[0] < m.end() and b[2] > m.start() for b in base[at : at + 3]) and looks_live(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def find_secrets(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Findings of every text: returns (id, found), one row for each row of docs.

    found is an array of (start, kind, end, value_hash, live, owners, repositories, verdict) by start and kind. A value under more than most_owners owners is
    'copied', an example that is handed around; one of few owners but in more than most_repositories repositories is 'shared' within them; all
    others are 'specific' to their owner. Both counts are over the whole corpus, and base findings are judged as well; they stay whatever the verdict, candidates
    of the added kind only where it isn't 'copied'. A null text is an empty one and has none; a very long one is scanned whole. A null owner or repository counts as one of its own, and
    a repository is one of its owner's: rows that repeat both count once. An empty table gives an empty one, and other columns are ignored. Texts are read once and never shuffled; what
    is counted is one row for each finding, first within a (value, owner, repository), so that a value copied into a third of
    all rows meets as counts only."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repo"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    item = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("live", pa.bool_())])

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(3).to_pylist():
                out.append([{"start": s, "kind": k, "end": e, "value": xxhash.xxh3_64_intdigest(v) - 2**63, "live": k == 3 or looks_live(v)} for s, k, e, v in scan(text or "")])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(item))], names=["id", "owner", "repo", "found"])

    scanned = rows.mapInArrow(run, f"id {kind}, owner string, repo string, found array<struct<start:int,kind:int,end:int,value:bigint,live:boolean>>")
    scanned = written(scanned.withColumn("key", F.monotonically_increasing_id()), "scanned")
    each = scanned.where(F.size("found") > 0).select("key", "owner", "repo", F.explode("found").alias("f"))
    once = each.groupBy(F.col("f.value").alias("value"), "owner", "repo").agg(F.count("*").alias("times"))
    by_owner = once.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    spread = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    spread = written(spread, "spread")
    verdict = F.when(F.col("owners") > most_owners, "copied").when(F.col("repos") > most_repositories, "shared").otherwise("specific")
    judged = each.withColumn("value", F.col("f.value")).join(spread, "value").withColumn("verdict", verdict).where("f.kind < 3 OR verdict <> 'copied'")
    facts = F.struct("f.start", "f.kind", "f.end", F.col("value").alias("value_hash"), "f.live", "owners", F.col("repos").alias("repositories"), "verdict")
    judged = judged.groupBy("key").agg(F.array_sort(F.collect_list(facts)).alias("found"))
    out = scanned.select("key", "id").join(judged, "key", "left")
    none = F.array().cast(judged.schema["found"].dataType)
    return out.select(F.col("id").alias(id_col), F.coalesce("found", none).alias("found"))


def spelled(found: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op9_ownership(spark, sf_dir: str) -> DataFrame:
    """A source is an owner and a document a repository."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    out = find_secrets(docs, F.col("source"), F.col("doc_id"))
    base = F.filter("found", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    told = lambda v: F.size(F.filter("found", lambda x: x["verdict"] == v)).cast("long")
    live = F.size(F.filter("found", lambda x: x["live"] & (x["verdict"] == "specific"))).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"),
        told("copied").alias("n_copied"), told("shared").alias("n_shared"), told("specific").alias("n_specific"), live.alias("n_live"), count(3).alias("n_owned"),
    )
