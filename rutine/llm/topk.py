"""Exact top-k search by columnar branch-and-bound.

Candidates lie in blocks in vertical layout, one row of a matrix for each dimension. For a query, partial inner products are
accumulated a few dimensions at a time; what the other dimensions can still add or take is bounded by the
product of the norms that remain (Cauchy and Schwarz). Candidates whose upper bound falls below the k-th largest lower bound
are dropped and the rest compacted before the next dimensions are touched.

A first round searches a bounded number of long candidates for every query: the k-th best score found there is a lower bound that goes with
the query to all other blocks. A block none of whose vectors is long enough to reach it is never sent the query; in the others, pruning
starts from it. Each block is prepared once and searched for the blocks of queries that come to it one after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.llm.common import arrow_batches, table, written

#: Vectors in a block of candidates, and of queries.
CANDIDATES, QUERIES = 8192, 256
#: Dimensions accumulated between two rounds of pruning.
STEP = 16
#: Candidates of a number of dimensions that the first round searches, and the bytes of all of them above which it is left out.
FIRST, FIRST_BYTES = 1024, 64 << 20
#: Above this a sum of products may not be whole in a double.
EXACT = 2.0**52
LONG = 2**63


def above(x):
    """No less than an inner product whose bound was rounded to x: some units in the last place for each of many dimensions, and a whole one."""
    return x * (1 + 1e-9) + 1.0


class Block:
    """Candidates in vertical layout: c (dimensions, candidates) of whole numbers, dimensions with much mass first, so that bounds tighten early."""

    def __init__(self, c: np.ndarray, ids: np.ndarray, step: int = STEP):
        self.raw, self.ids = c, ids
        self.most = float(np.abs(c.astype(float)).max(initial=0))
        if not self.fits(0.0):
            return
        c = c.astype(np.float64)
        self.order = np.argsort(-(c * c).sum(axis=1), kind="stable")
        self.c = np.ascontiguousarray(c[self.order])
        self.cuts = [*range(0, len(c), step), len(c)] if len(c) else [0, 0]
        self.rest = [np.sqrt((self.c[x:] ** 2).sum(axis=0)) for x in self.cuts]

    def fits(self, most: float) -> bool:
        return self.most * max(most, 1.0) * max(len(self.raw), 1) < EXACT

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, list[int]]]:
        """For each query (a row of q) the places of its k best candidates and their scores, best first, ties to the smaller id.

        A candidate with the id own[i] is not for query i. With floors, candidates that score below floors[i] may be left out."""
        ids, n = self.ids, self.raw.shape[1]
        if not self.fits(float(np.abs(q.astype(float)).max(initial=0))):  # wide numbers: Python's integers
            c, out = self.raw.astype(object), []
            for i in range(len(q)):
                may = np.flatnonzero(ids != own[i])
                s = [max(-LONG, min(LONG - 1, int(x))) for x in (q[i].astype(object) @ c[:, may] if len(c) else [0] * len(may))]
                order = sorted(range(len(may)), key=lambda j: (-s[j], ids[may[j]]))[:k]
                out.append((may[order], [s[j] for j in order]))
            return out
        c, cuts = self.c, self.cuts
        q = q.astype(np.float64)[:, self.order]
        rest_q = [np.sqrt((q[:, x:] ** 2).sum(axis=1)) for x in cuts]
        first, out = q[:, : cuts[1]] @ c[: cuts[1]], []
        for i in range(len(q)):
            alive, score = None, first[i]
            floor = -np.inf if floors is None else floors[i]
            live = np.flatnonzero(ids != own[i])
            if len(live) < n:
                alive, score = live, score[live]
            for j in range(1, len(cuts)):
                if j > 1:
                    part = c[cuts[j - 1] : cuts[j]]
                    score = score + q[i, cuts[j - 1] : cuts[j]] @ (part if alive is None else part[:, alive])
                if j < len(cuts) - 1 and (len(score) > k or floor > -np.inf):
                    slack = above(rest_q[j][i] * (self.rest[j] if alive is None else self.rest[j][alive]))
                    least = max(floor, np.partition(score - slack, len(score) - k)[len(score) - k]) if len(score) > k else floor
                    keep = np.flatnonzero(score + slack >= least)
                    if len(keep) < 0.8 * len(score):
                        alive = keep if alive is None else alive[keep]
                        score = score[keep]
            at = np.arange(n) if alive is None else alive
            least = max(floor, np.partition(score, len(score) - k)[len(score) - k]) if len(at) > k else floor
            keep = np.flatnonzero(score >= least)
            at, score = at[keep], score[keep]
            order = np.lexsort((ids[at], -score))[:k]
            out.append((at[order], [int(x) for x in score[order]]))
        return out


def search_block(c: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, step: int = STEP) -> list[tuple[np.ndarray, list[int]]]:
    """Block.search() of one block for one block of queries."""
    return Block(c, ids, step).search(q, own, k)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to size vectors of equal length: (block, dims, width, n, top, ids, body). body is query-major; top is the longest's length."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def block(dims):
            nonlocal made
            ids, values = held.pop(dims)
            top = max((float(np.sqrt((np.array(v, float) ** 2).sum())) for v in values), default=0.0)
            try:
                body, width = np.array(values, dtype=np.int64).reshape(len(ids), dims), 8
                if not body.size or (abs(body.min()) < 2**31 and abs(body.max()) < 2**31):
                    body, width = body.astype("<i4"), 4
                body = body.tobytes()
            except OverflowError:
                body, width = ",".join(str(x) for v in values for x in v).encode(), 0
            made += 1
            return pa.RecordBatch.from_pydict({"block": [(part << 33) + made], "dims": [dims], "width": [width], "n": [len(ids)], "top": [top], "ids": [np.array(ids, "<i8").tobytes()], "body": [body]}, schema)

        schema = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("width", pa.int32()), ("n", pa.int32()), ("top", pa.float64()), ("ids", pa.binary()), ("body", pa.binary())])
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.floor(1024.0 * np.array(v, np.float64))
                ids, values = held.setdefault(len(v), ([], []))
                ids.append(i)
                values.append(x.astype(np.int64) if not x.size or np.abs(x).max() < 2**62 else [int(y) for y in x])
                if len(ids) == size:
                    yield block(len(v))
        for dims in list(held):
            yield block(dims)

    return rows.mapInArrow(run, "block long, dims int, width int, n int, top double, ids binary, body binary")


def unpacked(ids: bytes, body: bytes, dims: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    if width:
        return ids, np.frombuffer(body, f"<i{width}").reshape(len(ids), dims)
    return ids, np.array([int(x) for x in body.split(b",")], dtype=object).reshape(len(ids), dims)


def _floored(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """q with floors, the k-th best score of each query among the first of the block with the longest candidates, and with the smallest of them."""
    first = c.groupBy("dims").agg(F.max_by(F.struct("width", "ids", "body", "n"), F.struct("top", "block")).alias("c"))
    some = F.least("c.n", F.lit(FIRST))
    ids = F.substring(F.col("c.ids"), F.lit(1), 8 * some)
    body = F.when(F.col("c.width") > 0, F.substring(F.col("c.body"), F.lit(1), F.col("c.width") * F.col("dims") * some))
    first = written(first.where("c.width > 0").select("dims", F.col("c.width").alias("c_width"), ids.alias("c_ids"), body.alias("c_body")), "first")
    bytes_ = first.agg(F.sum(F.octet_length("c_body") + F.octet_length("c_ids"))).first()[0] or 0
    if bytes_ <= FIRST_BYTES:  # measured, so that it may be broadcast
        q = q.join(F.broadcast(first), "dims", "left")
    else:
        q = q.withColumns({"c_width": F.lit(0), "c_ids": F.lit(None).cast("binary"), "c_body": F.lit(None).cast("binary")})

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                own, v = unpacked(r["ids"], r["body"], r["dims"], r["width"])
                floors = np.full(len(own), -np.inf)
                if r["c_body"] is not None:
                    ids, c = unpacked(r["c_ids"], r["c_body"], r["dims"], r["c_width"])
                    for i, (_, score) in enumerate(Block(c.T, ids).search(v, own, k)):
                        if len(score) == k and abs(score[-1]) < EXACT:
                            floors[i] = score[-1]
                yield pa.RecordBatch.from_pydict({"block": [r["block"]], "dims": [r["dims"]], "width": [r["width"]], "top": [r["top"]], "ids": [r["ids"]], "body": [r["body"]], "floors": [floors.tobytes()], "floor": [float(floors.min(initial=np.inf))]}, schema)

    schema = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("width", pa.int32()), ("top", pa.float64()), ("ids", pa.binary()), ("body", pa.binary()), ("floors", pa.binary()), ("floor", pa.float64())])
    return q.mapInArrow(run, "block long, dims int, width int, top double, ids binary, body binary, floors binary, floor double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates with the largest integer inner products for each query: (query_id, rank, vec_id, score).

    Components become floor(1024 * x). Every row is a candidate but for a query those with its own id; all are returned
    if there are fewer than k; ties go to the smaller id. A vector that is null or holds a null or non-finite
    component, or whose id is null, takes no part; an empty table gives an empty one; other columns are ignored. Vectors meet only vectors of
    their own length. Repeated query rows are one query each. Scores beyond a long stop at its ends.

    Queries and candidates are packed into blocks. A block of queries goes to those blocks of candidates whose longest vector can reach the
    floor of one of its queries (of a block whose length bound rules it out, nothing is read). No pair of rows is ever a row, only each block's k best."""
    arrow_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").where(fine)
    c = written(_packed(rows.select("id", "v"), CANDIDATES), "candidates")
    blocks = c.count()
    q = written(_packed(rows.where("asks").select("id", "v").repartition(max(1, min(blocks, 64))), QUERIES), "queries")
    q = written(_floored(q, c, k), "floored")
    # which blocks meet, from lengths and floors alone, dealt over salts
    salts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mine = c.select("block", "dims", F.col("top").alias("c_top")).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    theirs = q.select(F.col("block").alias("q_block"), "dims", "top", "floor").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    meet = mine.join(theirs, ["dims", "salt"]).where(F.col("c_top") * F.col("top") * (1 + 1e-9) + 1 >= F.col("floor")).select("block", "q_block")
    asked = meet.join(q.select(F.col("block").alias("q_block"), "dims", "width", "ids", "body", "floors"), "q_block")
    names = ["block", "q_block", "dims", "width", "ids", "body", "floors"]
    held = c.withColumns({"q_block": F.lit(None).cast("long"), "floors": F.lit(None).cast("binary")}).select(*names)
    both = held.unionByName(asked.select(*names)).repartition(max(salts, blocks // 64), "block").sortWithinPartitions("block", F.asc_nulls_first("q_block"))

    def run(batches):
        at, block = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids, v = unpacked(r["ids"], r["body"], r["dims"], r["width"])
                if r["q_block"] is None:
                    at, block = r["block"], Block(v.T, ids)
                    continue
                assert at == r["block"]  # a block's queries follow it
                out = ([], [], [], [], [])
                for place, (found, score) in enumerate(block.search(v, ids, k, np.frombuffer(r["floors"], np.float64))):
                    out[0].extend([r["q_block"]] * len(found))
                    out[1].extend([place] * len(found))
                    out[2].extend([int(ids[place])] * len(found))
                    out[3].extend(block.ids[found].tolist())
                    out[4].extend(score)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["block", "place", "query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "block long, place long, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id"), "score")


def op10_branch_and_bound(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE = {
    "op10_branch_and_bound": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
