"""Numbering and running totals of sequences of any length: one key's rows are dealt over many tasks.

A window partitioned by a key alone sends all of the key's rows to one task. Here the rows of a key are cut into blocks of consecutive
places; what is before a block is carried to it by a row for each block, so a key that holds most of all rows is as many tasks as it has blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from rutine.plans.tables import written

#: Places of a key that one task scans at once.
BLOCK = 1 << 14


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Keys are equal; nulls equal nulls. Those of right have a leading underscore."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys], F.lit(True))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "place", parts: int | None = None) -> DataFrame:
    """df with the place, from 0, of each row among the rows of its keys in the given order, nulls first.

    Rows are dealt by ranges of (keys, order), so that a key's rows may lie in many parts, sorted and written; a part's rows know their place in the
    part, and a row for each (key, part) tells how many came before. Nulls in keys are a key. Rows that agree in keys and order are
    numbered in any order. Without keys all rows are one sequence: only a row for each part meets in one task. Columns named _part or _in would clash."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_in", F.monotonically_increasing_id())
    rows = written(sorted_, "ranged").withColumn("_part", F.shiftright("_in", 33))
    starts = rows.groupBy(*keys, "_part").agg(F.min("_in").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    starts = _renamed(starts, [*keys, "_part"])
    return rows.join(starts, _same(rows, starts, keys) & (rows["_part"] == starts["__part"])).select(*df.columns, (F.col("_in") + F.col("_base")).alias(name))


#: How a running value is made of values, and how the whole of a block is told.
_KINDS = {
    "sum": (F.sum, lambda v, at: F.sum(v)),
    "max": (F.max, lambda v, at: F.max(v)),
    "min": (F.min, lambda v, at: F.min(v)),
    "count": (F.count, lambda v, at: F.count(v)),
    "last": (lambda v: F.last(v, ignorenulls=True), lambda v, at: F.max_by(v, F.when(v.isNotNull(), at))),
}


def _with_carry(kind: str, carry: Column, near: Column) -> Column:
    """What came before the block and what came in it, as one; either may be null."""
    if kind in ("sum", "count"):
        return F.when(carry.isNull() & near.isNull(), None).otherwise(F.coalesce(carry, F.lit(0)) + F.coalesce(near, F.lit(0)))
    if kind == "last":
        return F.coalesce(near, carry)
    return F.greatest(carry, near) if kind == "max" else F.least(carry, near)


def running(df: DataFrame, keys: list[str], at: str, values: dict[str, tuple[str, Column]], block: int = BLOCK, itself: bool = True) -> DataFrame:
    """df with running values: {name: (kind, column)}, over the rows of the same keys with a smaller `at`, and the row itself if `itself`.

    kind is sum, max, min, count or last (the latest that is not null). Nulls don't count; where nothing came yet the value is null (a count 0).
    `at`, an integer, is distinct within keys; gaps and negative places may be there. df is read twice: write it first if it is dear."""
    rows = df.withColumn("_block", F.floor(F.col(at) / block))
    whole = rows.groupBy(*keys, "_block").agg(*[_KINDS[kind][1](v, F.col(at)).alias(f"_far_{name}") for name, (kind, v) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*keys, "_block", *[(F.sum if kind == "count" else _KINDS[kind][0])(F.col(f"_far_{name}")).over(before).alias(f"_far_{name}") for name, (kind, _) in values.items()])
    inside = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    near = rows.withColumns({f"_near_{name}": _KINDS[kind][0](v).over(inside) for name, (kind, v) in values.items()})
    carried = _renamed(carried, [*keys, "_block"])
    out = near.join(carried, _same(near, carried, keys) & (near["_block"] == carried["__block"]))
    done = {name: _with_carry(kind, F.col(f"_far_{name}"), F.col(f"_near_{name}")) for name, (kind, _) in values.items()}
    return out.select(*df.columns, *[c.alias(name) for name, c in done.items()])


#: Rows of a log from which on it is worth dealing it in blocks.
LONG = 1 << 20


def has_long(df: DataFrame, key: str = "log_id", least: int = LONG) -> bool:
    """Whether some key has so many rows that it should be dealt in blocks."""
    return not df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).isEmpty()


def beside(df: DataFrame, keys: list[str], at: str, before: int, after: int, block: int = BLOCK) -> tuple[DataFrame, WindowSpec]:
    """(rows, window): df dealt in blocks with the rows up to `before` places before and `after` places after each block, and a window in order of `at` over a block.

    Places are distinct integers without gaps. Functions over frames that reach no further are right in rows with _own, which are those of df."""
    blocks = F.sequence(F.floor((F.col(at) - after) / block), F.floor((F.col(at) + before) / block))
    rows = df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == F.floor(F.col(at) / block))
    return rows, Window.partitionBy(*keys, "_block").orderBy(at)
