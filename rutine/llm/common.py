"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rutine.plans.shipping import ship
from rutine.plans.tables import drop, written

__all__ = ["WORD", "arrow_batches", "drop", "ship", "table", "written"]

#: A word is a run of anything but blank and the controls tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table; any other column is left in the file."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: What a Python worker gets at once, in rows and in bytes, so that long texts do not pile up; one bound for all operators of a session.
ROWS, SIZE = 2000, "8m"


def arrow_batches(spark: SparkSession) -> None:
    """Ship the package, and bound what a Python worker gets at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SIZE)


def parts(df: DataFrame, size: int, least: int = 8) -> int:
    """How many parts of about `size` bytes of input df makes by the planner's estimate, which is that of its files; no fewer than the shuffle's."""
    spark = df.sparkSession
    n = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, -(-estimate // size)) if estimate < 1 << 60 else n  # tables that are not files have no estimate


def free(columns: list[str], name: str) -> str:
    """name, or a longer one if a column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _give_back() -> None:
    """Return what this process has freed to the system: a Python worker outlives its tasks, and would keep the most that it ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


#: What operators keep in a worker from one task to the next: a function for each that lets it go.
_kept: dict[str, Callable[[], None]] = {}


def keep(what: str, let_go: Callable[[], None]) -> None:
    """Tell that this process keeps something which tasks that do not need it shall let go."""
    _kept[what] = let_go


def _let_go(but: str) -> None:
    """Let go what tasks of other operators have kept in this process."""
    for what in [x for x in _kept if x != but]:
        _kept.pop(what)()


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """batches in slices of some rows, for work that takes many times the space of what it works on."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def lean_batches(run: Callable[[Iterable], Iterator], keeps: str = "") -> Callable[[Iterable], Iterator]:
    """run, a function over batches, giving back what it has freed after each batch and at its end, and before it what others have kept. keeps: what run itself keeps."""

    def lean(batches):
        _let_go(keeps)
        for out in run(batches):
            yield out
            del out
            _give_back()
        _give_back()

    return lean


def lean_group(answer: Callable) -> Callable:
    """answer, a function of a group, giving back what it has freed after each group."""

    @functools.wraps(answer)
    def lean(group: pa.Table) -> pa.Table:
        out = answer(group)
        _give_back()
        return out

    return lean
