"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Lets a query's shuffle files go with it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark broadcasts what is small as a file, and packed files are many times larger as rows, all of which pass the driver. What written() writes broadcasts no more than this.
BROADCAST, MOST = "spark.sql.autoBroadcastJoinThreshold", 256 << 10
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(told: str) -> int:
    """A size as Spark writes it, 10485760b or 256k."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)b?", told.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's spark.checkpoint.dir; a temporary one only where that is unset."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        told = f"file://{tempfile.gettempdir()}/rutine-checkpoints"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return told.rstrip("/")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet into the shared folder, partitioned by columns if named, and read it back.

    This cuts the lineage: a lost executor costs no recomputation beyond this table, and
    values that depend on the order of evaluation are fixed. Shuffle files of the writing go when it ends; the table goes
    when the JVM ends, or by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rutine-{name}-{uuid.uuid4().hex}"
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BROADCAST: spark.conf.get(BROADCAST)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BROADCAST, str(min(MOST, _bytes(before[BROADCAST]))))
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._rutine_path = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema made by written(), read as one: a plan is as large with many of them as with one."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[df._rutine_path for df in tables])


def drop(*tables: DataFrame, part: str = "") -> None:
    """Remove tables made by written(), or a part of them (column=value), whose readers are done."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(f"{df._rutine_path}/{part}")
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
