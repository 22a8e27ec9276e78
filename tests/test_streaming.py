"""Streams driven by files to their ends."""

import time

from pyspark.sql import functions as F

from rutine.streaming import logs


def drive(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def source(spark, tmp_path):
    rows = [(1, i, "ab"[i // 3 % 2], f"2024-01-01 0{i // 4}:{i % 4}0:00") for i in range(12)] + [(2, 0, "a", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "log_id long, event_index long, event_type string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def test_app_runs(spark, tmp_path):
    got = sorted(tuple(r) for r in drive(logs.app_runs(source(spark, tmp_path)), "runs", spark))
    assert got == [(1, "a", 0, 2, 3), (1, "a", 6, 8, 3), (1, "b", 3, 5, 3)]


def test_windows(spark, tmp_path):
    got = drive(logs.type_counts(source(spark, tmp_path), "60 minutes"), "counts", spark)
    assert sum(r["count"] for r in got) == 12
    got = drive(logs.sessions(source_again(spark, tmp_path), "20 minutes"), "sess", spark)
    assert sorted(r.events for r in got) == [4, 4, 4]


def source_again(spark, tmp_path):
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")


def test_idle_logs_end(spark, tmp_path):
    """The last run of a log comes out once the watermark has passed it, and its state goes."""
    days = [[(1, i, "ab"[i // 3], f"2024-01-01 00:0{i}:00") for i in range(5)], [(2, 0, "a", "2024-01-03 00:00:00")], [(2, 1, "a", "2024-01-03 00:01:00")], [(3, 0, "c", "2024-01-09 00:00:00")], [(3, 1, "c", "2024-01-09 00:00:01")]]
    for n, rows in enumerate(days):
        df = spark.createDataFrame(rows, "log_id long, event_index long, event_type string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/idle")
        time.sleep(1.1)  # files are taken in order of their times
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/idle")
    got = sorted(tuple(r) for r in drive(logs.app_runs(events, ts="ts"), "idle", spark))
    assert got == [(1, "a", 0, 2, 3), (1, "b", 3, 4, 2), (2, "a", 0, 1, 2)]
