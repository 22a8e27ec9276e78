"""Readers and writers of logs. Paths are parameters and go to Spark's readers, so any file system will do."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.functions.scalars import numbers, split_element_action
from rutine.operators.scans import LONG, numbered, running
from rutine.plans.tables import written

#: How a source's ground truth tells its end from start and length.
END_RULES = {"after": "start_index + length", "last": "start_index + length - 1"}


def plain_names(df: DataFrame) -> DataFrame:
    """Dots, colons and blanks in names become underscores."""
    return df.toDF(*[re.sub(r"[^0-9A-Za-z_]+", "_", c) for c in df.columns])


def in_file_order(df: DataFrame, log_id: str) -> DataFrame:
    """df with event_index, the place within the rows of log_id; Spark's row ids follow the order of a file."""
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    order = Window.partitionBy("log_id").orderBy("_file", "_row") if "_file" in df.columns else Window.partitionBy("log_id").orderBy("_row")
    return rows.withColumn("log_id", F.col(log_id)).withColumn("event_index", F.row_number().over(order) - F.lit(1).cast("long")).drop("_row")


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", log_id: str | None = None) -> DataFrame:
    """A CSV log with all values as text, empty ones null. log_id is the file's name, or the name given."""
    df = plain_names(spark.read.csv(path, header=True, sep=sep, encoding=encoding, nullValue=""))
    name = F.lit(log_id) if log_id else F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.[A-Za-z]+)?$", 1)
    return in_file_order(df.withColumn("_log", name), "_log").drop("_log")


def folder_files(spark: SparkSession, path: str, most_rows: int, pattern: str = "*.csv") -> DataFrame:
    """(file, header, rows, before) of a folder's files in the order of their names, up to before the one with which there would be more than most_rows.

    One scan of the folder as text gives each file's first line and its number of lines that are not blank; the running sum over files is dealt in blocks."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where("trim(value) <> ''")
    lines = lines.withColumn("_at", F.struct("file_block_start", F.monotonically_increasing_id().alias("_id")))
    files = lines.groupBy(F.col("file_path").alias("file")).agg(F.min_by("value", "_at").alias("header"), (F.count("*") - 1).alias("rows"))
    files = written(numbered(files, [], ["file"], "_place"), "files")
    files = running(files, [], "_place", {"_all": ("sum", F.col("rows"))})
    over = files.where(F.col("_all") > most_rows).agg(F.min("_place").alias("_over"))  # one row
    files = files.crossJoin(F.broadcast(over)).where("_over IS NULL OR _place < _over")
    return files.select("file", "header", "rows", (F.col("_all") - F.col("rows")).alias("before"))


def read_folder(spark: SparkSession, path: str, most_rows: int = 100_000, sep: str = ",", pattern: str = "*.csv", long: bool | None = None) -> DataFrame:
    """The CSV files of a folder as one log, in the order of their names, up to before the file that would exceed most_rows.

    Files may have different headers: those of one header are read by one scan, and missing columns are null. The driver holds the
    names of the files, as Spark does of any folder that it reads, and a schema for each header. `long` deals the numbering, which is done where there are a million
    rows or more, unless told. A row is a line."""
    layouts = folder_files(spark, path, most_rows, pattern).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"), F.sum("rows").alias("rows")).orderBy(F.get("files", F.lit(0))).collect()
    out = None
    for layout in layouts:
        part = spark.read.csv(layout.files, header=True, sep=sep, nullValue="")
        part = plain_names(part.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file of {path} fits into {most_rows} rows")
    out = out.withColumn("_row", F.monotonically_increasing_id()).withColumn("log_id", F.lit(path))
    order = ["_file", "_block", "_row"]
    if sum(layout.rows for layout in layouts) >= LONG if long is None else long:
        out = numbered(out, ["log_id"], order, "event_index")
    else:
        out = out.withColumn("event_index", F.row_number().over(Window.partitionBy("log_id").orderBy(*order)) - F.lit(1).cast("long"))
    return out.drop(*order)


def read_sensor_log(spark: SparkSession, path: str, log_id: str | None = None) -> DataFrame:
    """A sensor log, the symbol being the third word of a line: (log_id, event_index, symbol, ends_case). Delimiter lines
    `x x ON x` mark the event before them."""
    lines = spark.read.text(path).withColumn("_row", F.monotonically_increasing_id())
    name = F.lit(log_id) if log_id else F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)
    words = F.split("value", " ")
    rows = lines.where(F.size(words) >= 3).select(name.alias("log_id"), "_row", F.get(words, F.lit(2)).alias("symbol"), (F.get(words, F.size(words) - 1) == "x").alias("_mark"))
    order = Window.partitionBy("log_id").orderBy("_row")
    rows = rows.withColumn("ends_case", F.coalesce(F.lead("_mark").over(order), F.lit(False))).where("NOT _mark")
    return rows.select("log_id", (F.row_number().over(order) - F.lit(1).cast("long")).alias("event_index"), "symbol", "ends_case")


def write_sensor_log(log: DataFrame, truth_ends: DataFrame, path: str, stamp: str = "2025-12-14 10:00:10+01:00") -> None:
    """One log as sensor lines, with a delimiter line after the events in truth_ends (log_id, event_index)."""
    marks = truth_ends.select("log_id", "event_index").distinct().withColumn("_mark", F.lit(True))
    rows = log.select("log_id", "event_index", "symbol").join(marks, ["log_id", "event_index"], "left")
    line = F.format_string(f"{stamp} %s %s ON Other_Activity", "symbol", "symbol")
    lines = F.when(F.col("_mark"), F.array(line, F.lit(f"{stamp} x x ON x"))).otherwise(F.array(line))
    rows.select("event_index", F.posexplode(lines).alias("_k", "value")).orderBy("event_index", "_k").select("value").write.text(path)


def alphabet(log: DataFrame) -> DataFrame:
    """A line for each log: `sensor` and its sorted symbols."""
    return log.groupBy("log_id").agg(F.concat_ws(" ", F.lit("sensor"), F.sort_array(F.collect_set("symbol"))).alias("line"))


def pattern_lines(log: DataFrame, truth: DataFrame, action: str) -> DataFrame:
    """(log_id, line) of the distinct action sequences of truth (log_id, start_index, length), `a -1 b -1 -2`, by first appearance."""
    spans = truth.where("length > 0").select("log_id", "start_index", F.explode(F.expr("sequence(start_index, start_index + length - 1)")).alias("event_index"))
    rows = spans.join(log.select("log_id", "event_index", F.replace(F.trim(F.col(action)), F.lit(" "), F.lit("")).alias("_a")), ["log_id", "event_index"])
    words = rows.groupBy("log_id", "start_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "_a"))), lambda x: x["_a"]).alias("_w"))
    lines = words.withColumn("line", F.concat(F.array_join("_w", " -1 "), F.lit(" -1 -2")))
    return lines.groupBy("log_id", "line").agg(F.min("start_index").alias("first_index"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, actions) of a pattern file."""
    lines = spark.read.text(path).withColumn("_row", F.monotonically_increasing_id())
    words = F.filter(F.split(F.regexp_replace("value", " -1 -2\\s*$", ""), " -1 "), lambda w: w != "")
    return lines.where("trim(value) <> ''").select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_row")) - 1).alias("line_number"), words.alias("actions"))  # one small file


def element_and_action(df: DataFrame, column: str) -> DataFrame:
    element, action = split_element_action(F.col(column))
    return df.withColumn("element", element).withColumn("action", action)


def index_of_value(log: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """keys with the first event_index of their value in the log."""
    return keys.join(log.groupBy("log_id", column).agg(F.min("event_index").alias("event_index")), ["log_id", column], "left")


def truth_table(rows: DataFrame, end_rule: str = "last") -> DataFrame:
    """Ground truth (log_id, motif_number, start_index, length, ...) with end_index by the source's rule."""
    return rows.withColumn("end_index", F.expr(END_RULES[end_rule]))


def unpivot_catalogue(df: DataFrame, motifs: int) -> DataFrame:
    """A wide catalogue (uiLogName, motif{i}-length, -occurances, -shuffle, -startIndexes, -caseID) as one row for each planted motif.

    Start indexes are distinct; end_index is the last one covered; shuffle is cut to a whole number."""
    each = [F.struct(F.lit(i).alias("motif_number"), F.col(f"`motif{i}-length`").cast("long").alias("length"), F.col(f"`motif{i}-occurances`").cast("long").alias("total_occurrences"), F.col(f"`motif{i}-shuffle`").cast("double").cast("int").alias("shuffle"), F.col(f"`motif{i}-startIndexes`").cast("string").alias("_starts"), F.col(f"`motif{i}-caseID`").cast("string").alias("case_id")) for i in range(motifs)]
    rows = df.select(F.col("uiLogName").alias("log_id"), F.explode(F.array(*each)).alias("_m")).select("log_id", "_m.*").where("length IS NOT NULL")
    rows = rows.withColumn("start_index", F.explode(F.array_distinct(numbers(F.col("_starts"))))).drop("_starts")
    return truth_table(rows)


def to_process(catalogue: DataFrame, done: DataFrame, key: str, size: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows to run, rows that are too large, with an error_message) of a catalogue without what is done already, errors included."""
    left = catalogue.join(done.select(key).distinct(), key, "left_anti")
    over = left.where(F.col(size) > limit).withColumn("error_message", F.format_string(f"{size} %d is over %d", F.col(size).cast("long"), F.lit(limit)))
    return left.where(F.col(size) <= limit), over


def append_results(df: DataFrame, path: str, key: str = "log_id") -> None:
    """Add result rows, a folder for each key; a resumed run adds only what to_process() leaves."""
    df.write.mode("append").partitionBy(key).option("header", True).csv(path)


#: Readers by kind of source.
SOURCES: dict[str, Callable[..., DataFrame]] = {"csv": read_csv, "folder": read_folder, "sensor": read_sensor_log, "smartrpa": read_csv, "actionlogger": lambda spark, path, **k: read_csv(spark, path, sep=";", **k), "hci": lambda spark, path, **k: read_csv(spark, path, sep=";", **k)}


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in SOURCES:
        raise ValueError(f"no source of kind {kind}: {', '.join(SOURCES)}")
    return SOURCES[kind](spark, path, **options)
