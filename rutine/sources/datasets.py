"""Logs with their ground truth and hierarchies, by kind of source. Roots are parameters; nothing is read but what is asked for."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rutine.functions.scalars import numbers
from rutine.operators.scans import numbered
from rutine.operators.sequence import symbolize
from rutine.sources.logs import element_and_action, plain_names, read_csv, truth_table, unpivot_catalogue

#: Ground truth's own columns; a source may have more.
TRUTH = "caseid long, start_index long, length long, end_index long"

# Columns of the sources by level of their hierarchies, systems first and actions last.
SMARTRPA = [
    ["category"],
    ["application"],
    ["workbook", "browser_url", "title"],
    ["current_worksheet"],
    ["cell_range", "cell_range_number"],
    ["mouse_coord", "tag_category", "xpath", "event_src_path", "event_dest_path", "tag_name", "tag_title", "tag_href", "tag_innerText", "tab_pinned", "tab_audible", "tab_muted", "window_ingognito", "tab_moved_from_index", "tab_moved_to_index", "id"],
    ["concept:name", "eventQual"],
]
ACTIONLOGGER = [[], ["targetApp"], ["url", "target.workbookName"], ["target.sheetName"], ["target.id", "target.tagName", "target.type", "target.name", "target.href"], ["eventType"]]
HCI = [["machine"], ["idUIelement"], ["idUIaction"]]
# Starts, lengths and ends of the routines of the banking log.
BANKING = [(291, 55, 346), (1229, 52, 1281), (1508, 36, 1544), (2330, 35, 2365), (2662, 33, 2695), (2712, 40, 2752), (2764, 37, 2801), (2923, 45, 2968)]
#: How often each routine of an actionlogger log was planted, where the file does not say.
ACTIONLOGGER_OCCURRENCES = 50


@dataclass(frozen=True)
class Dataset:
    """log: (log_id, event_index, columns); truth: (caseid, start_index, length, end_index, ...), None where the source has none;
    levels: the log's columns by level of the hierarchy; app: those that tell applications apart."""

    log: DataFrame
    truth: DataFrame | None
    levels: list[list[str]]
    app: list[str]

    @property
    def columns(self) -> list[str]:
        return [c for level in self.levels for c in level]

    def symbolized(self, long: bool = False) -> Dataset:
        """With symbols of the whole hierarchy; columns that the log lacks are left out, and ValueError where it lacks all."""
        some = [c for c in self.columns if c in self.log.columns]
        if not some:
            raise ValueError(f"the log has none of {self.columns}")
        return replace(self, log=symbolize(self.log, some, long))

    def starts(self) -> DataFrame | None:
        """(caseid, start_index, length) of the truth."""
        return None if self.truth is None else self.truth.select("caseid", "start_index", "length")


def _names(levels: list[list[str]]) -> list[list[str]]:
    """Columns as plain_names() names them."""
    return [[c.replace(":", "_").replace(".", "_") for c in level] for level in levels]


def optional_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame | None:
    """A CSV table in its own column names, or None where no such file is. Any other fault is raised."""
    try:
        return spark.read.csv(path, header=True, sep=sep, encoding=encoding, nullValue="")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _numbered_cases(rows: DataFrame) -> DataFrame:
    """caseid from 0 in the order of start_index: a file's ground truth, a few rows for each routine."""
    return numbered(rows, [], ["start_index"], "caseid")


def smartrpa_shares(spark: SparkSession, root: str, name: str, validation: str, encoding: str = "utf-8") -> Dataset:
    """A log whose routines are listed by spot in a validation file (uiLogName, motifSpots, motifLength); without that file the truth is None.

    Spots named twice count once; cases are numbered by start; an end is start and length."""
    log = read_csv(spark, f"{root}/{name}", encoding=encoding)
    facts, truth = optional_csv(spark, f"{root}/{validation}"), None
    if facts is not None:
        rows = facts.where(F.col("uiLogName") == name)
        length = rows.agg(F.max(F.col("motifLength").cast("long")).alias("length"))  # one row
        spots = rows.select(F.explode(numbers(F.col("motifSpots"))).alias("start_index")).distinct()
        truth = truth_table(_numbered_cases(spots).crossJoin(F.broadcast(length)), "after").select("caseid", "start_index", "length", "end_index")
    return Dataset(log, truth, _names(SMARTRPA), _names(SMARTRPA)[0] + _names(SMARTRPA)[1])


def smartrpa_catalogue(spark: SparkSession, root: str, name: str, catalogue: str, encoding: str = "utf-8") -> Dataset:
    """A log whose routines are in a wide catalogue, noOfMotifs telling how many; without the catalogue the truth is None. An end is the last event covered."""
    log = read_csv(spark, f"{root}/{name}", encoding=encoding)
    wide, truth = optional_csv(spark, f"{root}/{catalogue}"), None
    if wide is not None:
        rows = wide.where(F.col("uiLogName") == name)
        motifs = rows.agg(F.max(F.col("noOfMotifs").cast("int"))).first()[0] or 0
        if motifs:
            truth = unpivot_catalogue(rows, motifs).drop("log_id").withColumnRenamed("case_id", "caseid")
    return Dataset(log, truth, _names(SMARTRPA), _names(SMARTRPA)[0] + _names(SMARTRPA)[1])


def banking(spark: SparkSession, root: str, name: str) -> Dataset:
    """The banking log, whose routines are known by their places."""
    truth = spark.createDataFrame([(i, *spot) for i, spot in enumerate(BANKING)], TRUTH)
    return Dataset(read_csv(spark, f"{root}/{name}", sep=";"), truth, _names(SMARTRPA), _names(SMARTRPA)[0] + _names(SMARTRPA)[1])


def actionlogger(spark: SparkSession, root: str, name: str, truth_name: str) -> Dataset:
    """A log and its ground truth (start_index, length, ...), both separated by semicolons; an end is start and length. A missing truth is None."""
    log = read_csv(spark, f"{root}/{name}", sep=";")
    rows = optional_csv(spark, f"{root}/{truth_name}", sep=";")
    if rows is not None:
        rows = plain_names(rows).withColumns({"start_index": F.col("start_index").cast("double").cast("long"), "length": F.col("length").cast("double").cast("long")})
        rows = truth_table(rows, "after").withColumn("total_occurrences", F.lit(ACTIONLOGGER_OCCURRENCES).cast("long"))
    levels = [c for c in _names(ACTIONLOGGER) if c]
    return Dataset(log, rows, levels, levels[0])


def truth_by_epoch(log: DataFrame, sequences: DataFrame, order: list[str]) -> DataFrame:
    """Ground truth of sequences (log_id, initepoch, endepoch): from the first event of the log (log_id, event_index, epoch) with the
    one epoch to the first with the other, both included, numbered from 0 in the given order within a log.

    (log_id, caseid, motif_id, start_index, length, end_index, discovery_count); a sequence with an epoch that its log does not have keeps its number, with null places."""
    first = log.where("epoch IS NOT NULL").groupBy("log_id", "epoch").agg(F.min("event_index").alias("_at"))
    rows = numbered(sequences, ["log_id"], order, "caseid").select("log_id", "caseid", "initepoch", "endepoch")
    for end, name in (("initepoch", "start_index"), ("endepoch", "end_index")):
        rows = rows.join(first.withColumnsRenamed({"epoch": end, "_at": name}), ["log_id", end], "left")
    return rows.select("log_id", "caseid", F.col("caseid").alias("motif_id"), "start_index", (F.col("end_index") - F.col("start_index") + 1).alias("length"), "end_index", F.lit(1).alias("discovery_count"))


def hci(spark: SparkSession, root: str, name: str, truth_name: str) -> Dataset:
    """Raw interactions (semicolons), idUIelement cut into element and idUIaction, with the truth of the sequences (commas) that begin and end at epochs; a missing truth is None."""
    log = element_and_action(read_csv(spark, f"{root}/{name}", sep=";"), "idUIelement")
    log = log.withColumn("idUIelement", F.col("element")).withColumn("idUIaction", F.col("action")).drop("element", "action")
    rows, truth = optional_csv(spark, f"{root}/{truth_name}"), None
    if rows is not None:
        of = F.lit(log.select("log_id").first()[0]) if not log.isEmpty() else F.lit(None).cast("string")
        times = [F.col(c).try_cast("double").alias(c) for c in ("initepoch", "endepoch")]
        rows = plain_names(rows).withColumn("_row", F.monotonically_increasing_id()).select(of.alias("log_id"), *times, "_row")
        truth = truth_by_epoch(log.withColumn("epoch", F.col("epoch").try_cast("double")), rows, ["_row"]).drop("log_id")
    return Dataset(log, truth, HCI, HCI[0])


#: Data sets by kind.
DATASETS = {"smartrpa_shares": smartrpa_shares, "smartrpa": smartrpa_catalogue, "banking": banking, "actionlogger": actionlogger, "hci": hci}


def load_dataset(spark: SparkSession, kind: str, root: str, **options) -> Dataset:
    if kind not in DATASETS:
        raise ValueError(f"no data set of kind {kind}: {', '.join(DATASETS)}")
    return DATASETS[kind](spark, root, **options)
