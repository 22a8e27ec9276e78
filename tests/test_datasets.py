"""Folders of files with several headers, and logs with their ground truth."""

import pytest

from rutine.sources import datasets, logs


def test_folder_with_a_budget(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x.y;z\n1;2\n\n;4\n")
    (tmp_path / "b.csv").write_text("z;w\n5;6\n")
    (tmp_path / "c.csv").write_text("x.y;z\n")
    (tmp_path / "d.csv").write_text("x.y;z\n7;8\n")
    (tmp_path / "e.txt").write_text("x.y;z\n7;8\n")
    want = [(0, "1", "2", None), (1, None, "4", None), (2, None, "5", "6"), (3, "7", "8", None)]
    for most, n in ((100, 4), (4, 4), (3, 3), (2, 2)):
        for long in (False, True):
            got = logs.read_folder(spark, str(tmp_path), most, ";", long=long)
            got = got.select("event_index", "x_y", "z", *(["w"] if n > 2 else [])).orderBy("event_index").collect()
            assert [tuple(r) for r in got] == [w[: len(r)] for w, r in zip(want[:n], got, strict=True)]
    files = logs.folder_files(spark, str(tmp_path), 100).orderBy("file").collect()
    assert [(r.file[-5:], r.rows, r.before) for r in files] == [("a.csv", 2, 0), ("b.csv", 1, 2), ("c.csv", 0, 3), ("d.csv", 1, 3)]
    with pytest.raises(ValueError):
        logs.read_folder(spark, str(tmp_path), 1, ";")


def test_interactions_with_sequences(spark, tmp_path):
    rows = ["machine;idUIelement;epoch", "m;Button12click;10", "m;Text3write;20", "m;Text3write;20", "m;Button12;30", "m;odd;40"]
    (tmp_path / "raw.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "seq.csv").write_text("initepoch,endepoch,who\n20.0,30.0,a\n10.0,20.0,b\n10.0,99.0,c\n")
    got = datasets.load_dataset(spark, "hci", str(tmp_path), name="raw.csv", truth_name="seq.csv")
    log = got.log.orderBy("event_index").collect()
    assert [(r.idUIelement, r.idUIaction) for r in log] == [("Button12", "click"), ("Text3", "write"), ("Text3", "write"), ("Button12", ""), (None, None)]
    truth = got.truth.orderBy("caseid").collect()
    assert [(r.caseid, r.start_index, r.length, r.end_index) for r in truth] == [(0, 1, 3, 3), (1, 0, 2, 1), (2, 0, None, None)]
    assert got.columns == ["machine", "idUIelement", "idUIaction"] and got.app == ["machine"]
    symbols = {r.event_index: r.symbol for r in got.symbolized().log.collect()}
    assert symbols[1] == symbols[2] != symbols[0]
    assert datasets.hci(spark, str(tmp_path), "raw.csv", "none.csv").truth is None


def test_logs_with_validation_files(spark, tmp_path):
    (tmp_path / "log.csv").write_text("category,application,concept:name\n" + "c,a,x\n" * 30)
    args = {"name": "log.csv", "validation": "shares.csv"}
    assert datasets.smartrpa_shares(spark, str(tmp_path), **args).truth is None
    (tmp_path / "shares.csv").write_text('uiLogName,motifSpots,motifLength\nlog.csv,"[7, 3]",5\nlog.csv,"[3]",5\nother.csv,"[9]",2\n')
    got = datasets.smartrpa_shares(spark, str(tmp_path), **args)
    assert sorted(map(tuple, got.truth.collect())) == [(0, 3, 5, 8), (1, 7, 5, 12)]
    assert got.app == ["category", "application"] and "concept_name" in got.columns and got.symbolized().log.count() == 30
    wide = "uiLogName,noOfMotifs,motif0-length,motif0-occurances,motif0-shuffle,motif0-startIndexes,motif0-caseID,motif1-length,motif1-occurances,motif1-shuffle,motif1-startIndexes,motif1-caseID\n"
    (tmp_path / "wide.csv").write_text(wide + 'log.csv,2,5,2,0.2,"[3, 9]",c0,4,1,0,"[20]",c1\n')
    truth = datasets.load_dataset(spark, "smartrpa", str(tmp_path), name="log.csv", catalogue="wide.csv").truth.orderBy("start_index").collect()
    assert [(r.motif_number, r.caseid, r.start_index, r.end_index, r.total_occurrences) for r in truth] == [(0, "c0", 3, 7, 2), (0, "c0", 9, 13, 2), (1, "c1", 20, 23, 1)]
    (tmp_path / "acts.csv").write_text("targetApp;eventType\nx;y\n")
    (tmp_path / "truth.csv").write_text("caseid;start_index;length\n1;4;3\n")
    got = datasets.actionlogger(spark, str(tmp_path), "acts.csv", "truth.csv")
    assert [(r.start_index, r.end_index, r.total_occurrences) for r in got.truth.collect()] == [(4, 7, 50)] and got.columns[0] == "targetApp"
    assert datasets.banking(spark, str(tmp_path), "acts.csv").truth.where("end_index = start_index + length").count() == 8
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, "kafka", "x")
