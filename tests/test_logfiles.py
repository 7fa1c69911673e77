"""Log files, batches, sinks and tails against expected outcomes of the sample cases."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cryolog.sources import batches, logfiles, sinks
from cryolog.streaming import tail


def parsed(spark, name, text):
    raw = text if isinstance(text, bytes) else text.encode()
    files = spark.createDataFrame([(f"d/{name}", "d", name, datetime(2026, 1, 1), bytearray(raw))], "path string, folder string, file string, modified timestamp, content binary")
    return logfiles.with_header(logfiles.ranked(files))


def outcome(spark, name, text):
    r = logfiles.report(logfiles.log_rows(parsed(spark, name, text))).first()
    return r and (r.records, r.rows, r.channels, r.warnings, r.errors)


CASES = [
    ("LogFile_2025_02_28.csv", "SAAT;L_PRES;RAF4;RECETE ADIM\n23:41:07;-1.5;12;2\n23:44:07.5;-1.25;12.5;2\n23:47:07;-1;13;3\n", (3, 3, 3, 0, 0)),
    ("LogFile_2025_03_01.csv", "SAAT;KOND;RAF2\n7:15;1;2\n7:16;1\n7:17;1;2;more\nnoon;1;2\n7:18;1;2\n", (5, 3, 2, 1, 3)),
    ("logfile_2025_03_01 (12).CSV", "SAAT;H_PRES\n7:15;4e-1\n", (1, 1, 1, 0, 0)),
    ("panel.csv", '\ufeffTARİH SAAT;serp2;e.tuketim;Kond\n3/11/2025 19:02:33;"-7,25";"1.204,75";"1,204.75"\n', (1, 1, 3, 0, 0)),
    ("LogFile_2025_03_01.csv", "SAAT;S1;S3\n1:01;-3;#N/A\n\n1:04;#REF!;4\n1:07;5;6\n", (3, 3, 2, 0, 2)),
    ("LogFile_2025_03_01.csv", "SAAT;RAF3\n4:20;1\n4:21;2\n4:19;3\n4:30;4\n", (4, 4, 1, 2, 0)),
    ("LogFile_2025_03_01.csv", b"SAAT;RAF3\n4:20;1\n4:22;\xfe\n", (2, 1, 1, 0, 1)),
    ("readings.csv", "SAAT;RAF3\n4:20;1\n", None),
    ("readings.csv", "TARIH SAAT;SAAT;RAF3\n", None),
]


@pytest.mark.parametrize("name, text, want", CASES)
def test_report(spark, name, text, want):
    assert outcome(spark, name, text) == want


def test_cells_and_steps(spark):
    header = "TARIH SAAT;RAF1 HEDEF;S 1;KOND;RECETE NO;RECETE ADIM"
    rows = logfiles.log_rows(parsed(spark, "new.csv", f"{header}\n2026-08-14-00:03:00.5;850;1;\"2;5\";6;4\n"))
    assert [(r.channel, r.value, r.quality) for r in logfiles.cells(rows).collect()] == [
        ("RAF1", 850.0, "good"), ("S1", 1.0, "good"), ("KONDANSER", None, "invalid"), ("RECETE NO", 6.0, "good"), ("RECETE ADIM", 4.0, "good")]
    assert logfiles.steps(rows).select("recipe_code", "state_code").first() == ("6", "STEP_4")


@pytest.mark.parametrize("text, want", [("SAAT;RAF1", "incomplete"), ("SAAT;RAF1\n", "ready"), ("RAF1\n", "invalid"), ("SAAT;RAF1;RAF 1\n", "invalid"), ("SAAT;;RAF1\n", "invalid"), ("SAAT\n", "invalid"), ("S" * 70000, "invalid"), ("\n", "invalid")])
def test_header(spark, text, want):
    assert parsed(spark, "LogFile_2026_08_14.csv", text).first().status == want


def test_growing_folder(spark, tmp_path):
    head = "TARIH SAAT;RAF1;VACUM\n"
    line = lambda day, minute, rest=";1;2": f"2026-08-{day}-00:{minute:02d}:00{rest}\n"
    first, second = tmp_path / "LogFile_2026_08_14.csv", tmp_path / "LogFile_2026_08_15.csv"
    none = spark.createDataFrame([], "path string, bytes long, records long")

    def step(progress):
        new, after = tail.advance(logfiles.ranked(logfiles.listing(spark, str(tmp_path), "logfile_*.CSV")), progress)
        kept = [(r.path, r.bytes, r.records) for r in after.collect()]
        return [r.seq for r in new.where("problem IS NULL").orderBy("seq").collect()], spark.createDataFrame(kept, none.schema), after.collect()

    first.write_text(head + line(14, 1) + "2026-08-14-00:02")
    (tmp_path / "LogFile_2026_08_14 (1).csv").write_text(head + line(14, 9))
    seqs, progress, _ = step(none)
    assert seqs == [1]
    first.write_text(head + line(14, 1) + line(14, 2, ";x;1;9") + line(14, 3).rstrip("\n"))
    assert step(progress)[0] == []
    second.write_text("TARIH SAAT;RAF1")
    seqs, progress, _ = step(progress)
    assert seqs == [3]  # drained at rotation; the rejected row keeps its sequence
    second.write_text(head + line(15, 1))
    seqs, progress, _ = step(progress)
    assert seqs == [4]
    second.write_text("TARIH SAAT;RAF1;VACUM\n")
    seqs, progress, after = step(progress)
    assert seqs == [] and {r.file: r.state for r in after}["LogFile_2026_08_15.csv"] == "shrunk"


def test_ranges(spark):
    rows = [(1, 0, 10), (2, 0, 10), (3, 10, 20), (4, 30, 40), (5, 20, 90), (6, 20, 30)]
    df = spark.createDataFrame([("s", "f", a, b, c, 50) for a, b, c in rows], "source string, file string, arrival int, from_byte int, to_byte int, size int")
    assert [r.verdict for r in tail.fold_ranges(df).orderBy("arrival").collect()] == ["accepted", "replay", "accepted", "hole", "beyond", "accepted"]


def sample(minute, seq, *channels):
    return {"sampled_at": f"2026-08-14T10:{minute:02d}:00Z", "source_sequence": seq, "measurements": [{"channel_code": c, "numeric_value": 1.0} for c in channels]}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_runs(spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, state string"), path)
    runs = spark.createDataFrame([(1,)], "run_id long")
    sinks.write_runs(spark.createDataFrame([], "run_id long, state string"), path, touched=runs)
    assert [tuple(r) for r in sinks.read_runs(spark, path).select("run_id", "state").collect()] == [(2, "b")]
    cells = spark.createDataFrame([(1, 1, "t1", "RAF1", "x;1", 1), (1, 2, "t2", "VACUM", "2", 2), (1, 2, "t2", "RAF1", "3", 1)], "run_id long, seq long, source_timestamp_text string, channel string, raw_text string, position int")
    names = sinks.channel_order(cells)
    sinks.export_file(cells, names, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ["TARIH SAAT;RAF1;VACUM", 't1;"x;1";', "t2;3;2"]


def test_violations(spark):
    rows = [{"run_id": 1, "batch_id": 1, "samples": [sample(0, 0, "RAF1"), sample(0, 1), sample(0, 2, " "), sample(0, 3, "RAF1")]}]
    df = batches.samples(spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", batches.SCHEMA).alias("b")).select("b.*"))
    assert sorted(r.reason for r in batches.violations(df).collect()) == ["channel without name", "no measurement", "sequence not positive"]
    assert batches.accepted(df).count() == 0


def test_rejected_rows_are_stored_once(spark):
    rows = logfiles.log_rows(parsed(spark, "LogFile_2025_03_01.csv", "SAAT;KOND;RAF2\n7:15;1;2\n7:16;1\nnoon;1;2\n7:18;1;2;x\n"))
    found = tail.rejected_rows(rows, spark.createDataFrame([], "run_id string, event_type string, metadata_json string"))
    assert sorted((r.run_id, r.row_number, r.event_type) for r in found.collect()) == [("d", 3, "csv_row_shape_warning"), ("d", 4, "csv_row_timestamp_error"), ("d", 5, "csv_row_shape_error")]
    assert tail.rejected_rows(rows, found).count() == 0 and tail.rejected_rows(rows, found.where("row_number = 4")).count() == 2


def test_source_text_of_times(spark):
    timed = logfiles.log_rows(parsed(spark, "LogFile_2025_03_01.csv", "SAAT;RAF2\n7:15;1\n07:16:02.25;1\n"))
    full = logfiles.log_rows(parsed(spark, "x.csv", "RAF2;TARIH SAAT\n1;1.3.2025 7:15\n"))
    assert [r.source_timestamp_text for r in timed.orderBy("row_number").collect()] == ["2025-03-01-07:15:00.000", "2025-03-01-07:16:02.250"]
    assert full.first().source_timestamp_text == "1.3.2025 7:15"


def test_missing_analyses(spark):
    samples = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "run_id long, seq long")
    left = tail.missing_analyses(samples, spark.createDataFrame([(2,), (2,), (9,)], "run_id long"))
    assert sorted(map(tuple, left.collect())) == [(1, 1), (1, 2), (3, 1)]


def test_imports_and_analyses_are_replaced_as_a_whole(spark, tmp_path):
    folder = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "run_id long, name string")
    stored = lambda name, *more: sorted(tuple(r) for r in sinks.read_runs(spark, f"{folder}/{name}").select("run_id", *more, "name").collect())
    for cells in (rows((1, "x"), (2, "y")), rows((1, "x"), (2, "z"))):
        sinks.write_import({"frames": rows((1, "a"), (2, "b")), "cells": cells, "events": rows()}, rows((1, "sha1"), (2, "sha2")), folder)
    assert stored("cells") == [(1, "x"), (2, "z")] and stored("events") == [] and stored("imports") == [(1, "sha1"), (2, "sha2")]
    sinks.write_analysis({"cycles": rows((1, "c"), (2, "d"))}, rows((1, ""), (2, "")), "p1", folder)
    sinks.write_analysis({"cycles": rows((1, "e"))}, rows((1, ""), (2, "")), "p2", folder)
    sinks.write_analysis({"cycles": rows((1, "f"))}, rows((1, ""), (2, "")), "p1", folder)
    assert stored("cycles", "profile") == [(1, "p1", "f"), (1, "p2", "e")]


def test_lossy_text(spark):
    texts = [b"\xef\xbb\xbfa\xffb", b"\xe2\x82x", b"\xc3\xa9;\xf0\x9f\x98\x80", b"", b"\xed\xa0\x80"]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, content binary")
    assert [r.t for r in df.select("i", logfiles.lossy_text(F.col("content")).alias("t")).orderBy("i").collect()] == [t.decode("utf-8-sig", errors="replace") for t in texts]
