"""Rows of files in splits against the rows of whole files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cryolog.sources import logfiles, splitlines

COLUMNS = ["file", "row_number", "raw_line", "fields", "ms", "source_timestamp_text", "problem", "warning", "rank"]


def write(folder):
    r = random.Random(4)
    line = lambda n: f"{n // 60 % 24}:{n % 60:02d};{r.choice(['1', '2,5', '', 'x'])}" + r.choice([";3", ";3", ";4;more", "", ";" + "9" * r.randint(1, 300)])
    body = lambda n, end="\n": "".join(line(i) + end + r.choice(["", "", "", end, "  " + end]) for i in range(n))
    head = "SAAT;RAF1;VACUM"
    files = {
        "LogFile_2026_01_01.csv": f"{head}\n{body(400)}", "LogFile_2026_01_02.csv": f"﻿{head}\r\n{body(300, chr(13) + chr(10))}", "LogFile_2026_01_03.csv": f"{head}\n{body(40)}7:00;1;2",
        "LogFile_2026_01_04.csv": f"\n{head}\n{body(30)}", "LogFile_2026_01_05.csv": f"{head}\n", "LogFile_2026_01_06.csv": head, "LogFile_2026_01_07.csv": "S" * 70_000 + f"\n{body(5)}",
        "LogFile_2026_01_01 (1).csv": f"{head}\n{body(9)}", "notes.txt": "no log\n", "LogFile_2026_01_08.csv": "\n\n\n", "LogFile_2026_01_09.csv": f"{head}\n{'1:00;1;2' * 3000}\n1:01;1;2\n",
    }
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    (folder / "LogFile_2026_01_10.csv").write_bytes(f"{head}\n".encode() + b"".join(b"4:%02d;1;%s\n" % (i, b"\xfe" if i % 7 == 3 else b"2") for i in range(60)))


def listed(df, columns):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in row) for row in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("size, cost", [(700, 0), (3_000, 4_000), (134_217_728, 4_194_304)])
def test_splits_equal_whole_files(spark, tmp_path, size, cost):
    write(tmp_path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(before, (size, cost), strict=True):
            spark.conf.set(k, v)
        whole = logfiles.with_header(logfiles.ranked(logfiles.listing(spark, str(tmp_path))))
        found = splitlines.lines(spark, str(tmp_path))
        parts = splitlines.splits(found)
        headed = logfiles.ranked(splitlines.with_header(parts))
        several = parts.groupBy("path").count().where("count > 1").count()
        assert several >= 4 if size < 10_000 else several == 0
        cut = [F.expr(f"transform({c}, x -> left(x, 1000)) AS {c}") for c in ("header", "codes")]
        states = ["file", "status", "reason", *cut, "stamp", "timed", "rank"]
        assert listed(headed, states) == listed(whole, states)
        rows = splitlines.log_rows(found, parts, headed)
        want = listed(logfiles.log_rows(whole), COLUMNS)
        assert len(want) > 700 and listed(rows, COLUMNS) == want
        assert listed(logfiles.report(rows), ["records", "rows", "channels", "warnings", "errors"]) == listed(logfiles.report(logfiles.log_rows(whole)), ["records", "rows", "channels", "warnings", "errors"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_other_splits_fail(spark, tmp_path):
    write(tmp_path)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        found = splitlines.lines(spark, str(tmp_path))
        spark.conf.set(size, 5_000)
        parts = splitlines.splits(found).cache()
        assert parts.count()
        spark.conf.set(size, 1_900)
        with pytest.raises(Exception, match="split in another way"):
            splitlines.log_rows(found, parts, splitlines.with_header(parts)).collect()
    finally:
        spark.conf.set(size, before)
