"""Log files as DataFrames: listing, order, header checks, rows, cells, row events and reports.

A file is one row with its bytes, as daily logs are small; work is dealt by file and nothing but a file's own rows is ever
grouped.  Files of many GB are for ``splitlines``, which gives the same rows from splits of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.profile import STEP_COLUMNS
from ..operators import ingest

HEADER_BYTES = 65536


def listing(spark: SparkSession, folder: str, pattern: str = "*.csv", copies: bool = False) -> DataFrame:
    """path, folder, file, modified, content of files whose name matches ``pattern`` (one ``*``, any case); numbered download copies only on request."""
    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").load(folder).select("path", name.alias("file"), F.col("modificationTime").alias("modified"), "content")
    found = found.withColumn("folder", F.expr("left(path, length(path) - length(file) - 1)"))
    return found.where(wanted(F.col("file"), pattern, copies))


def wanted(name: Column, pattern: str = "*.csv", copies: bool = False) -> Column:
    """Whether a file of this name is read."""
    matches = name.rlike("(?i)^" + ".*".join(rf"\Q{part}\E" for part in pattern.split("*", 1)) + "$")
    return matches if copies else matches & ~F.coalesce(parse.is_download_copy(name), F.lit(False))


def ranked(files: DataFrame, by: str = "folder") -> DataFrame:
    """``rank`` within a folder: dated files by date and path, then the others by modification time and path."""
    date = parse.file_date(F.col("file"))
    order = Window.partitionBy(by).orderBy(date.isNull(), date, F.when(date.isNull(), F.col("modified")), "path")
    return files.withColumn("rank", F.row_number().over(order).cast("long"))


def unseen(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Files with a content (``sha256``) that is not ``imported`` yet; of equal ones the first path."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("path"))
    return hashed.withColumn("_n", first).where("_n = 1").drop("_n").join(imported.select("sha256"), "sha256", "left_anti")


def _text() -> Column:
    return F.regexp_replace(F.col("content").cast("string"), "^﻿", "")


def lossy_text(content: Column) -> Column:
    """Bytes as text: what is no UTF-8 becomes U+FFFD, and a byte order mark at the start goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


def split_fields(line: Column) -> Column:
    """Fields between semicolons outside quotes, trimmed and unquoted."""
    parts = F.split(line, r';(?=(?:[^"]*"[^"]*")*[^"]*$)')
    plain = lambda x: F.when(x.rlike('^".*"$'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.transform(parts, lambda x: F.trim(x)), lambda x: F.trim(plain(x)))


def with_header(files: DataFrame) -> DataFrame:
    """header, codes (null at the timestamp), stamp (its place), timed (time of day only), date, status (ready, incomplete, invalid) and reason."""
    line = F.regexp_replace(F.substring_index(_text(), "\n", 1), "\r$", "")
    return judged_header(files.withColumns({"line": line, "complete": F.instr(_text(), "\n") > 0}))


def judged_header(files: DataFrame) -> DataFrame:
    """``with_header`` of files with their first ``line`` and whether it is ``complete``."""
    out = files.withColumn("date", parse.file_date(F.col("file")))
    out = out.withColumn("header", split_fields(F.col("line")))
    code = lambda x: F.when(~parse.is_timestamp_header(x), parse.canonical_channel(x))
    out = out.withColumn("codes", F.transform("header", code))
    own = F.filter("codes", lambda x: x.isNotNull())
    stamps = F.size("codes") - F.size(own)
    out = out.withColumns({
        "stamp": F.array_position(F.transform("codes", lambda x: x.isNull()), F.lit(True)).cast("int"),
        "timed": F.exists("header", lambda x: F.upper(F.translate(x, "İı", "II")) == "SAAT"),
    })
    large = F.octet_length("line") > HEADER_BYTES
    reason = (
        F.when(large, "header too large").when(~F.col("complete"), None).when(F.trim("line") == "", "empty header").when(stamps != 1, "not one timestamp column")
        .when(F.col("timed") & F.col("date").isNull(), "no date in the file name").when(F.exists(own, lambda x: x == ""), "channel without name")
        .when(F.size(F.array_distinct(own)) < F.size(own), "channel twice").when(F.size(own) == 0, "no channel")
    )
    status = F.when(F.col("reason").isNotNull(), "invalid").when(F.col("complete"), "ready").otherwise("incomplete")
    return out.withColumn("reason", reason).withColumn("status", status).drop("line", "complete")


def barrier(headed: DataFrame, by: str = "folder") -> DataFrame:
    """``readable``: ready, and no file of an earlier rank is incomplete.  An invalid one is skipped."""
    held = F.max((F.col("status") == "incomplete").cast("int")).over(Window.partitionBy(by).orderBy("rank")) == 1
    return headed.withColumn("readable", ~held & (F.col("status") == "ready"))


def log_rows(headed: DataFrame) -> DataFrame:
    """A row for each record of ready files: row_number (header is 1, blank lines do not count), fields, moment, problem, warning."""
    lines = F.filter(F.split(_text(), "\r?\n"), lambda x: F.trim(x) != "")
    files = headed.where("status = 'ready'").withColumns({"lines": lines, "whole": F.is_valid_utf8(F.col("content").cast("string"))})
    kept = [c for c in files.columns if c not in ("content", "lines", "reason")]
    rows = files.select(*kept, F.posexplode(F.expr("slice(lines, 2, size(lines))")).alias("pos", "raw_line"))
    rows = rows.withColumns({"row_number": (F.col("pos") + 2).cast("long"), "fields": split_fields(F.col("raw_line"))})
    return judged(rows).drop("pos", "whole")


def judged(rows: DataFrame) -> DataFrame:
    """Numbered lines of ready files (raw_line, fields, whole: valid bytes) with moment, ms, source_timestamp_text, problem and
    warning."""
    text = F.get("fields", F.col("stamp") - 1)
    moment = F.when(F.col("timed"), parse.clock_timestamp(text, F.col("date"))).otherwise(parse.log_timestamp(text))
    extra = F.exists(F.slice("fields", F.size("header") + 1, F.size("fields")), lambda x: x != "")
    broken = ~F.col("whole") & F.col("raw_line").contains("�")
    problem = F.when(broken, "csv_row_decode_error").when(extra, "csv_row_shape_error").when(F.col("moment").isNull(), "csv_row_timestamp_error")
    uneven = ~broken & ~extra & (F.size("fields") != F.size("header"))
    rows = rows.withColumn("moment", moment).withColumns({"problem": problem, "warning": F.when(uneven, "csv_row_shape_warning")})
    stamp_text = F.when(F.col("timed"), F.date_format("moment", "yyyy-MM-dd-HH:mm:ss.SSS")).otherwise(text)
    return rows.withColumns({"ms": parse.epoch_ms("moment"), "source_timestamp_text": stamp_text})


def cells(rows: DataFrame) -> DataFrame:
    """path, row_number, ms, channel, raw_text, value, quality of every channel of the accepted rows; a missing cell is empty and invalid."""
    pair = lambda code, i: F.struct(code.alias("channel"), F.coalesce(F.get(F.col("fields"), i), F.lit("")).alias("raw_text"))
    out = rows.where("problem IS NULL").select("path", "row_number", "ms", F.inline(F.transform("codes", pair))).where("channel IS NOT NULL")
    value = parse.number(F.col("raw_text"))
    return out.withColumn("value", value).withColumn("quality", F.when(F.col("value").isNull(), "invalid").otherwise("good"))


def row_events(rows: DataFrame) -> DataFrame:
    """Quarantined rows and width warnings, a row can have both, with metadata in the keys that the event views read: file, row
    number, time text and raw text, and as details the fields."""
    both = F.filter(F.array(F.struct(F.col("warning").alias("event_type"), F.lit("warning").alias("severity")), F.struct(F.col("problem").alias("event_type"), F.lit("error").alias("severity"))), lambda x: x["event_type"].isNotNull())
    name, text = F.element_at(F.split("path", "/"), -1), F.get("fields", F.col("stamp") - 1)
    told = F.struct(name.alias("source_file_name"), F.col("row_number").alias("source_row_number"), text.alias("source_timestamp_text"), F.col("raw_line").alias("raw_text"), F.struct("fields").alias("details"))
    detail = F.to_json(told, {"ignoreNullFields": "false"})
    return rows.select("path", "row_number", detail.alias("metadata_json"), F.inline(both))


def steps(rows: DataFrame) -> DataFrame:
    """Recipe steps of accepted rows: STEP_<token> where the step column is filled and not zero; the code only if not zero, and the
    payload with both."""
    at = lambda name: F.get("fields", F.array_position("codes", name).cast("int") - 1)
    code, step = at(STEP_COLUMNS[0]), at(STEP_COLUMNS[1])
    real = lambda c: F.when((c != "") & ~parse.zero_like(c), c)
    told = F.struct(F.lit("csv").alias("source"), real(code).alias("recipe_no"), step.alias("recipe_step"))
    payload = F.to_json(told, {"ignoreNullFields": "false"}).alias("source_payload_json")
    out = rows.where("problem IS NULL").select("path", "row_number", "ms", real(code).alias("recipe_code"), F.concat(F.lit("STEP_"), parse.state_token(real(step))).alias("state_code"), F.concat(F.lit("Reçete adım "), step).alias("state_name"), payload)
    return out.where("state_code IS NOT NULL")


def report(rows: DataFrame) -> DataFrame:
    """Of each file: records, accepted rows, bounds, channels, warnings (width, gaps, order) and errors (rows and cells)."""
    accepted = F.col("problem").isNull()
    invalid = F.size(F.filter(F.transform("codes", lambda c, i: F.when(c.isNotNull() & parse.number(F.coalesce(F.get(F.col("fields"), i), F.lit(""))).isNull(), 1)), lambda x: x.isNotNull()))
    found = rows.groupBy("path").agg(
        F.count("*").alias("records"), F.count_if(accepted).alias("rows"), F.min(F.when(accepted, F.col("ms"))).alias("started_ms"), F.max(F.when(accepted, F.col("ms"))).alias("finished_ms"),
        F.first(F.size("codes") - 1).cast("long").alias("channels"), F.count("warning").alias("row_warnings"), (F.count("problem") + F.coalesce(F.sum(F.when(accepted, invalid)), F.lit(0))).alias("errors"),
    )
    frames = rows.where("problem IS NULL").select(F.col("path").alias("run_id"), F.col("row_number").alias("seq"), "ms")
    gaps = ingest.gap_events(frames, "seq").groupBy(F.col("run_id").alias("path")).agg(F.count("*").alias("gaps"))
    warnings = (F.col("row_warnings") + F.coalesce("gaps", F.lit(0))).alias("warnings")
    return found.join(gaps, "path", "left").select("path", "records", "rows", "started_ms", "finished_ms", "channels", warnings, "errors")


def sequenced(rows: DataFrame, by: str = "folder") -> DataFrame:
    """``seq`` through all files of a folder in rank order; a rejected row leaves a hole."""
    counts = rows.groupBy(by, "path", "rank").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.withColumn("before", before).select(by, "path", "before")
    return rows.join(first, [by, "path"]).withColumn("seq", F.col("before") + F.col("row_number") - 1).drop("before")
