"""Views over quality events (run_id, event_id, event_type, severity, message, metadata_json, row_number, channel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_JSON = "metadata_json"


def _number(text: Column, kind: str) -> Column:
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text).try_cast(kind)


def source_row(row: Column | str) -> Column:
    """The row number of an event: its own, else that of its metadata."""
    return F.coalesce(row, _number(F.get_json_object(_JSON, "$.source_row_number"), "bigint"))


def source_text() -> Column:
    """The time text of a row as its event's metadata have it."""
    return F.coalesce(F.get_json_object(_JSON, "$.source_timestamp_text"), F.get_json_object(_JSON, "$.details.source_timestamp_text"))


def located(events: DataFrame) -> DataFrame:
    return events.withColumn("source_row", source_row("row_number"))


def gap_seconds() -> Column:
    """From the metadata, else from the message of a gap."""
    said = F.regexp_extract("message", r"time gap of (\d+(?:\.\d+)?) seconds", 1)
    return F.coalesce(_number(F.get_json_object(_JSON, "$.gap_seconds"), "double"), _number(said, "double"))


def suspect_text() -> Column:
    said = F.regexp_extract("message", r"value ([^\s]+)", 1)
    return F.coalesce(F.get_json_object(_JSON, "$.raw_text"), F.when(said != "", said), F.get_json_object(_JSON, "$.raw_value"))


def event_class() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "time_gap", "gap").when(kind == "timestamp_out_of_order", "out_of_order").when(kind == "suspect_value", "suspect").when(kind.isin("parse_error", "numeric_parse_error"), "cell")
        .when(kind == "csv_row_timestamp_error", "timestamp").when(kind.startswith("csv_file_"), "file").when(kind.startswith("csv_row_"), "row").otherwise("other")
    )


def viewed(events: DataFrame) -> DataFrame:
    return located(events).withColumns({"gap_seconds": gap_seconds(), "suspect_text": suspect_text(), "event_class": event_class(), "shown": F.replace("message", F.lit("`"), F.lit(""))})


def first_of_run(events: DataFrame, limit: int) -> DataFrame:
    """The first events of a run by row number (unknown ones first) and id, with the count of those not shown."""
    run = Window.partitionBy("run_id")
    order = F.row_number().over(run.orderBy(F.asc_nulls_first("source_row"), "event_id"))
    hidden = F.greatest(F.count("*").over(run) - limit, F.lit(0))
    return events.withColumns({"place": order, "hidden": hidden}).where(F.col("place") <= limit)


def run_minutes(started: Column, finished: Column) -> Column:
    """Whole minutes, null if reversed or open."""
    return F.when(finished >= started, F.floor((finished - started) / 60000.0 + 0.5)).cast("long")


def cycle_hours(started: Column, finished: Column, now: Column) -> Column:
    """Hours of a cycle; an open one lasts until ``now``."""
    return (F.coalesce(finished, now) - started) / 3_600_000.0


def run_summary(runs: DataFrame, frames: DataFrame, events: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows, warnings and errors of each of ``runs`` (run_id), also of those without frames; counts of its import (run_id, rows,
    warnings, errors) come before live ones."""
    live = frames.groupBy("run_id").agg(F.count("*").alias("live_rows"))
    seen = events.groupBy("run_id").agg(F.count_if(F.col("severity") == "warning").alias("live_warnings"), F.count_if(F.col("severity") == "error").alias("live_errors"))
    out = runs.select("run_id").join(live, "run_id", "left").join(seen, "run_id", "left").join(imports.select("run_id", "rows", "warnings", "errors"), "run_id", "left")
    return out.select("run_id", *(F.coalesce(c, f"live_{c}", F.lit(0)).alias(c) for c in ("rows", "warnings", "errors")))


def newest_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """The first of ``runs`` (run_id, started_ms, created_ms) by falling start, or creation where none has started, and id."""
    return runs.withColumn("newest_ms", F.coalesce("started_ms", "created_ms")).orderBy(F.desc("newest_ms"), F.desc("run_id")).limit(limit)
