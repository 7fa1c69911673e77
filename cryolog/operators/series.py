"""Chart series and views over wide frames (run_id, seq, ms, channels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import SHELVES, Profile
from .analysis import ORDER, shelf_off
from .select import exact_medians


def long_cells(frames: DataFrame, channels: list[str]) -> DataFrame:
    """run_id, seq, ms, channel, value of every cell that is there."""
    cells = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"`{c}`").alias("value")) for c in channels))
    return frames.select("run_id", "seq", "ms", F.inline(cells)).where("value IS NOT NULL")


def rolling_view(frames: DataFrame, hours: int) -> DataFrame:
    """Frames of the last ``hours`` before each run's latest one; the lower edge is out."""
    latest = F.max("ms").over(Window.partitionBy("run_id"))
    return frames.withColumn("latest", latest).where(F.col("ms") > F.col("latest") - hours * 3_600_000).drop("latest")


def gap_breaks(frames: DataFrame, seconds: float = 360) -> DataFrame:
    """Two empty points inside each longer gap, so that no line crosses it."""
    before = F.lag("ms").over(Window.partitionBy("run_id").orderBy(*ORDER))
    wide = frames.select("run_id", "ms", before.alias("before")).where(F.col("ms") - F.col("before") > seconds * 1000)
    return wide.select("run_id", F.explode(F.array(F.col("before") + 1, F.col("ms") - 1)).alias("ms"), F.lit(None).cast("double").alias("value"))


def line_series(frames: DataFrame, channels: list[str], p: Profile) -> DataFrame:
    """A point for each frame and channel; a shelf that is off is empty."""
    cells = F.array(*(F.struct(F.lit(c).alias("channel"), (F.when(~shelf_off(F.col(c), p), F.col(c)) if c in SHELVES else F.col(f"`{c}`")).alias("value")) for c in channels))
    return frames.select("run_id", "seq", "ms", F.inline(cells))


def medians(cells: DataFrame, p: Profile) -> DataFrame:
    """Median of the values of each channel, shelves that are off left out."""
    off = F.col("channel").isin(SHELVES) & shelf_off(F.col("value"), p)
    return exact_medians(cells.where(~off), ["run_id", "channel"])


def shelf_average(frames: DataFrame, p: Profile) -> DataFrame:
    """Mean of the shelves that are on, empty if none is."""
    on = [F.when(~shelf_off(F.col(c), p), F.col(c)) for c in SHELVES if c in frames.columns]
    total, n = sum((F.coalesce(x, F.lit(0.0)) for x in on), F.lit(0.0)), sum((x.isNotNull().cast("int") for x in on), F.lit(0))
    return frames.select("run_id", "seq", "ms", F.when(n > 0, total / n).alias("shelf_average"))


def bands(segments: DataFrame, extents: DataFrame) -> DataFrame:
    """Segments clipped to each run's visible extent (from_ms, to_ms); an open end reaches its last frame, empty ones go."""
    joined = segments.join(extents, "run_id")
    start, end = F.greatest("started_ms", "from_ms"), F.least(F.coalesce("finished_ms", "to_ms"), F.col("to_ms"))
    return joined.select("run_id", "state", start.alias("from_ms"), end.alias("to_ms")).where("to_ms > from_ms")


def merge_incremental(current: DataFrame, incoming: DataFrame, limit: int) -> DataFrame:
    """One row for each run and sequence, incoming ones first, and of each run the last ``limit`` by sequence."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    one = both.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", "seq").orderBy(F.desc("_new")))).where("_n = 1")
    last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))
    return one.withColumn("_n", last).where(F.col("_n") <= limit).drop("_n", "_new")


def quality_buckets(events: DataFrame) -> DataFrame:
    """Of each run, the events in all, gaps, suspect values and others."""
    kind = F.col("event_type")
    named = ["time_gap", "suspect_value"]
    return events.groupBy("run_id").agg(F.count("*").alias("total"), *(F.count_if(kind == n).alias(n) for n in named), F.count_if(~kind.isin(named)).alias("other"))
