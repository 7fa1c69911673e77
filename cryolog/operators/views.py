"""Views over stored long tables: frames (run_id, seq, ms), cells (run_id, seq, ms, channel, raw_text, value, quality), events,
recipe segments and stored analyses.  A view over one run of the original is a view over all runs here: its limit is a
rank within a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import CHANNELS, GROUPS, SHELF_AVERAGE, SHELVES, Profile
from . import quality
from .analysis import shelf_off
from .select import exact_medians
from .series import gap_breaks

KEY = ["run_id", "seq"]


def between(rows: DataFrame, start: int | None = None, end: int | None = None, column: str = "ms") -> DataFrame:
    """Rows from ``start`` to ``end``, both included and both optional; only given bounds become filters of the scan."""
    if start is not None:
        rows = rows.where(F.col(column) >= start)
    return rows if end is None else rows.where(F.col(column) <= end)


def first_of_each(rows: DataFrame, order: list, limit: int, by: str = "run_id") -> DataFrame:
    """The first ``limit`` rows of each run."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def paged_cells(frames: DataFrame, cells: DataFrame, order: list, limit: int) -> DataFrame:
    """All cells of the first ``limit`` frames of each run: frames are limited before any cell is fetched."""
    return cells.join(first_of_each(frames.select(*KEY, "ms"), order, limit), KEY, "left_semi")


def chronological(rows: DataFrame) -> DataFrame:
    """``place`` of each row of a run in time, by sequence and arrival (``position``) where times are equal; rows without a time go."""
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("ms", "seq", "position"))
    return rows.where("ms IS NOT NULL").withColumn("place", n.cast("long"))


def placed_events(events: DataFrame, frames: DataFrame, channels: DataFrame) -> DataFrame:
    """``events`` (run_id, event_id, seq, channel_id, event_type, metadata_json) with time, source text, row number and channel
    code: of the frame, else as the metadata say.  Events without a frame or a channel stay."""
    f = frames.select(*KEY, "ms", F.col("source_timestamp_text").alias("_text"))
    joined = events.join(f, KEY, "left").join(channels.select("channel_id", F.col("code").alias("channel")), "channel_id", "left")
    row = quality.source_row(F.when(F.col("ms").isNotNull(), F.col("seq")))
    text = F.coalesce("_text", quality.source_text())
    return joined.select("run_id", "event_id", "ms", text.alias("source_timestamp_text"), row.alias("source_row"), "channel", "event_type", "metadata_json")


def new_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """``events`` (run_id, event_type, metadata_json, …) whose run, type and metadata are not ``stored``; one of equal ones."""
    key = ["run_id", "event_type", "metadata_json"]
    a, b = events.dropDuplicates(key).alias("a"), stored.select(*key).alias("b")
    return a.join(b, F.expr("a.run_id = b.run_id AND a.event_type = b.event_type AND a.metadata_json <=> b.metadata_json"), "left_anti")


def recipe_view(segments: DataFrame, assignments: DataFrame, states: DataFrame, start: int | None = None, end: int | None = None, limit: int = 1000) -> DataFrame:
    """Recipe segments (assignment_id, segment, state_id, started_ms, finished_ms) with their run and state code, those that
    overlap ``start`` to ``end``, the first ``limit`` of each run.  A segment without a known state stays."""
    joined = segments.join(assignments.select("assignment_id", "run_id"), "assignment_id").join(states.select("state_id", F.col("code").alias("state_code")), "state_id", "left")
    if start is not None:
        joined = joined.where(F.coalesce("finished_ms", "started_ms") >= start)
    return first_of_each(between(joined, end=end, column="started_ms"), ["started_ms", "segment"], limit)


def overlapping(segments: DataFrame, start: int, end: int) -> DataFrame:
    """Segments that share a moment with ``start`` to ``end``; one without an end counts by its start."""
    return segments.where((F.coalesce("finished_ms", "started_ms") >= start) & (F.col("started_ms") <= end))


def last_covering(points: DataFrame, segments: DataFrame) -> DataFrame:
    """``points`` (run_id, point_id, ms) with the ``segment`` (segment, started_ms, finished_ms) that covers them, both ends
    included and an open end without end; of several the last one, null if there is none.

    Points and starts of a run lie in one time line: the last start up to a point is looked at.  So segments of a run must
    not lie inside each other, as states of a machine do not.
    """
    line = points.select("run_id", "ms", "point_id", F.lit(None).cast("struct<segment:bigint,finished_ms:bigint>").alias("begun")).unionByName(
        segments.select("run_id", F.col("started_ms").alias("ms"), F.lit(None).cast("bigint").alias("point_id"), F.struct(F.col("segment").cast("bigint").alias("segment"), F.col("finished_ms").cast("bigint").alias("finished_ms")).alias("begun"))
    )
    # of starts at one time the later segment comes last, and starts come before points
    order = Window.partitionBy("run_id").orderBy("ms", F.col("point_id").isNotNull(), F.col("begun.segment")).rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("last", F.last("begun", ignorenulls=True).over(order)).where("point_id IS NOT NULL")
    covered = F.col("last.finished_ms").isNull() | (F.col("ms") <= F.col("last.finished_ms"))
    return found.select("run_id", "point_id", "ms", F.when(covered, F.col("last.segment")).alias("segment"))


def flagged(cells: DataFrame, events: DataFrame) -> DataFrame:
    """``cells`` with ``suspect``: by their own quality, or as a suspect_value event (run_id, seq, channel, event_type) says."""
    named = events.where("event_type = 'suspect_value' AND seq IS NOT NULL AND channel IS NOT NULL").select(*KEY, "channel").distinct().withColumn("_event", F.lit(True))
    joined = cells.join(named, [*KEY, "channel"], "left")
    return joined.withColumn("suspect", F.coalesce("_event", F.lit(False)) | F.coalesce(F.col("quality") == "suspect", F.lit(False))).drop("_event")


def _off(p: Profile) -> Column:
    return F.coalesce(F.col("channel").isin(SHELVES) & shelf_off(F.col("value"), p), F.lit(False))


def line_points(frames: DataFrame, flagged_cells: DataFrame, channels: list[str], p: Profile) -> DataFrame:
    """A point for each frame and channel: empty where the cell is missing, no number, a shelf that is off, or suspect."""
    wanted = frames.select(*KEY, "ms", F.explode(F.array(*map(F.lit, channels))).alias("channel"))
    cells = flagged_cells.select(*KEY, "channel", F.when(~_off(p) & ~F.col("suspect"), F.col("value")).alias("value"))
    return wanted.join(cells, [*KEY, "channel"], "left").select(*KEY, "ms", "channel", "value")


def good_medians(cells: DataFrame, p: Profile) -> DataFrame:
    """Median of each channel's good values, shelves that are off left out."""
    return exact_medians(cells.where(F.col("quality") == "good").where(~_off(p)), ["run_id", "channel"])


def suspect_markers(flagged_cells: DataFrame, p: Profile) -> DataFrame:
    """Suspect cells with a number, at the height of their channel's median (their own value if it has none), raw text kept."""
    rows = flagged_cells.where("suspect AND value IS NOT NULL").where(~_off(p))
    joined = rows.join(good_medians(flagged_cells, p), ["run_id", "channel"], "left")
    return joined.select(*KEY, "ms", "channel", F.coalesce("median", "value").alias("height"), "raw_text")


def shelf_average_points(frames: DataFrame, flagged_cells: DataFrame, p: Profile) -> DataFrame:
    """The mean of each frame's shelves that are on, good and not suspect, empty if there is none, with breaks in long gaps."""
    good = (F.col("quality") == "good") & ~F.col("suspect") & ~_off(p) & F.col("channel").isin(SHELVES)
    means = flagged_cells.where(good).groupBy(*KEY).agg(F.avg("value").alias("value"))
    points = frames.select(*KEY, "ms").join(means, KEY, "left").select("run_id", "ms", "value")
    return points.unionByName(gap_breaks(frames))


def catalogue(codes: DataFrame) -> DataFrame:
    """``codes`` (code) with unit, axis, group and ``rank``, their place in the order of channels; unknown ones are last, by code."""
    known = F.create_map(*(x for i, (code, (unit, group, axis)) in enumerate(CHANNELS.items()) for x in (F.lit(code), F.struct(F.lit(unit).cast("string").alias("unit"), F.lit(group).alias("group"), F.lit(axis).alias("axis"), F.lit(i).alias("rank")))))
    at = F.element_at(known, F.col("code"))
    return codes.select("*", at["unit"].alias("unit"), F.coalesce(at["group"], F.lit("other")).alias("group"), F.coalesce(at["axis"], F.lit("main")).alias("axis"), F.coalesce(at["rank"], F.lit(len(CHANNELS))).alias("rank"))


def channels_seen(cells: DataFrame) -> DataFrame:
    """run_id and code of every channel of a run, and of the derived shelf average where two shelves or more are among them."""
    seen = cells.select("run_id", F.col("channel").alias("code")).distinct()
    more = seen.groupBy("run_id").agg(F.count_if(F.col("code").isin(SHELVES)).alias("shelves"), F.count_if(F.col("code") == SHELF_AVERAGE).alias("have"))
    return seen.unionByName(more.where("shelves >= 2 AND have = 0").select("run_id", F.lit(SHELF_AVERAGE).alias("code")))


def panels(codes: DataFrame) -> DataFrame:
    """A row for each panel of a run that has channels, in the order of panels: its channels in order, and those without a unit."""
    known = catalogue(codes)
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group"))
    member = F.struct("rank", "code", F.col("unit").isNull().alias("bare"))
    found = known.groupBy("run_id", "group").agg(F.array_sort(F.collect_set(member)).alias("m"), F.first(place).cast("int").alias("place"))
    names = lambda column: F.array_join(F.transform(column, lambda x: x.code), ",")
    return found.select("run_id", "group", "place", names(F.col("m")).alias("channels"), names(F.filter("m", lambda x: x.bare)).alias("without_unit"))


def active_profile(profiles: DataFrame, code: str) -> DataFrame:
    """The one active profile (code, version, active, config_json) of this code, the latest version of several."""
    return profiles.where((F.col("code") == code) & F.col("active")).orderBy(F.desc("version")).limit(1)


def stored_analysis(cycles: DataFrame, segments: DataFrame, events: DataFrame) -> DataFrame:
    """What is stored of each run's analysis, as rows of one table: cycles by loop, segments by start, events by time."""
    row = lambda df, part, at, second, name: df.select("run_id", F.lit(part).alias("part"), F.row_number().over(Window.partitionBy("run_id").orderBy(at, second)).cast("long").alias("place"), F.col(name).alias("name"), F.col("loop").cast("bigint").alias("loop"), F.col(at).cast("bigint").alias("at"))
    return row(cycles, "cycle", "loop", "started_ms", "status").unionByName(row(segments, "segment", "started_ms", "segment", "state")).unionByName(row(events, "event", "ms", "event_id", "event_type"))


def diagnostics(resets: DataFrame, parallel: DataFrame) -> DataFrame:
    """Reset and parallel diagnostics in one table."""
    columns = ["run_id", "seq", "ms", "event_type", F.col("loop").cast("bigint").alias("loop")]
    return resets.select(*columns).unionByName(parallel.where("event_type IS NOT NULL").select(*columns))


def last_cycles(cycles: DataFrame, n: int = 5) -> DataFrame:
    """The last cycles of each run, newest first."""
    return first_of_each(cycles, [F.desc("loop")], n)
