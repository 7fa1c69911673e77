"""Telemetry from the events table, and the queries over it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.profile import Profile
from ..operators import analysis as an
from ..operators import reanalysis as again
from ..operators import ingest, series, views
from ..streaming.ranges import kept

P = Profile(state_reset_gap_minutes=40.0)
CHANNELS = ["RAF1", "RAF2", "VACUM", "S2", "S4", "E.GUC", "TARTIM"]
FRAMES_EACH = 50_000  # a part's sorts and windows take memory by its frames
_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def wide(e: DataFrame, run: Column, seq: Column, slower: int) -> DataFrame:
    """A frame for each event; a millisecond stands for ``slower`` microseconds of the table."""
    k, value, kind = F.get_json_object("props", "$.k").cast("int"), F.col("value"), F.col("event_type")
    ms = F.expr(f"1704067200000L + (timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) - 1704067200000000L) DIV {slower}L")
    return e.select(
        run.alias("run_id"), seq.cast("long").alias("seq"), ms.alias("ms"), k.alias("k"), kind.alias("kind"),
        F.when(kind == "error", 850.0).otherwise(value - 50).alias("RAF1"), F.when(kind.isin("error", "signup"), 850.0).otherwise(value - 50).alias("RAF2"),
        F.when(k % 17 != 0, value / 10).alias("VACUM"), ((k - 60) / 2.0).cast("double").alias("S2"), (k * 7 % 50 - 30).cast("double").alias("S4"),
        F.when(kind != "view", value).alias("E.GUC"), F.when(kind.isin("click", "purchase"), k.cast("double")).alias("TARTIM"),
        F.when(run % 3 == 0, "completed").otherwise("running").alias("run_status"),
    )


def parts_of(spark: SparkSession, sf_dir: str) -> int:
    """How many parts the runs of the events are dealt to: about FRAMES_EACH frames in one, however many there are."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(spark.read.parquet(f"{sf_dir}/events.parquet").count() / FRAMES_EACH))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user and a frame for each event; time runs sixty times slower than in the table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(parts_of(spark, sf_dir), "user_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return wide(e, F.col("user_id"), seq, 60000)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _FOUND[f.__name__] = f
    return f


def _basics(spark: SparkSession, d: str) -> DataFrame:
    return an.with_basics(frames(spark, d), P)


def _looped(spark: SparkSession, d: str) -> DataFrame:
    return an.with_loops(an.with_states(_basics(spark, d), P))


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query
def d10_active_shelves(spark, d):
    return _basics(spark, d).select("run_id", "seq", F.col("active").cast("int").alias("active"), *_r("coil"))


@query
def e3_gap_minutes(spark, d):
    return _basics(spark, d).select("run_id", "seq", *_r("gap_min"))


@query
def e4_interval_energy(spark, d):
    return an.with_derived(_basics(spark, d), P).where("interval_kwh IS NOT NULL").select("run_id", "seq", "interval_kwh")


@query
def e5_cumulative_energy(spark, d):
    return an.with_derived(_basics(spark, d), P).where("cumulative_kwh IS NOT NULL").select("run_id", "seq", F.round("cumulative_kwh", 4).alias("cumulative_kwh"))


@query
def e6_weight_change(spark, d):
    return an.with_derived(_basics(spark, d), P).where("weight_delta IS NOT NULL").select("run_id", "seq", "weight_delta", (-F.col("weight_delta")).alias("weight_loss"))


@query
def e7_chains(spark, d):
    return _basics(spark, d).select("run_id", "seq", F.col("chain").cast("long").alias("chain"))


@query
def e8_state_inference(spark, d):
    return an.with_states(_basics(spark, d), P).select("run_id", "seq", "state")


@query
def e9_state_segments(spark, d):
    return an.segments(_looped(spark, d)).select("run_id", "segment", "state", "loop", "started_ms", "finished_ms", "start_seq", "end_seq", "frames", F.col("confidence").cast("double").alias("confidence"))


@query
def e10_loop_numbers(spark, d):
    return _looped(spark, d).select("run_id", "seq", "loop")


@query
def e11_cycle_milestones(spark, d):
    return an.cycles(_looped(spark, d)).select("run_id", "loop", "started_ms", "dry_ms", "stop_ms", "wait_ms", "defrost_ms", "defrost_stop_ms")


@query
def e12_cycle_outcome(spark, d):
    return an.cycles(_looped(spark, d)).select("run_id", "loop", "finished_ms", "status", F.col("confidence").cast("double").alias("confidence"))


@query
def e13_chain_resets(spark, d):
    return an.resets(_looped(spark, d), P).select("run_id", "seq", "ms", "event_type", "loop", *_r("gap_min"), "limit_min", "previous_seq")


@query
def c12_nearest_prior(spark, d):
    return an.parallel_events(_looped(spark, d), P).select("run_id", "seq", "prior_seq")


@query
def c13_segment_at(spark, d):
    return an.parallel_events(_looped(spark, d), P).select("run_id", "seq", "loop")


@query
def e14_parallel_diagnostics(spark, d):
    return an.parallel_events(_looped(spark, d), P).where("event_type IS NOT NULL").select("run_id", "seq", "ms", "prior_seq", "loop", "change", "recovery", "vacuum_change", "event_type")


@query
def e15_derived_measurements(spark, d):
    return an.derived_measurements(an.with_derived(_basics(spark, d), P)).select("run_id", "seq", "code", F.when(F.col("code") == "CUMULATIVE_ENERGY_KWH", F.round("value", 4)).otherwise(F.col("value")).alias("value"), "unit")


@query
def d5_diagnostic_counts(spark, d):
    return an.parallel_events(_looped(spark, d), P).where("event_type IS NOT NULL").groupBy("run_id", "event_type").agg(F.count("*").alias("n"))


@query
def e23_current_state(spark, d):
    s = an.segments(_looped(spark, d))
    return s.groupBy("run_id").agg(F.max_by("state", "segment").alias("state"), F.max("segment").alias("segments"))


@query
def e1_gap_events(spark, d):
    return ingest.gap_events(_swapped(spark, d), "seq").select("run_id", "seq", *_r("gap_seconds"), "event_type")


def _swapped(spark: SparkSession, d: str) -> DataFrame:
    """Some rows half an hour early, so that order breaks."""
    return frames(spark, d).withColumn("ms", F.when(F.col("k") % 23 == 0, F.col("ms") - 1_800_000).otherwise(F.col("ms")))


@query
def e2_append_gap_events(spark, d):
    rows = _swapped(spark, d).withColumn("batch_id", F.floor((F.col("seq") - 1) / 10))
    return ingest.append_gap_events(rows).select("run_id", "seq", "event_type")


@query
def d1_run_bounds(spark, d):
    return ingest.bounds(frames(spark, d)).select("run_id", "started_ms", "finished_ms")


@query
def d2_channel_count(spark, d):
    return series.long_cells(frames(spark, d), CHANNELS).groupBy("run_id").agg(F.count_distinct("channel").alias("channels"))


@query
def d4_quality_buckets(spark, d):
    e = ingest.gap_events(_swapped(spark, d), "seq")
    return e.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "time_gap").alias("time_gap"), F.count_if(F.col("event_type") != "time_gap").alias("other"))


@query
def d8_channel_medians(spark, d):
    return series.medians(series.long_cells(frames(spark, d), CHANNELS), P).select("run_id", "channel", *_r("median"))


@query
def d9_shelf_average(spark, d):
    return series.shelf_average(frames(spark, d), P).select("run_id", "seq", *_r("shelf_average"))


@query
def d11_timeline_extent(spark, d):
    return ingest.bounds(frames(spark, d)).select("run_id", "started_ms", "finished_ms", (F.col("finished_ms") - F.col("started_ms")).alias("span_ms"))


@query
def d12_next_sequence(spark, d):
    return ingest.bounds(frames(spark, d)).select("run_id", "last_seq", (F.col("last_seq") + 1).alias("next_seq"))


@query
def d14_channel_order(spark, d):
    cells = series.long_cells(frames(spark, d), CHANNELS)
    rank = F.array_position(F.array(*(F.lit(c) for c in CHANNELS)), F.col("channel"))
    return cells.groupBy("run_id", "channel").agg(F.min(F.struct("seq", rank.alias("rank"))).alias("at")).select("run_id", "channel", "at.seq", F.col("at.rank").cast("long").alias("rank"))


@query
def e16_rolling_day(spark, d):
    return series.rolling_view(frames(spark, d), 24).select("run_id", "seq", "ms")


@query
def e17_gap_breaks(spark, d):
    return series.gap_breaks(frames(spark, d))


@query
def e18_line_series(spark, d):
    return series.line_series(frames(spark, d), ["RAF1", "RAF2", "VACUM"], P).select("run_id", "seq", "ms", "channel", *_r("value"))


@query
def e21_state_bands(spark, d):
    extent = ingest.bounds(series.rolling_view(frames(spark, d), 24)).select("run_id", F.col("started_ms").alias("from_ms"), F.col("finished_ms").alias("to_ms"))
    return series.bands(an.segments(_looped(spark, d)), extent)


@query
def f1_first_frames(spark, d):
    return frames(spark, d).select("run_id", "seq", "ms").orderBy("ms", "run_id", "seq").limit(500)


@query
def f2_latest_frames(spark, d):
    n = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ms"), F.desc("seq")))
    return frames(spark, d).withColumn("n", n).where("n <= 20").select("run_id", "seq", "ms")


@query
def f3_after_sequence(spark, d):
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    return frames(spark, d).where("seq > 10").withColumn("n", n).where("n <= 15").select("run_id", "seq", "ms")


@query
def g1_incremental_merge(spark, d):
    f = frames(spark, d).select("run_id", "seq", "ms", F.lit("current").alias("origin"))
    return series.merge_incremental(f.where("seq % 3 <> 0"), f.where("seq % 2 = 0").withColumn("origin", F.lit("incoming")), 25)


@query
def c1_frame_cells(spark, d):
    return series.long_cells(frames(spark, d), CHANNELS).withColumn("group", parse.channel_group(F.col("channel"))).select("run_id", "seq", "channel", "group", *_r("value"))


@query
def c8_idempotent_append(spark, d):
    f = frames(spark, d)
    batch = f.where("seq % 2 = 0").unionByName(f.where("seq % 4 = 0")).withColumn("batch_pos", F.col("seq") * 1000 + F.col("k"))
    return ingest.new_samples(batch, f.where("seq % 3 = 0")).select("run_id", "seq", "ms")


@query
def c14_interval_overlap(spark, d):
    lo, hi = 1704067200000 + 3_600_000 * 2, 1704067200000 + 3_600_000 * 8
    return views.overlapping(an.segments(_looped(spark, d)), lo, hi).select("run_id", "segment", "state")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Cell texts of every kind the parser meets."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    texts = ["", "10,5", "1.234,5", "1,234.5", "#VALUE!", "", "1f", "NaN"]
    text = F.when(k % 8 == 0, F.concat(k.cast("string"), F.lit(".25"))).otherwise(F.get(F.array(*map(F.lit, texts)), k % 8))
    return e.select("event_id", text.alias("raw_text"), k.alias("k"))


@query
def b5_number_parse(spark, d):
    return _raw(spark, d).select("event_id", parse.number(F.col("raw_text")).alias("value"))


@query
def b11_cell_quality(spark, d):
    value = parse.number(F.col("raw_text"))
    return _raw(spark, d).select("event_id", value.alias("numeric_value"), F.when(value.isNull(), F.col("raw_text")).alias("value_text"), F.when(value.isNull(), "text").otherwise("number").alias("value_type"), F.when(value.isNull(), "invalid").otherwise("good").alias("quality"), F.when(value.isNull(), "numeric_parse_error").alias("quality_reason"))


@query
def b2_canonical_channel(spark, d):
    names = ["raf1 hedef", " S 1 ", "serp2", "Kond", "vacuum", "E.GUC", "RAF 3"]
    code = parse.canonical_channel(F.get(F.array(*map(F.lit, names)), F.col("k") % 7))
    return _raw(spark, d).select("event_id", code.alias("code"), parse.channel_group(code).alias("group"))


@query
def b6_timestamp_parse(spark, d):
    n = F.col("k").cast("string")
    text = F.when(F.col("k") % 4 == 0, F.concat(F.lit("2024-01-05-10:"), F.col("k") % 60, F.lit(":07.12345"))).when(F.col("k") % 4 == 1, F.concat(F.lit("5.1.2024 9:"), F.col("k") % 60)).when(F.col("k") % 4 == 2, F.concat(F.lit("2024/2/30 10:"), n)).otherwise(F.concat(F.lit("2024-01-05T10:00:"), F.col("k") % 60))
    return _raw(spark, d).select("event_id", parse.epoch_ms(parse.log_timestamp(text)).alias("ms"))


@query
def b18_state_token(spark, d):
    return _raw(spark, d).select("event_id", parse.state_token(F.concat(F.lit(" step-"), F.col("k"), F.lit(".a "))).alias("token"), parse.zero_like(F.concat((F.col("k") % 3).cast("string"), F.lit(",0"))).alias("zero"))


@query
def e22_recipe_segments(spark, d):
    f = frames(spark, d)
    mapped = f.select("run_id", "seq", "ms", F.when(F.col("kind") == "click", 1).when(F.col("kind") == "view", 2).when(F.col("kind") == "purchase", 3).cast("long").alias("state_id"))
    return ingest.recipe_segments(mapped)


@query
def i10_resumed_analysis(spark, d):
    """An analysis of most frames, taken up again from the chains that the other ones touch.  What has several readers is stored
    once, and each deals the runs to as many parts as ``frames``."""
    parts = parts_of(spark, d)
    dealt = lambda df: kept(df).repartition(parts, "run_id")
    f = dealt(frames(spark, d))
    late = (F.col("seq") % 37 == 5) & (F.col("run_id") % 4 != 0)
    stored = dealt(again.analysed(f.where(~late), P))
    at = kept(again.resumption(kept(again.chain_ends(stored, f.columns)).repartition(parts, "run_id"), f.where(late)))
    whole = again.merged(stored, again.resume(f, at, P, parts), at)
    return whole.select("run_id", "seq", "chain", "segment", "state", "loop", "weight_delta", F.round("cumulative_kwh", 4).alias("cumulative_kwh"))


@query
def j2_status_fold(spark, d):
    f = frames(spark, d)
    last = ingest.bounds(f).select("run_id", F.col("finished_ms").alias("last_ms"))
    log = f.where("kind IN ('error', 'signup', 'purchase')").join(last, "run_id").select(
        "run_id", F.col("seq").alias("changed_ms"), F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "signup", "running").otherwise("completed").alias("status"),
        F.when(F.col("k") % 2 == 0, F.col("ms")).alias("finished_ms"), F.when(F.col("k") % 5 == 0, F.concat(F.lit("note "), F.col("k"))).alias("notes"), "last_ms",
    )
    return ingest.status_fold(log)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)
