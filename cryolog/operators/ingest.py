"""Appending samples: idempotent by (run_id, seq), with gap and order checks, run bounds and recipe segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_id", "seq"]


def new_samples(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` (run_id, seq, batch_pos, …) whose sequence is not stored; the first of a sequence wins."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("batch_pos"))
    return batch.withColumn("_n", first).where("_n = 1").drop("_n").join(stored.select(*KEY), KEY, "left_anti")


def gap_events(rows: DataFrame, order: str, stored_max: DataFrame | None = None, seconds: float = 360) -> DataFrame:
    """time_gap and timestamp_out_of_order of ``rows`` against the row before, the first against ``stored_max`` (run_id, max_ms)."""
    before = F.lag("ms").over(Window.partitionBy("run_id").orderBy(order))
    if stored_max is not None:
        rows = rows.join(stored_max, "run_id", "left")
        before = F.coalesce(before, F.col("max_ms"))
    gap = (F.col("ms") - F.col("before")) / 1000.0
    kind = F.when(gap < 0, "timestamp_out_of_order").when(gap > seconds, "time_gap")
    return rows.withColumn("before", before).select("run_id", "seq", gap.alias("gap_seconds"), kind.alias("event_type")).where("event_type IS NOT NULL")


def append_gap_events(rows: DataFrame, seconds: float = 360) -> DataFrame:
    """The same over a history of appended batches (batch_id): a batch's first row is compared with the largest time that any
    batch before it stored, the others with the row before."""
    run = Window.partitionBy("run_id")
    best = F.max("ms").over(run.orderBy("batch_id").rangeBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.lag("ms").over(Window.partitionBy("run_id", "batch_id").orderBy("seq")), best)
    gap = (F.col("ms") - F.col("before")) / 1000.0
    kind = F.when(gap < 0, "timestamp_out_of_order").when(gap > seconds, "time_gap")
    return rows.withColumn("before", before).select("run_id", "batch_id", "seq", gap.alias("gap_seconds"), kind.alias("event_type")).where("event_type IS NOT NULL")


def appended_runs(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """``runs`` (run_id, status, started_ms, finished_ms) after an append, with all ``frames`` of the touched ones: a start only
    moves to an earlier time, the finish is that of the frames, and an imported run becomes a running one."""
    new = frames.groupBy("run_id").agg(F.min("ms").alias("_first"), F.max("ms").alias("_last"))
    status = F.when(F.col("_last").isNotNull() & (F.col("status") == "imported"), "running").otherwise(F.col("status"))
    joined = runs.join(new, "run_id", "left")
    return joined.select("run_id", status.alias("status"), F.least("started_ms", "_first").alias("started_ms"), F.coalesce("_last", "finished_ms").alias("finished_ms"))


def late_samples(batch: DataFrame, stored_max: DataFrame) -> DataFrame:
    """``batch`` with ``late``: older than what its run (run_id, max_ms) has stored.  Late samples are kept, never dropped."""
    return batch.join(stored_max, "run_id", "left").withColumn("late", F.coalesce(F.col("ms") < F.col("max_ms"), F.lit(False))).drop("max_ms")


def next_sequences(frames: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Of each run, the sequence that the next record gets: behind the last frame and the tail's checkpoint (run_id, next_seq), 1 at least."""
    last = frames.groupBy("run_id").agg(F.max("seq").alias("last_seq"))
    joined = last.join(checkpoints.select("run_id", F.col("next_seq").alias("_checkpoint")), "run_id", "full")
    return joined.select("run_id", F.greatest(F.coalesce("last_seq", F.lit(0)) + 1, F.coalesce("_checkpoint", F.lit(1)), F.lit(1)).alias("next_seq"))


def bounds(frames: DataFrame) -> DataFrame:
    return frames.groupBy("run_id").agg(F.min("ms").alias("started_ms"), F.max("ms").alias("finished_ms"), F.count("*").alias("rows"), F.max("seq").alias("last_seq"))


def status_fold(log: DataFrame) -> DataFrame:
    """Latest status of each run from an append-only log (run_id, changed_ms, status, finished_ms, notes, last_ms)."""
    finish = F.coalesce("finished_ms", F.when(F.col("status").isin("completed", "aborted", "failed"), F.col("last_ms")))
    at = F.struct("status", finish.alias("finished_ms"))
    return log.groupBy("run_id").agg(F.max_by(at, "changed_ms").alias("at"), F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("changed_ms"))).alias("notes")).select("run_id", "at.status", "at.finished_ms", "notes")


def match_states(codes: DataFrame, states: DataFrame) -> DataFrame:
    """``codes`` (code) to recipe ``states`` (state_id, code, external_code, sort_order): own code before external code."""
    by = lambda column, rank: codes.alias("x").join(states.alias("t"), F.col("x.code") == F.col(f"t.{column}")).select("x.code", "t.state_id", "t.sort_order", F.lit(rank).alias("rank"))
    both = by("code", 0).unionByName(by("external_code", 1))
    best = F.row_number().over(Window.partitionBy("code").orderBy("rank", "sort_order", "state_id"))
    return both.withColumn("_n", best).where("_n = 1").select("code", "state_id")


def recipe_segments(mapped: DataFrame) -> DataFrame:
    """Stays in a mapped state, in sequence order; an unmapped observation has no effect.  A single one has no end."""
    run = Window.partitionBy("run_id").orderBy("seq")
    rows = mapped.where("state_id IS NOT NULL")
    rows = rows.withColumn("enters", F.coalesce(F.lag("state_id").over(run) != F.col("state_id"), F.lit(True)).cast("int")).withColumn("segment", F.sum("enters").over(run))
    found = rows.groupBy("run_id", "segment").agg(F.first("state_id").alias("state_id"), F.min_by("ms", "seq").alias("started_ms"), F.max_by("ms", "seq").alias("last_ms"), F.count("*").alias("n"))
    following = F.lead("started_ms").over(Window.partitionBy("run_id").orderBy("segment"))
    return found.select("run_id", "segment", "state_id", "started_ms", F.coalesce(following, F.when(F.col("n") > 1, F.col("last_ms"))).alias("finished_ms"))
