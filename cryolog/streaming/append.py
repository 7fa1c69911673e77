"""Sample batches appended to stored runs, a step at a time.

A step is a micro-batch.  What it stores lies in the partition of its number in each table, and its row in ``steps``, written
last, makes all of it count at once: readers see whole steps only.  A step reads what the steps before it stored and
writes its own partitions anew, so one that broke off between two tables, or runs again, leaves equal tables.

Batches of a run apply in order of batch_id, each as a whole or not at all.  No watermark: late samples are kept and marked.
A run that no step has seen begins as running; ``Store.seed`` brings runs that were imported otherwise.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import batches, sinks
from ..sources.batches import joined

GAP_SECONDS = 360.0
_OBSERVATION = "source_recipe_code string, source_recipe_version string, source_state_code string, source_state_name string, source_payload_json string"
TABLES = {
    "samples": "run_id bigint, seq bigint, ms bigint, source_timestamp_text string, batch_id bigint, batch_pos int, late boolean",
    "cells": "run_id bigint, seq bigint, channel string, raw_text string, value double, value_text string, value_type string, quality string, quality_reason string",
    "observations": f"run_id bigint, seq bigint, ms bigint, {_OBSERVATION}",
    "events": "run_id bigint, batch_id bigint, seq bigint, event_type string, severity string, channel string, message string, metadata_json string",
    "segments": "run_id bigint, assignment_id bigint, segment bigint, state_id bigint, started_ms bigint, finished_ms bigint",
    "runs": "run_id bigint, status string, started_ms bigint, finished_ms bigint, rows bigint, last_seq bigint, channels array<string>",
    "refusals": "run_id bigint, batch_id bigint, batch_pos int, reason string",
    "reports": "run_id bigint, batch_id bigint, inserted bigint, skipped bigint, channels bigint, warnings bigint, errors bigint, latest_ms bigint",
    "steps": "written boolean",
}
_BATCH = ["run_id", "batch_id"]


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for a store, in the cluster's shared folder; for a session on one machine, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="cryolog-")
    return f"{shared}/{label}-{uuid.uuid4().hex}"


class Catalogue(NamedTuple):
    """What a step looks up, read anew each time: runs that take no more (run_id), recipe assignments (run_id, assignment_id,
    version_id, assigned_ms, role, active) and recipe states (version_id, state_id, code, external_code, sort_order)."""

    closed: Callable[[], DataFrame] | None = None
    assignments: Callable[[], DataFrame] | None = None
    states: Callable[[], DataFrame] | None = None


class Known(NamedTuple):
    """What earlier steps stored of the runs that a step touches: sample keys, runs, and the last segment of each assignment."""

    samples: DataFrame
    runs: DataFrame
    segments: DataFrame


class Store:
    """The ``tables`` (name, columns) of ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str] = TABLES):
        self.spark, self.folder, self.tables = spark, folder, tables
        for name in tables:
            self._empty(name).write.mode("append").partitionBy("step").parquet(f"{folder}/{name}")

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.tables[name]}, step bigint")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.tables[name]}, step bigint").parquet(f"{self.folder}/{name}")

    def last(self) -> int | None:
        return self._read("steps").agg(F.max("step")).first()[0]

    def read(self, name: str, below: int | None = None) -> DataFrame:
        """Rows of whole steps; with ``below``, a step that is being written, of those before it."""
        last = self.last() if below is None else below - 1
        return self._read(name).where(F.col("step") <= (last if last is not None else -(2**62)))

    def write(self, name: str, rows: DataFrame, step: int) -> None:
        names = self._empty(name).drop("step").columns
        rows.select(*names).write.mode("overwrite").parquet(f"{self.folder}/{name}/step={step}")

    def close(self, step: int) -> None:
        self.write("steps", self.spark.range(1).select(F.lit(True).alias("written")), step)

    def seed(self, tables: dict[str, DataFrame]) -> None:
        """Rows from elsewhere as the step before the first."""
        for name, rows in tables.items():
            self.write(name, rows, -1)
        self.close(-1)

    def runs(self, below: int | None = None) -> DataFrame:
        """Each run as its last step left it."""
        rows = self.read("runs", below)
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("run_id", "step"))), "step").alias("r")).select("run_id", "r.*")

    def segments(self, below: int | None = None) -> DataFrame:
        """Each segment as the last step that touched it left it."""
        rows = self.read("segments", below)
        key = ["run_id", "assignment_id", "segment"]
        return rows.groupBy(*key).agg(F.max_by(F.struct("state_id", "started_ms", "finished_ms"), "step").alias("s")).select(*key, "s.*")

    def known(self, step: int, touched: DataFrame) -> Known:
        mine = lambda df: joined(df, touched, "run_id", "left_semi")
        ends = mine(self.segments(step)).groupBy("run_id", "assignment_id").agg(F.max(F.struct("segment", "state_id", "started_ms", "finished_ms")).alias("s"))
        return Known(mine(self.read("samples", step)).select("run_id", "seq"), mine(self.runs(step)), ends.select("run_id", "assignment_id", "s.*"))


def numbered(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples without a sequence get the next ones behind what their run (run_id, last_seq) holds when their batch begins.

    A batch ends at the larger of its own largest sequence and its beginning plus its samples without one; over the batches
    of a run that is a sum of those samples and a maximum of what is left, each a window.
    """
    batches_of = Window.partitionBy("run_id").orderBy("batch_id")
    earlier, upto = batches_of.rangeBetween(Window.unboundedPreceding, -1), batches_of.rangeBetween(Window.unboundedPreceding, 0)
    free = lambda over: F.count_if(F.col("seq").isNull()).over(over)
    rows = rows.withColumns({"_upto": free(upto), "_nth": free(Window.partitionBy("run_id").orderBy("batch_id", "batch_pos"))})
    rows = joined(rows.withColumn("_above", F.max(F.col("seq") - F.col("_upto")).over(earlier)), runs.select("run_id", "last_seq"), "run_id", "left")
    start = F.greatest(F.coalesce("last_seq", F.lit(0)), F.col("_above"))
    return rows.withColumn("seq", F.coalesce("seq", start + F.col("_nth"))).drop("_upto", "_nth", "_above", "last_seq")


def inserted(rows: DataFrame, known: Known) -> DataFrame:
    """Of numbered ``rows`` those whose sequence is not stored, the first of each in order of batches, with ``before``, the time
    that a sample is compared with, and ``late``, whether earlier batches hold a later one."""
    first = F.row_number().over(Window.partitionBy("run_id", "seq").orderBy("batch_id", "batch_pos"))
    new = joined(rows.withColumn("_n", first).where("_n = 1").drop("_n"), known.samples, ["run_id", "seq"], "left_anti")
    earlier = Window.partitionBy("run_id").orderBy("batch_id").rangeBetween(Window.unboundedPreceding, -1)
    new = joined(new, known.runs.select("run_id", F.col("finished_ms").alias("_stored")), "run_id", "left").withColumn("_stored", F.greatest("_stored", F.max("ms").over(earlier)))
    before = F.coalesce(F.lag("ms").over(Window.partitionBy(*_BATCH).orderBy("batch_pos")), "_stored")
    return new.withColumn("before", before).withColumn("late", F.coalesce(F.col("ms") < F.col("_stored"), F.lit(False))).drop("_stored")


def _trimmed(name: str) -> Column:
    text = F.trim(F.col(f"state_observation.{name}"))
    return F.when(text != "", text).alias(name)


def _mapped(rows: DataFrame, catalogue: Catalogue) -> DataFrame:
    """``rows`` (run_id, source_state_code, …) with the active assignment of their run and the recipe state they name, own code
    before external code."""
    if catalogue.assignments is None or catalogue.states is None:
        return rows.withColumns({n: F.lit(None).cast("bigint") for n in ("assignment_id", "state_id")})
    assigned = sinks.latest_assignment(catalogue.assignments()).select("run_id", "assignment_id", "version_id")
    names = F.array(F.struct(F.col("code").alias("name"), F.lit(0).alias("rank")), F.struct(F.col("external_code").alias("name"), F.lit(1).alias("rank")))
    best = catalogue.states().select("version_id", "state_id", "sort_order", F.inline(names)).groupBy("version_id", "name").agg(F.min(F.struct("rank", "sort_order", "state_id")).alias("best"))
    best = best.select("version_id", F.col("name").alias("source_state_code"), F.col("best.state_id").alias("state_id"))
    return joined(rows, assigned, "run_id", "left").join(best, ["version_id", "source_state_code"], "left").drop("version_id")


def observed(new: DataFrame, catalogue: Catalogue) -> DataFrame:
    """The state observations of inserted samples, see ``_mapped``."""
    rows = new.where("state_observation IS NOT NULL").select(*_BATCH, "batch_pos", "seq", "ms", _trimmed("source_recipe_code"), _trimmed("source_recipe_version"), _trimmed("source_state_code"), _trimmed("source_state_name"), "state_observation.source_payload_json")
    return _mapped(rows, catalogue)


def _stays(observations: DataFrame, ends: DataFrame) -> DataFrame:
    """Mapped observations behind the last stored segment of their assignment, which counts as a first row; ``segment`` and
    ``started``, where the stay before the row began."""
    shown = observations.where("state_id IS NOT NULL").select("run_id", "assignment_id", "batch_id", "batch_pos", "state_id", "ms", F.lit(None).cast("bigint").alias("segment0"), F.lit(None).cast("bigint").alias("started0"))
    none = F.lit(None)
    stored = joined(ends, shown.select("run_id", "assignment_id").distinct(), ["run_id", "assignment_id"], "left_semi")
    stored = stored.select("run_id", "assignment_id", none.cast("bigint").alias("batch_id"), none.cast("int").alias("batch_pos"), "state_id", F.coalesce("finished_ms", "started_ms").alias("ms"), F.col("segment").alias("segment0"), F.col("started_ms").alias("started0"))
    order = Window.partitionBy("run_id", "assignment_id").orderBy(F.asc_nulls_first("batch_id"), "batch_pos")
    enters = F.coalesce(F.lag("state_id").over(order) != F.col("state_id"), F.lit(True))
    rows = shown.unionByName(stored).withColumn("enters", enters)
    begun = F.when(F.col("enters"), F.coalesce("started0", "ms"))
    started = F.last(begun, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    base = F.coalesce(F.first("segment0").over(order), F.lit(1))  # the first row enters its segment
    return rows.withColumn("started", started).withColumn("segment", base - 1 + F.sum(F.col("enters").cast("bigint")).over(order))


def older_observations(observations: DataFrame, ends: DataFrame) -> DataFrame:
    """The first breach of each run: a mapped observation from before the stay that its assignment is in."""
    bad = _stays(observations, ends).where("batch_id IS NOT NULL AND ms < started")
    first = bad.groupBy("run_id").agg(F.min(F.struct("batch_id", "batch_pos")).alias("at"))
    return first.select("run_id", "at.*", F.lit("state older than its segment").alias("reason"))


def moved_segments(observations: DataFrame, ends: DataFrame) -> DataFrame:
    """The machine segments that these observations begin, go on with or end."""
    rows = _stays(observations, ends)
    key = ["run_id", "assignment_id", "segment"]
    each = rows.groupBy(*key).agg(F.first("state_id").alias("state_id"), F.min(F.coalesce("started0", F.when(F.col("enters"), F.col("ms")))).alias("started_ms"), F.max_by("ms", F.struct("batch_id", "batch_pos")).alias("_last"), F.count("batch_id").alias("_new"), F.count("segment0").alias("_old"))
    following = F.lead("started_ms").over(Window.partitionBy("run_id", "assignment_id").orderBy("segment"))
    each = each.withColumn("finished_ms", F.coalesce(following, F.when(F.col("_new") + F.col("_old") > 1, F.col("_last"))))
    return each.where("_new > 0 OR finished_ms IS NOT NULL").drop("_last", "_new", "_old")


def _moment(ms: str) -> Column:
    return F.expr(f"date_format(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {ms} / 1000), \"yyyy-MM-dd'T'HH:mm:ss.SSS\")")


def _event(kind: Column | str, severity: str, channel: Column, message: Column, **metadata: Column) -> list[Column]:
    said = F.to_json(F.struct(*(v.alias(k) for k, v in metadata.items())))
    return [*_BATCH, "seq", (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), F.lit(severity).alias("severity"), channel.alias("channel"), message.alias("message"), said.alias("metadata_json")]


def step_events(new: DataFrame, cells: DataFrame, observations: DataFrame) -> DataFrame:
    """Gaps and backward times, cells that are suspect or no number, and states that no recipe state stands for."""
    none, gap = F.lit(None).cast("string"), (F.col("ms") - F.col("before")) / 1000.0
    shown = F.format_string("%.3f", F.abs(gap))
    # fixed formats: the views read these messages where metadata is missing
    told = F.when(gap < 0, F.concat(F.lit("timestamp moved backwards by "), shown, F.lit(" seconds before this sample"))).otherwise(F.concat(F.lit("time gap of "), shown, F.lit(" seconds before this sample")))
    gaps = new.where((gap < 0) | (gap > GAP_SECONDS)).select(*_event(F.when(gap < 0, "timestamp_out_of_order").otherwise("time_gap"), "warning", none, told, gap_seconds=gap, previous_timestamp=_moment("before"), current_timestamp=_moment("ms")))
    channel, raw = F.col("channel"), F.col("raw_text")
    suspect = cells.where("quality = 'suspect'").select(*_event("suspect_value", "warning", channel, F.concat(F.lit("`"), channel, F.lit("` reported suspect value "), raw), channel_code=channel, raw_text=raw, rule=F.col("quality_reason")))
    invalid = cells.where("quality = 'invalid'").select(*_event("parse_error", "error", channel, F.concat(F.lit("channel `"), channel, F.lit("` value `"), raw, F.lit("` could not be parsed as number")), channel_code=channel, raw_text=raw))
    lost = observations.where("assignment_id IS NOT NULL AND state_id IS NULL")
    names = {n: F.col(n) for n in ("source_state_code", "source_state_name", "source_recipe_code", "source_recipe_version")}
    told = F.concat(F.lit("machine state `"), F.col("source_state_code"), F.lit("` is not mapped to the active recipe"))
    unmapped = lost.select(*_event("state_unmapped", "warning", none, told, run_recipe_assignment_id=F.col("assignment_id"), **names, source_sequence=F.col("seq"), sampled_at=_moment("ms")))
    return gaps.unionByName(suspect).unionByName(invalid).unionByName(unmapped)


def older_batches(rows: DataFrame, known: Known, catalogue: Catalogue, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Breaches of batches with a state observation from before their assignment's segment; ``rows`` are those without other breaches.

    Whether a batch has one depends on the batches before it; so the first such batch of each run is refused and the rest of
    these runs looked at again, until there is none.  A look reads no run that the one before found nothing in, and of
    samples no more than what decides.  ``kept`` stores a table by a name.
    """
    rows = _mapped(rows.select(*_BATCH, "batch_pos", "seq", "ms", _trimmed("source_state_code")), catalogue).drop("source_state_code")
    rows, found = kept(rows.repartition("run_id"), "open-0"), []
    for round_ in count():
        older = kept(older_observations(inserted(numbered(rows, known.runs), known), known.segments), f"older-{round_}")
        found.append(older)
        if older.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = kept(joined(joined(rows, older.select("run_id"), "run_id", "left_semi"), older.select(*_BATCH), _BATCH, "left_anti"), f"open-{round_ + 1}")


def run_step(store: Store, arrived: DataFrame, step: int, catalogue: Catalogue = Catalogue()) -> None:
    """Applies ``arrived`` (batches as of ``batches.SCHEMA``) as step number ``step``.  See ``older_batches`` for batches that are refused
    for what the batches before them hold."""
    last = store.last()
    if last is not None and step < last:
        raise ValueError(f"step {step} comes after step {last}: this checkpoint is older than the store")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{store.folder}/work/{name}")
        return store.spark.read.schema(df.schema).parquet(f"{store.folder}/work/{name}")

    # what arrived lies in the store too, so that each look at it reads the same rows
    rows = kept(batches.samples(arrived), "arrived")
    known = store.known(step, rows.select("run_id").distinct())
    known = Known(*(kept(df, f"known-{name}") for name, df in known._asdict().items()))
    refused = kept(batches.violations(rows, catalogue.closed() if catalogue.closed else None), "breaches")
    allowed = joined(rows, refused.select(*_BATCH).distinct(), _BATCH, "left_anti")
    refused = refused.unionByName(older_batches(allowed, known, catalogue, kept))
    # one shuffle by run serves all windows
    good = joined(rows, refused.select(*_BATCH).distinct(), _BATCH, "left_anti").repartition("run_id")

    new = kept(inserted(numbered(good, known.runs), known), "new")
    observations, cells = kept(observed(new, catalogue), "observations"), kept(batches.cells(new), "cells")
    events = kept(step_events(new, cells, observations), "events")
    store.write("samples", new, step)
    store.write("cells", cells, step)
    store.write("observations", observations, step)
    store.write("events", events, step)
    store.write("segments", moved_segments(observations, known.segments), step)
    seen = new.groupBy("run_id").agg(F.min("ms").alias("_first"), F.max("ms").alias("_last"), F.count("*").alias("_rows"), F.max("seq").alias("_seq"))
    named = cells.groupBy("run_id").agg(F.collect_set("channel").alias("_channels"))
    runs = joined(joined(seen, named, "run_id", "left"), known.runs, "run_id", "left")
    status = F.when(F.col("status").isNull() | (F.col("status") == "imported"), "running").otherwise(F.col("status"))
    channels = F.array_sort(F.array_union(F.coalesce("channels", F.array().cast("array<string>")), F.coalesce("_channels", F.array().cast("array<string>"))))
    runs = runs.select("run_id", status.alias("status"), F.least("started_ms", "_first").alias("started_ms"), F.greatest("finished_ms", "_last").alias("finished_ms"), (F.coalesce("rows", F.lit(0)) + F.col("_rows")).alias("rows"), F.greatest("last_seq", "_seq").alias("last_seq"), channels.alias("channels"))
    store.write("runs", runs, step)
    store.write("refusals", refused.distinct(), step)
    counts = joined(batches.report(good, new), events.groupBy(*_BATCH).agg(F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "error").alias("errors")), _BATCH, "left")
    whole = joined(counts, known.runs.select("run_id", F.col("channels").alias("_known")), "run_id", "left")
    per_batch = cells.groupBy(*_BATCH).agg(F.collect_set("channel").alias("_own")).withColumn("_own", F.flatten(F.collect_list("_own").over(Window.partitionBy("run_id").orderBy("batch_id"))))
    whole = joined(whole, per_batch, _BATCH, "left")
    held = F.size(F.array_union(F.coalesce("_known", F.array().cast("array<string>")), F.coalesce("_own", F.array().cast("array<string>"))))
    store.write("reports", whole.select(*_BATCH, "inserted", "skipped", held.cast("bigint").alias("channels"), F.coalesce("warnings", F.lit(0)).alias("warnings"), F.coalesce("errors", F.lit(0)).alias("errors"), "latest_ms"), step)
    store.close(step)


def append_stream(store: Store, source: str, checkpoint: str, catalogue: Catalogue = Catalogue(), analyse: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """JSON batches that land in ``source``, each micro-batch a step of ``store``.  ``analyse`` gets all samples of the runs that a step
    has inserted into, once the step counts; it is called again for a step that runs again."""

    def step(arrived: DataFrame, number: int) -> None:
        run_step(store, arrived, number, catalogue)
        if analyse is not None:
            samples = store.read("samples")
            analyse(joined(samples.drop("step"), samples.where(F.col("step") == number).select("run_id").distinct(), "run_id", "left_semi"))

    stream = store.spark.readStream.schema(batches.SCHEMA).json(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
