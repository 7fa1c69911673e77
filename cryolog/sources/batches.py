"""Sample batches in JSON: source, cell typing, validation and the report of an append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import ingest

SCHEMA = (
    "run_id bigint, batch_id bigint, samples array<struct<sampled_at: string, source_timestamp_text: string, source_sequence: bigint, "
    "state_observation: struct<source_recipe_code: string, source_recipe_version: string, source_state_code: string, source_state_name: string, source_payload_json: string>, "
    "measurements: array<struct<channel_code: string, raw_text: string, numeric_value: double, value_text: string, value_type: string, quality: string, quality_reason: string>>>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def joined(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by run, of sides that are sorted and never sent whole to the driver: Spark judges what it may broadcast by compressed
    bytes, and numbers of runs and batches take some fifty times that in memory."""
    return rows.join(other.hint("merge"), on, how)


def samples(batches: DataFrame) -> DataFrame:
    """A row for each sample: run_id, batch_id, batch_pos, seq, ms, source_timestamp_text, measurements, state_observation."""
    out = batches.select("run_id", "batch_id", F.posexplode("samples").alias("batch_pos", "s"))
    ms = parse.epoch_ms(parse.batch_timestamp(F.col("s.sampled_at")))
    return out.select("run_id", "batch_id", "batch_pos", F.col("s.source_sequence").alias("seq"), ms.alias("ms"), F.coalesce("s.source_timestamp_text", "s.sampled_at").alias("source_timestamp_text"), "s.measurements", "s.state_observation")


def _typed(m: Column) -> Column:
    value = F.coalesce(m["numeric_value"], parse.number(F.coalesce(m["raw_text"], m["value_text"])))
    return F.struct(
        parse.canonical_channel(m["channel_code"]).alias("channel"), F.coalesce(m["raw_text"], m["numeric_value"].cast("string"), m["value_text"]).alias("raw_text"),
        value.alias("value"), m["value_text"].alias("value_text"), F.coalesce(m["value_type"], F.when(value.isNull(), "text").otherwise("number")).alias("value_type"), m["quality_reason"].alias("quality_reason"),
        F.coalesce(m["quality"], F.when(value.isNull(), "invalid").otherwise("good")).alias("quality"),
    )


def cells(rows: DataFrame) -> DataFrame:
    """A row for each measurement; quality is good with a number and invalid without, unless given."""
    return rows.select("run_id", "batch_id", "batch_pos", "seq", F.inline(F.transform("measurements", _typed)))


def violations(rows: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """run_id, batch_id, batch_pos, reason of each breach; a batch with one is refused as a whole.  ``closed``: run_id of runs that take no more."""
    codes = F.transform("measurements", lambda m: parse.canonical_channel(m["channel_code"]))
    bad = lambda m: F.isnan(F.coalesce(m["numeric_value"], F.lit(0.0))) | (F.abs(F.coalesce(m["numeric_value"], F.lit(0.0))) == float("inf"))
    reasons = {
        "sequence not positive": F.col("seq") <= 0, "time not readable": F.col("ms").isNull(), "no measurement": F.coalesce(F.size("measurements"), F.lit(0)) <= 0,
        "channel without name": F.exists(codes, lambda c: c == ""), "number not finite": F.exists("measurements", bad), "channel twice": F.size(F.array_distinct(codes)) < F.size(codes),
        "state without code": F.col("state_observation").isNotNull() & (F.coalesce(F.trim("state_observation.source_state_code"), F.lit("")) == ""),
        "measurement without value": F.exists("measurements", lambda m: F.coalesce(m["raw_text"], m["numeric_value"].cast("string"), m["value_text"]).isNull()),
        "quality not known": F.exists("measurements", lambda m: ~m["quality"].isin("good", "suspect", "invalid", "missing")),
    }
    found = F.filter(F.array(*(F.when(test, name) for name, test in reasons.items())), lambda x: x.isNotNull())
    out = rows.select("run_id", "batch_id", "batch_pos", F.explode(found).alias("reason"))
    if closed is None:
        return out
    late = joined(rows.select("run_id", "batch_id").distinct(), closed.select("run_id"), "run_id", "left_semi")
    return out.unionByName(late.select("run_id", "batch_id", F.lit(0).alias("batch_pos"), F.lit("run is closed").alias("reason")))


def accepted(rows: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    return joined(rows, violations(rows, closed).select("run_id", "batch_id").distinct(), ["run_id", "batch_id"], "left_anti")


def numbered(rows: DataFrame, stored_max: DataFrame) -> DataFrame:
    """Samples without a sequence get the next ones after the stored maximum (run_id, last_seq), in batch order."""
    n = F.count_if(F.col("seq").isNull()).over(Window.partitionBy("run_id").orderBy("batch_id", "batch_pos"))
    out = joined(rows.withColumn("_n", n), stored_max.select("run_id", "last_seq"), "run_id", "left")
    return out.withColumn("seq", F.coalesce("seq", F.coalesce("last_seq", F.lit(0)) + F.col("_n"))).drop("_n", "last_seq")


def report(rows: DataFrame, inserted: DataFrame) -> DataFrame:
    """Of each batch: samples inserted and skipped, and the time of the last one inserted in batch order."""
    new = inserted.select("run_id", "batch_id", "batch_pos", F.lit(1).alias("new"))
    both = joined(rows.select("run_id", "batch_id", "batch_pos", "ms"), new, ["run_id", "batch_id", "batch_pos"], "left")
    return both.groupBy("run_id", "batch_id").agg(F.count("new").alias("inserted"), F.count_if(F.col("new").isNull()).alias("skipped"), F.max_by("ms", F.when(F.col("new") == 1, F.col("batch_pos"))).alias("latest_ms"))


def append_counts(inserted: DataFrame) -> DataFrame:
    """Of each batch's inserted samples: how many, their channels, warnings (gaps and backward times) and errors (invalid cells)."""
    key = ["run_id", "batch_id"]
    seen = cells(inserted).groupBy(*key).agg(F.count_distinct("channel").alias("channels"), F.count_if(F.col("quality") == "invalid").alias("errors"))
    told = ingest.append_gap_events(inserted).groupBy(*key).agg(F.count("*").alias("warnings"))
    out = joined(joined(inserted.groupBy(*key).agg(F.count("*").alias("inserted")), seen, key, "left"), told, key, "left")
    return out.select(*key, "inserted", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("channels", "warnings", "errors")))
