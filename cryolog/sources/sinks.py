"""Tables by run, and the wide export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_runs(rows: DataFrame, path: str, by: list[str] | None = None, touched: DataFrame | None = None) -> None:
    """Replace the partitions of the runs in ``rows``; a run of ``touched`` without rows is emptied.

    A dynamic overwrite leaves partitions alone that get no rows, so each touched one gets a row marked ``_none``, which
    ``read_runs`` leaves out.
    """
    by = by or ["run_id"]
    marked = rows.withColumn("_none", F.lit(False))
    if touched is not None:
        marked = marked.unionByName(touched.select(*by).distinct().withColumn("_none", F.lit(True)), allowMissingColumns=True)
    marked.repartition(*by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("NOT _none").drop("_none")


def write_import(tables: dict[str, DataFrame], ledger: DataFrame, folder: str) -> None:
    """The tables of imported runs (channels, frames, cells, observations, events, …), each under its name in ``folder``, and then
    the rows of ``ledger`` (run_id, sha256, …).  A run counts as imported from its ledger row on, so an import that broke off
    is done again, and doing it again changes nothing."""
    runs = ledger.select("run_id")
    for name, rows in tables.items():
        write_runs(rows, f"{folder}/{name}", touched=runs)
    write_runs(ledger, f"{folder}/imports")


def write_analysis(tables: dict[str, DataFrame], runs: DataFrame, profile: str, folder: str) -> None:
    """Replaces what is stored of ``runs`` under this profile by ``tables`` (cycles, segments, events, derived values); other
    profiles stay, and a run without rows in a table is emptied there."""
    named = lambda df: df.withColumn("profile", F.lit(profile))
    for name, rows in tables.items():
        write_runs(named(rows), f"{folder}/{name}", ["run_id", "profile"], named(runs.select("run_id")))


def export_lines(cells: DataFrame, channels: list[str]) -> DataFrame:
    """run_id, seq, line: the timestamp text and the raw text of each channel in the order given, empty where there is none."""
    wide = cells.groupBy("run_id", "seq", "source_timestamp_text").pivot("channel", channels).agg(F.first("raw_text"))
    fields = [F.col("source_timestamp_text"), *(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in channels)]
    return wide.select("run_id", "seq", F.concat_ws(";", *map(_quoted, fields)).alias("line"))


def _quoted(field: Column) -> Column:
    return F.when(field.rlike('[;"\n\r]'), F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def channel_order(cells: DataFrame) -> list[str]:
    """Channels by first appearance; there are at most a few dozen, so their names may come to the driver."""
    first = cells.groupBy("channel").agg(F.min(F.struct("seq", "position")).alias("at"))
    return [r[0] for r in first.orderBy("at", "channel").select("channel").collect()]


def export_file(cells: DataFrame, channels: list[str], path: str) -> None:
    """Text files in sequence order under ``path``, a folder for each run; the header stands first."""
    lines = export_lines(cells, channels)
    head = lines.select("run_id").distinct().select("run_id", F.lit(-1).cast("long").alias("seq"), F.lit(";".join(["TARIH SAAT", *channels])).alias("line"))
    every = lines.select("run_id", F.col("seq").cast("long").alias("seq"), "line").unionByName(head)
    every.repartition("run_id").sortWithinPartitions("run_id", "seq").select("run_id", F.col("line").alias("value")).write.partitionBy("run_id").mode("overwrite").text(path)


def export_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), "[^A-Za-z0-9._-]+", "_")


def latest_assignment(assignments: DataFrame) -> DataFrame:
    """The active primary recipe assignment of each run (run_id, assignment_id, assigned_ms, role, active): the latest, then the largest id."""
    last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("assigned_ms"), F.desc("assignment_id")))
    return assignments.where("active AND role = 'primary'").withColumn("_n", last).where("_n = 1").drop("_n")
