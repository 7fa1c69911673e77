"""Log files followed by their bytes: lines of ``sources.bytetail`` become numbered and judged rows, step by step.

What a step knows of files and folders lies in the tables of a store (see ``append``), a partition a step: bytes and records read of
each file and its header, and the last sequence of each folder.  A step that runs again starts from the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import bytetail, logfiles
from .append import Store

TABLES = {
    "files": "path string, folder string, file string, rank bigint, header string, bytes bigint, records bigint, state string, reason string, last_seq bigint, latest_ms bigint",
    "steps": "written boolean",
}


def store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, folder, TABLES)


def progress(kept: Store, below: int | None = None) -> DataFrame:
    """Each file as its last step left it."""
    rows = kept.read("files", below)
    return rows.groupBy("path").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("path", "step"))), "step").alias("f")).select("path", "f.*")


def advance(lines: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows of ``lines`` beyond the ``before`` of files, and these as they are then.

    A file that a later one of its folder has followed is complete, and what comes to it afterwards is left out.  So are bytes
    from before its progress: a file that has shrunk is not read anew.  Sequences of a folder go on behind its last one, and
    a rejected row keeps its own.
    """
    known = before.select("path", F.col("header").alias("_header"), F.col("bytes").alias("_bytes"), F.col("records").alias("_records"))
    tops = before.groupBy("folder").agg(F.max("rank").alias("_top"), F.max("last_seq").alias("_last"))
    new = lines.join(known, "path", "left").join(tops, "folder", "left").where("at >= coalesce(_bytes, 0) AND (rank >= coalesce(_top, rank) OR _bytes IS NULL)")
    raw = F.make_valid_utf8(F.col("line").cast("string"))
    new = new.withColumns({"whole": F.is_valid_utf8(F.col("line").cast("string")), "raw_line": F.when(F.col("at") == 0, F.regexp_replace(raw, "^\\ufeff", "")).otherwise(raw)})
    files = new.groupBy("path", "folder", "file", "rank").agg(
        F.coalesce(F.first("_header", True), F.first(F.when(F.col("at") == 0, F.col("raw_line")), True)).alias("header"), F.max("ends").alias("bytes"), F.first("_records").alias("_records")
    )
    headed = logfiles.with_header(files.withColumn("content", F.concat("header", F.lit("\n")).cast("binary")).withColumnRenamed("header", "_line"))
    ready = headed.where("status = 'ready'").select("path", "header", "codes", "stamp", "timed", "date")
    rows = new.where((F.col("at") > 0) & (F.trim("raw_line") != "")).join(ready, "path")
    in_file, in_folder = Window.partitionBy("path").orderBy("at"), Window.partitionBy("folder").orderBy("rank", "at")
    rows = rows.withColumns({
        "row_number": F.coalesce("_records", F.lit(0)) + 1 + F.row_number().over(in_file), "seq": F.coalesce("_last", F.lit(0)) + F.row_number().over(in_folder), "fields": logfiles.split_fields(F.col("raw_line")),
    })
    judged = logfiles.judged(rows).drop("_header", "_bytes", "_records", "_top", "_last", "line")
    read = judged.groupBy("path").agg(F.count("*").alias("_n"), F.max("seq").alias("last_seq"), F.max("ms").alias("latest_ms"))
    after = headed.join(read, "path", "left").select(
        "path", "folder", "file", "rank", F.col("_line").alias("header"), "bytes", (F.coalesce("_records", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("records"),
        F.when(F.col("status") == "ready", "read").otherwise(F.col("status")).alias("state"), "reason", "last_seq", "latest_ms",
    )
    return judged, after


def run_step(kept: Store, lines: DataFrame, step: int, sinks: list[Callable[[DataFrame, int], None]] = ()) -> None:
    """``sinks`` get the new rows and the number of the step before it counts; one that runs again gives them the same rows."""
    work = f"{kept.folder}/work/lines"
    lines.write.mode("overwrite").parquet(work)
    rows, after = advance(kept.spark.read.schema(bytetail.SCHEMA).parquet(work), progress(kept, step))
    for sink in sinks:
        sink(rows, step)
    kept.write("files", after, step)
    kept.close(step)


def tail_stream(kept: Store, root: str, checkpoint: str, sinks: list[Callable[[DataFrame, int], None]], pattern: str = "*.csv") -> StreamingQuery:
    """Follows the files under ``root`` up to what is there now; the checkpoint goes on from there next time."""
    bytetail.register(kept.spark)
    lines = kept.spark.readStream.format("growing_files").option("root", root).option("pattern", pattern).load()
    return lines.writeStream.foreachBatch(lambda rows, step: run_step(kept, rows, step, sinks)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
