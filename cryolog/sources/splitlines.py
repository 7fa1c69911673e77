"""The rows of ``logfiles.log_rows`` from files of any size, which tasks read in splits.

A file's lines are numbered without moving them.  A first scan gives a row a split: its lines that are not blank, its first line, and
where it stands among the splits of its task; a running sum of these small rows is the number of its first line.  The second scan
adds a line's place in its task to that, and takes the header of its file from the first split.

Both scans are cut into splits alike as long as the cluster keeps its size between their plans.  Should they not be, places fall outside
their splits, and the job fails rather than number a line wrongly; it can then run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import logfiles

SPLIT = ["path", "_block"]
TASK_BITS = 33  # of a row's place in its task, in ids that Spark gives out


def lines(spark: SparkSession, folder: str, pattern: str = "*.csv", copies: bool = False) -> DataFrame:
    """path, folder, file, modified, size, _block (first byte of the split), line (raw bytes as text, without its end)."""
    meta = lambda name: F.col(f"_metadata.{name}")
    told = lambda name: F.url_decode(F.replace(meta(name), F.lit("+"), F.lit("%2B")))
    found = spark.read.option("lineSep", "\n").text(folder).where(logfiles.wanted(told("file_name"), pattern, copies))
    path, name = told("file_path"), told("file_name")
    return found.select(
        path.alias("path"), F.left(path, F.length(path) - F.length(name) - 1).alias("folder"), name.alias("file"), meta("file_modification_time").alias("modified"),
        meta("file_size").alias("size"), meta("file_block_start").alias("_block"), F.col("value").alias("line"),
    )


def _plain(line):
    return F.regexp_replace(F.make_valid_utf8(line), "\r$", "")


def splits(found: DataFrame) -> DataFrame:
    """A row for each split of ``lines``: n lines that are not blank, ``_first`` of their ids, ``_before``, the lines of earlier splits of
    the file, and of the file's whole: valid bytes."""
    numbered = found.withColumns({"_id": F.monotonically_increasing_id(), "_task": F.spark_partition_id().cast("long")})
    counted = F.count_if(F.trim(_plain(F.col("line"))) != "").alias("n")
    head = F.min_by(F.left("line", F.lit(logfiles.HEADER_BYTES + 2)), "_id").alias("line")
    each = numbered.groupBy(*SPLIT).agg(
        *(F.first(c).alias(c) for c in ("folder", "file", "modified", "size", "_task")), F.min("_id").alias("_id"), counted, head,
        F.bool_and(F.is_valid_utf8("line")).alias("whole"),
    )
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.shiftleft("_task", TASK_BITS) + earlier(Window.partitionBy("_task").orderBy("_id"))
    return each.withColumns({
        "_first": first, "_before": earlier(Window.partitionBy("path").orderBy("_block")), "whole": F.bool_and("whole").over(Window.partitionBy("path")),
    }).drop("_task", "_id")


def with_header(parts: DataFrame) -> DataFrame:
    """Files of ``splits`` as ``logfiles.with_header`` gives them, without their content; a line that is too large is cut there.  An
    empty file has no line and is not among them."""
    heads = parts.where("_block = 0").drop("_block", "n", "_first", "_before")
    complete = F.octet_length("line") < F.col("size")
    bare = F.regexp_replace(_plain(F.col("line")), "^﻿", "")
    return logfiles.judged_header(heads.withColumn("complete", complete).withColumn("line", bare)).drop("size")


def log_rows(found: DataFrame, parts: DataFrame, headed: DataFrame) -> DataFrame:
    """The records of ready files, as ``logfiles.log_rows`` gives them; ``found``: their ``lines``, ``parts``: their ``splits``,
    ``headed``: their ``with_header``, with ranks or not."""
    info = parts.select(*SPLIT, "n", "_first", "_before").join(headed.drop("reason"), "path")
    kept = found.select(*SPLIT, _plain(F.col("line")).alias("raw_line")).where(F.trim("raw_line") != "").withColumn("_id", F.monotonically_increasing_id())
    rows = kept.join(info, SPLIT, "left")
    place = F.col("_id") - F.col("_first")
    number = F.when((place >= 0) & (place < F.col("n")), F.col("_before") + place + 1).otherwise(F.raise_error(F.lit("the files were split in another way by the second scan")).cast("long"))
    rows = rows.withColumn("row_number", number).where(F.coalesce("status", F.lit("ready")) == "ready").where("row_number > 1")
    return logfiles.judged(rows.withColumn("fields", logfiles.split_fields(F.col("raw_line")))).drop("n", "_id", "_first", "_before", "_block", "whole")
