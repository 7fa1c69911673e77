"""Growing folders and pushed byte ranges.

Each step can run again after a lost executor or driver: what is stored decides what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import views
from ..sources import logfiles


def complete_prefix(files: DataFrame, by: str = "folder") -> DataFrame:
    """Content up to the last line end; a file with a later one in its folder is drained to its end."""
    newest = F.max("rank").over(Window.partitionBy(by))
    text = F.col("content").cast("string")
    rest = F.substring_index(text, "\n", -1)
    cut = F.expr("substring(content, 1, octet_length(content) - _rest)")
    out = files.withColumns({"_newest": newest, "_rest": F.octet_length(rest)})
    return out.withColumn("content", F.when(F.col("rank") < F.col("_newest"), F.col("content")).otherwise(cut)).drop("_newest", "_rest")


def advance(files: DataFrame, progress: DataFrame, by: str = "folder") -> tuple[DataFrame, DataFrame]:
    """New rows of ranked ``files`` beyond ``progress`` (path, bytes, records), and the progress after them.

    Files are read in rank order up to the first with an incomplete header.  A file shorter than its checkpoint gives no
    rows and the status ``shrunk``; it is never read anew from its start.
    """
    cut = complete_prefix(files, by).join(progress.select("path", F.col("bytes").alias("_bytes"), F.col("records").alias("_records")), "path", "left")
    headed = logfiles.barrier(logfiles.with_header(cut), by)
    shrunk = F.octet_length("content") < F.coalesce("_bytes", F.lit(0))
    headed = headed.withColumn("state", F.when(shrunk, "shrunk").when(F.col("readable"), "read").otherwise(F.col("status"))).withColumn("bytes", F.octet_length("content"))
    rows = logfiles.sequenced(logfiles.log_rows(headed.where("readable")), by)
    records = rows.groupBy("path").agg(F.count("*").alias("records"), F.max("seq").alias("last_seq"), F.max("ms").alias("latest_ms"))
    after = headed.select("path", by, "file", "rank", "state", "reason", "bytes", "_bytes", "_records").join(records, "path", "left")
    read = F.col("state") == "read"
    after = after.select(
        "path", by, "file", "rank", "state", "reason", F.when(read, F.col("bytes")).otherwise(F.coalesce("_bytes", F.lit(0))).alias("bytes"),
        F.when(read, F.coalesce("records", F.lit(0))).otherwise(F.coalesce("_records", F.lit(0))).alias("records"), "last_seq", "latest_ms",
    )
    new = rows.where("state = 'read' AND row_number - 1 > coalesce(_records, 0)").drop("_bytes", "_records", "bytes")
    return new, after


def status(progress: DataFrame, by: str = "folder") -> DataFrame:
    """Of each folder: files, the file in work and its offset, last sequence and latest sample."""
    return progress.groupBy(by).agg(F.count("*").alias("files"), F.max_by("file", "rank").alias("file"), F.max_by("bytes", "rank").alias("offset"), F.max("last_seq").alias("last_seq"), F.max("latest_ms").alias("latest_ms"))


def fold_ranges(ranges: DataFrame) -> DataFrame:
    """``verdict`` of pushed ranges (source, file, arrival, from_byte, to_byte, size): accepted, replay, hole or beyond.

    Only a range that starts at the running end moves it on.  A file's ranges come in chunks of up to a megabyte, so those
    of one file are few and folded as an array; the bytes themselves are not in it.  ``ranges`` has the same for very many.
    """
    fits = lambda r: r["to_byte"] <= r["size"]
    said = lambda end, r: F.when(~fits(r), "beyond").when(r["from_byte"] > end, "hole").when(r["from_byte"] < end, "replay").otherwise("accepted")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("verdicts"))

    def merge(state: Column, r: Column) -> Column:
        verdict = said(state["end"], r)
        return F.struct(F.when(verdict == "accepted", r["to_byte"]).otherwise(state["end"]).alias("end"), F.concat(state["verdicts"], F.array(verdict)).alias("verdicts"))

    row = F.struct("arrival", *(F.col(c).cast("long").alias(c) for c in ("from_byte", "to_byte", "size")))
    found = ranges.groupBy("source", "file").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    found = found.withColumn("folded", F.aggregate("rows", start, merge))
    return found.select("source", "file", F.inline(F.arrays_zip("rows", F.col("folded.verdicts").alias("verdict")))).select("source", "file", "rows.*", "verdict")


def missing_analyses(samples: DataFrame, analysed: DataFrame) -> DataFrame:
    """Samples of the runs that have no stored analysis (run_id) yet."""
    return samples.join(analysed.select("run_id").distinct(), "run_id", "left_anti")


def rejected_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Events of the rows (of ``advance``) that were refused or warned of, under their folder as run_id and the row number in the
    file, without those that are ``stored`` (run_id, event_type, metadata_json) already."""
    named = F.expr("left(path, length(path) - length(element_at(split(path, '/'), -1)) - 1)")
    found = logfiles.row_events(rows).select(named.alias("run_id"), "path", "row_number", "event_type", "severity", "metadata_json")
    return views.new_events(found, stored)
