"""``tail.fold_ranges`` for files of very many pushed ranges: rows that are joined, no array of a file.

The range that moves a file's end on after another one is the first later one that begins where that one ends.  So accepted
ranges are a list that begins at byte 0, and the pointers of all ranges are doubled in each round: from the first 2^k of the list
the next 2^k are found by one join.  Rounds are stored as tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .append import scratch


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read again; a checkpoint would compute its last stage twice."""
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def followers(rows: DataFrame) -> DataFrame:
    """``next`` of each range (f, n, from_byte, to_byte, fits) that another one can follow: the first later one that begins where it ends."""
    fit = rows.where("fits")
    line = fit.select("f", F.col("from_byte").alias("at"), "n", F.col("n").alias("begins")).unionByName(fit.select("f", F.col("to_byte").alias("at"), "n", F.lit(None).cast("int").alias("begins")))
    order = Window.partitionBy("f", "at").orderBy(F.desc("n"), F.col("begins").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("next", F.last("begins", ignorenulls=True).over(order)).where("begins IS NULL AND next IS NOT NULL").select("f", "n", "next")


def fold_ranges(ranges: DataFrame) -> DataFrame:
    """``verdict`` of pushed ranges, see ``tail.fold_ranges``."""
    file = Window.partitionBy("source", "file").orderBy("arrival", "from_byte", "to_byte", "size")
    numbers = (F.col(c).cast("long").alias(c) for c in ("from_byte", "to_byte", "size"))
    rows = ranges.select("source", "file", "arrival", *numbers).withColumn("n", F.row_number().over(file))
    rows = kept(rows.withColumns({"f": F.struct("source", "file"), "fits": F.coalesce(F.expr("to_byte <= size"), F.lit(False))}))
    reached = kept(rows.where("fits AND from_byte = 0").groupBy("f").agg(F.min("n").alias("n")))
    step, found = kept(followers(rows)), reached
    while not found.isEmpty():
        found = kept(reached.join(step, ["f", "n"]).select("f", F.col("next").alias("n")))
        reached = reached.unionByName(found)
        step = kept(step.join(step.select("f", F.col("n").alias("next"), F.col("next").alias("after")), ["f", "next"]).select("f", "n", F.col("after").alias("next")))
    moved = rows.join(reached.withColumn("_moves", F.lit(True)), ["f", "n"], "left")
    end = F.coalesce(F.last(F.when(F.col("_moves"), F.col("to_byte")), ignorenulls=True).over(Window.partitionBy("f").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    verdict = F.when(~F.col("fits"), "beyond").when(F.col("from_byte") > end, "hole").when(F.col("from_byte") < end, "replay").otherwise("accepted")
    return moved.select("source", "file", "arrival", "from_byte", "to_byte", "size", verdict.alias("verdict"))
