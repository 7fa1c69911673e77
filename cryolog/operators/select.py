"""Exact order statistics without a buffer of a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 1000


def exact_medians(rows: DataFrame, by: list[str], value: str = "value", accuracy: int = ACCURACY) -> DataFrame:
    """``median`` of the numbers in ``value`` of each group, the mean of the two middle ones where they are even in number;
    nulls don't count, and a group of nothing else has a null.

    A sketch, which merges over tasks, gives two values that the middle ones surely lie between, as its ranks are off by at
    most a share 1 / ``accuracy``.  Then each task counts what lies below them and each value between them, so a group
    sends on some 4 / ``accuracy`` of its rows, fewer where values are equal.  A running count finds the middle.
    """
    key = {c: f"_by{i}" for i, c in enumerate(by)}
    named = rows.select(*(F.col(c).alias(k) for c, k in key.items()), F.col(value).cast("double").alias("_v"))
    keys, off = list(key.values()), 2.0 / accuracy
    bounds = named.groupBy(*keys).agg(F.percentile_approx("_v", [0.5 - off, 0.5 + off], accuracy).alias("_q"), F.count("_v").alias("_n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = named.alias("a").join(bounds.alias("b"), same).select(*(F.col(f"a.{k}").alias(k) for k in keys), "_v", "_q", "_n")
    inside = F.when(F.col("_v").between(F.col("_q")[0], F.col("_q")[1]), F.col("_v"))
    counts = both.where("_v <= _q[1] OR _v IS NULL").groupBy(*keys, "_n", inside.alias("_in")).agg(F.count("_v").alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_in")))
    ranked = counts.withColumn("_upto", upto)
    missed = F.raise_error(F.lit("the sketch's values don't hold the middle between them")).cast("double")
    at = lambda rank: F.min(F.when((F.col("_upto") >= rank) & (F.col("_n") > 0), F.coalesce("_in", missed)))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return ranked.groupBy(*keys).agg(at(low).alias("_low"), at(high).alias("_high")).select(*(F.col(k).alias(c) for c, k in key.items()), ((F.col("_low") + F.col("_high")) / 2).alias("median"))
