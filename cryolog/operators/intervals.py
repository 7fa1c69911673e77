"""Points in intervals that overlap or lie inside each other, by an equi join.

Time is cut into blocks of 1, 16, 256, ... milliseconds.  An interval is the union of the largest blocks inside it, at most
thirty of each width, and a point lies in one block of each width.  So point and interval meet in one block exactly if the interval covers the
point, and no comparison of times follows.  Both ends are included, an open end has no end, and an interval that ends before it begins
or has no start covers nothing.  Times are taken as far as 2^44 milliseconds (557 years) from 1970.

Joins are told to merge: an estimate of their size knows nothing of how many blocks a segment has, and would send them all
through the driver to every machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4
LEVELS = range(0, 44, BITS)
LIMIT = 1 << 44


def _within(ms: Column) -> Column:
    return F.greatest(F.least(ms, F.lit(LIMIT)), F.lit(-LIMIT))


def _name(level: int, block: Column) -> Column:
    """One number for a block: its place, and its level in the last bits."""
    return F.shiftleft(block, BITS) + F.lit(level // BITS)


def blocks(start: Column, end: Column) -> Column:
    """The largest blocks inside ``start`` to ``end``: whole ones whose parent is not whole; see ``_name``."""
    after = F.when(start.isNotNull(), _within(F.coalesce(end + 1, F.lit(LIMIT))))
    start = _within(start)
    lo = lambda level: F.shiftright(start + F.lit((1 << level) - 1), level)
    hi = lambda level: F.shiftright(after, level)
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    named = lambda level: lambda x: _name(level, x)
    found = []
    for level in LEVELS:
        a, b, up = lo(level), hi(level), level + BITS
        parents = (lo(up) < hi(up)) if up in LEVELS else F.lit(False)
        left = F.when(parents, F.shiftleft(lo(up), BITS)).otherwise(b)
        right = F.when(parents, F.shiftleft(hi(up), BITS)).otherwise(b)
        found.append(F.transform(F.concat(run(a, left), run(right, b)), named(level)))
    return F.flatten(F.array(*found))


def _dealt(segments: DataFrame) -> DataFrame:
    at = F.explode(blocks(F.col("started_ms").cast("long"), F.col("finished_ms").cast("long")))
    return segments.select("run_id", F.struct("started_ms", "segment").alias("found"), at.alias("_at"))


def _placed(points: DataFrame) -> DataFrame:
    ms = F.when(F.abs("ms") < LIMIT, F.col("ms").cast("long"))
    at = F.array(*(_name(n, F.shiftright(ms, n)) for n in LEVELS))
    return points.select("run_id", "point_id", "ms", F.explode(at).alias("_at"))


def covering(points: DataFrame, segments: DataFrame) -> DataFrame:
    """run_id, point_id, ms, segment: a row for each of ``points`` (run_id, point_id, ms) and each of ``segments`` (run_id, segment,
    started_ms, finished_ms) that covers it."""
    return _placed(points).join(_dealt(segments).hint("merge"), ["run_id", "_at"]).select("run_id", "point_id", "ms", "found.segment")


def last_covering(points: DataFrame, segments: DataFrame) -> DataFrame:
    """All ``points`` with the ``segment`` that covers them, of several the one that begins last (of these the largest), null if there
    is none.

    Of the segments that hold a block only the last one counts, so a block is one row and a point meets a row a width at
    most, however many segments cover it.  Equal points of a run are one.
    """
    last = _dealt(segments).groupBy("run_id", "_at").agg(F.max("found").alias("found"))
    met = _placed(points).join(last.hint("merge"), ["run_id", "_at"], "left").groupBy("run_id", "point_id", "ms").agg(F.max("found").alias("found"))
    return met.select("run_id", "point_id", "ms", F.col("found.segment").alias("segment"))
