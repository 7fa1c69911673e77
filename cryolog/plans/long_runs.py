"""Queries over one run or one file that all events make up, dealt by stretches of time, chains and rows, and over intervals that overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as an
from ..operators import dealt, intervals
from ..streaming import ranges
from .oracle import DERIVED, FRAMES, STATES, _T
from .telemetry import P, frames, wide

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
SLOWER = 400  # so that a frame follows the one before as late as in the runs of a user


def query(base: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _FOUND[f.__name__], _SQL[f.__name__] = f, f"WITH RECURSIVE {base}\n{sql}"
        return f

    return add


def one_run(spark: SparkSession, d: str) -> DataFrame:
    """All events as one run."""
    return wide(spark.read.parquet(f"{d}/events.parquet"), F.lit(0).cast("long"), F.col("event_id"), SLOWER)


def _long(base: str) -> str:
    base = base.replace("user_id AS run_id", "0::BIGINT AS run_id").replace("// 60000", f"// {SLOWER}")
    return base.replace("row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq", "event_id AS seq")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return dealt.analysed(one_run(spark, d), P)


@query(_long(STATES + DERIVED.removeprefix(FRAMES)), _T["i10_resumed_analysis"][1])
def e8_long_run(spark, d):
    return _rows(spark, d).select("run_id", "seq", "chain", "segment", "state", "loop", "weight_delta", F.round("cumulative_kwh", 4).alias("cumulative_kwh"))


@query(_long(STATES), _T["e12_cycle_outcome"][1])
def e12_long_run(spark, d):
    return an.cycles(_rows(spark, d)).select("run_id", "loop", "finished_ms", "status", F.col("confidence").cast("double").alias("confidence"))


@query(_long(STATES), _T["e13_chain_resets"][1])
def e13_long_run(spark, d):
    return dealt.resets(_rows(spark, d), P).select("run_id", "seq", "ms", "event_type", "loop", F.round("gap_min", 6).alias("gap_min"), "limit_min", "previous_seq")


NESTED = FRAMES + """,
nested AS (SELECT run_id, seq AS segment, ms AS started_ms, CASE WHEN k % 11 <> 0 THEN ms + (k % 9 - 1) * 1700001 END AS finished_ms FROM frames WHERE seq % 3 = 0)"""  # fmt: skip


def _nested(f: DataFrame) -> DataFrame:
    """Segments that overlap, lie inside each other, have no end, or end before they begin."""
    end = F.when(F.col("k") % 11 != 0, F.col("ms") + (F.col("k") % 9 - 1).cast("long") * 1_700_001)
    return f.where("seq % 3 = 0").select("run_id", F.col("seq").alias("segment"), F.col("ms").alias("started_ms"), end.alias("finished_ms"))


def _points(f: DataFrame) -> DataFrame:
    return f.select("run_id", F.col("seq").alias("point_id"), "ms")


@query(NESTED, """SELECT f.run_id, f.seq AS point_id, (SELECT arg_max(n.segment, (n.started_ms, n.segment)) FROM nested n
  WHERE n.run_id = f.run_id AND n.started_ms <= f.ms AND (n.finished_ms IS NULL OR f.ms <= n.finished_ms)) AS segment FROM frames f""")
def c13_last_of_overlapping(spark, d):
    f = frames(spark, d)
    return intervals.last_covering(_points(f), _nested(f)).select("run_id", "point_id", "segment")


@query(NESTED, "SELECT f.run_id, f.seq AS point_id, n.segment FROM frames f JOIN nested n ON n.run_id = f.run_id AND n.started_ms <= f.ms AND (n.finished_ms IS NULL OR f.ms <= n.finished_ms)")
def c14_all_overlapping(spark, d):
    f = frames(spark, d)
    return intervals.covering(_points(f), _nested(f)).select("run_id", "point_id", "segment")


PUSHED = """r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, 10 * (event_id // 3) + CASE WHEN event_id % 3 = 0 THEN 0 WHEN k % 7 = 0 THEN 50 WHEN k % 5 = 0 THEN -10 ELSE 0 END AS lo,
  CASE WHEN event_id % 3 = 2 AND k % 10 < 4 THEN 5 ELSE 1000000000000 END AS size FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
f AS (SELECT n, event_id, CASE WHEN lo + 10 > size THEN 'beyond' WHEN lo > 0 THEN 'hole' WHEN lo < 0 THEN 'replay' ELSE 'accepted' END AS verdict, CASE WHEN lo + 10 <= size AND lo = 0 THEN 10 ELSE 0 END AS reach FROM r WHERE n = 1
  UNION ALL SELECT r.n, r.event_id, CASE WHEN r.lo + 10 > r.size THEN 'beyond' WHEN r.lo > f.reach THEN 'hole' WHEN r.lo < f.reach THEN 'replay' ELSE 'accepted' END,
    CASE WHEN r.lo + 10 <= r.size AND r.lo = f.reach THEN r.lo + 10 ELSE f.reach END FROM f JOIN r ON r.n = f.n + 1)"""  # fmt: skip


@query(PUSHED, "SELECT event_id, verdict FROM f")
def i7_long_range_fold(spark, d):
    """All events as ranges of one file."""
    e = spark.read.parquet(f"{d}/events.parquet")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    shift = F.when(i % 3 == 0, 0).when(k % 7 == 0, 50).when(k % 5 == 0, -10).otherwise(0)
    pushed = e.select(i.alias("arrival"), F.lit("s").alias("source"), F.lit("f").alias("file"), (F.floor(i / 3) * 10 + shift).alias("from_byte"), F.when((i % 3 == 2) & (k % 10 < 4), 5).otherwise(10**12).alias("size"))
    return ranges.fold_ranges(pushed.withColumn("to_byte", F.col("from_byte") + 10)).select(F.col("arrival").alias("event_id"), "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
