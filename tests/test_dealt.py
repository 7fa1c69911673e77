"""Runs dealt by stretches and chains against whole ones; intervals against plain comparisons."""

from __future__ import annotations

import random

import pytest

from cryolog.operators import analysis as an
from cryolog.operators import dealt, intervals
from cryolog.operators import reanalysis as again
from test_reanalysis import SCHEMA, P, runs, shown


def rounded(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in df.collect()), key=repr)


@pytest.mark.parametrize("span", [3_600_000, 20 * 3_600_000])
def test_dealt_equals_whole(spark, span):
    r = random.Random(span)
    rows = runs(r) + [(7, 1, 5, None, None, None, None, 3.0, 2.0, "completed"), (8, 1, None, -20.0, 0.5, 1.0, 2.0, None, None, "running"), (8, 2, 60_000, -20.0, 0.5, 1.0, 2.0, 4.0, 1.0, "running")]
    rows += [(9, n, -3_000_000_000 + n // 2 * 600_000_000, -20.0, 0.5, 1.0, 2.0, 4.0, float(n), "running") for n in range(12)]  # stretches without frames, equal times
    f = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole, parts = again.analysed(f, P).cache(), dealt.analysed(f, P, span).cache()
    assert shown(parts) == shown(whole)
    assert rounded(dealt.resets(parts, P)) == rounded(an.resets(whole, P))
    timed = lambda df: df.where("ms IS NOT NULL AND run_id <> 9")
    assert rounded(dealt.parallel_events(timed(parts), P, span)) == rounded(an.parallel_events(timed(whole), P))
    assert rounded(an.cycles(parts)) == rounded(an.cycles(whole)) and rounded(an.segments(parts)) == rounded(an.segments(whole))


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_no_window_orders_frames_of_a_run(spark):
    rows = dealt.analysed(spark.createDataFrame([], SCHEMA), P)
    windows = [x for x in nodes(rows._jdf.queryExecution().optimizedPlan()) if x.nodeName() == "Window"]
    spec = lambda x: x.partitionSpec().mkString()
    of_runs = [x for x in windows if "_part" not in spec(x) and "chain" not in spec(x)]
    assert len(windows) > len(of_runs) > 0
    assert not any("RAF1" in x.output().mkString() for x in of_runs)  # rows of stretches and chains only


def test_no_window_holds_a_chain(spark):
    rows = dealt.analysed(spark.createDataFrame([], SCHEMA), P)
    windows = [x for x in nodes(rows._jdf.queryExecution().optimizedPlan()) if x.nodeName() == "Window"]
    assert windows and not any("chain" in x.partitionSpec().mkString() for x in windows)


def test_chains_over_many_stretches(spark):
    r = random.Random(4)
    whole = lambda n: [(n, k, k * 60_000, r.choice([-20.0, -20.0, 850.0]), r.choice([0.2, 0.2, 0.9, 30.0, None]), r.choice([1.0, -5.0]), r.choice([2.0, 60.0]), r.choice([0.01, 5.0, None]), None, "running") for k in range(400)]
    f = spark.createDataFrame([x for n in range(6) for x in whole(n)], SCHEMA)
    assert shown(dealt.analysed(f, P, 180_000)) == shown(again.analysed(f, P))


def test_empty(spark):
    f = spark.createDataFrame([], SCHEMA)
    assert dealt.analysed(f, P).count() == dealt.parallel_events(dealt.analysed(f, P), P).count() == dealt.resets(dealt.analysed(f, P), P).count() == 0
    with pytest.raises(ValueError, match="shorter"):
        dealt.parallel_events(f, P, 1000)


@pytest.mark.parametrize("width", [40, 100_000, 1 << 42])
def test_intervals_equal_comparisons(spark, width):
    r = random.Random(width)
    at = lambda: r.randint(-width, width)
    segments = [(run, n, s, r.choice([None, s, s + r.randint(-3, width // 3)])) for run in (1, 2) for n in range(60) for s in [at()]]
    segments += [(1, 100, None, 5), (1, 101, None, None), (2, 102, 7, 7), (2, 102, 7, 7)]
    points = [(run, n, at()) for run in (1, 2, 3) for n in range(120)] + [(1, 200, None), (2, 201, 7)]
    points += [(run, 300 + 2 * n + i, t) for run, n, *ends in segments[:20] for i, t in enumerate(ends) if t is not None]
    s = spark.createDataFrame(segments, "run_id long, segment long, started_ms long, finished_ms long")
    p = spark.createDataFrame(points, "run_id long, point_id long, ms long")
    covers = lambda x, t: x[2] is not None and t is not None and x[2] <= t and (x[3] is None or t <= x[3])
    pairs = [(run, n, t, x[1]) for run, n, t in points for x in segments if x[0] == run and covers(x, t)]
    assert rounded(intervals.covering(p, s)) == sorted(pairs, key=repr)
    best = {(run, n, t): max(((x[2], x[1]) for x in segments if x[0] == run and covers(x, t)), default=(None, None))[1] for run, n, t in points}
    assert rounded(intervals.last_covering(p, s)) == sorted(((*k, v) for k, v in best.items()), key=repr)


def test_blocks_of_intervals_are_never_broadcast(spark):
    p, s = spark.createDataFrame([(1, 1, 5)], "run_id long, point_id long, ms long"), spark.createDataFrame([(1, 1, 0, None)], "run_id long, segment long, started_ms long, finished_ms long")
    for found in (intervals.covering(p, s), intervals.last_covering(p, s)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
