"""Analyses taken up again from the first touched chain, against whole ones, on random late frames."""

from __future__ import annotations

import random
import re

import pytest

from cryolog.functions.profile import Profile
from cryolog.operators import reanalysis as again
from cryolog.plans import telemetry

P = Profile(state_reset_gap_minutes=40.0)
SCHEMA = "run_id long, seq long, ms long, RAF1 double, VACUM double, S2 double, S4 double, `E.GUC` double, TARTIM double, run_status string"
SHOWN = ["run_id", "seq", "chain", "segment", "state", "loop", "gap_min", "reset", "interval_kwh", "cumulative_kwh", "weight_delta"]


def runs(r):
    rows = []
    for run in range(1, 7):
        ms = 0
        for seq in range(1, 90):
            ms += r.choice([1, 3, 5, 10, 30, 50]) * 60_000
            pick = lambda *x: r.choice([*x, None])
            rows.append((run, seq, ms, pick(850.0, -20.0, -20.0), pick(0.5, 0.5, 1.0, 100.0), pick(-20.0, 5.0), pick(-25.0, 9.0), pick(60.0, 2.0, 50.0), pick(3.0, 2.5), "running"))
    return rows


def shown(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.select(*SHOWN).collect()), key=lambda t: t[:2])


@pytest.mark.parametrize("seed", [1, 2])
def test_resumed_equals_whole(spark, seed):
    r = random.Random(seed)
    rows = runs(r)
    at_random = {(run, r.randint(1, 89)) for run in (1, 2, 3) for _ in range(3)} | {(4, 1), (5, 89), (3, 40), (3, 41), (3, 42)}
    late = [x for x in rows if x[:2] in at_random]
    f, new = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(late, SCHEMA)
    stored = again.analysed(spark.createDataFrame([x for x in rows if x[:2] not in at_random], SCHEMA), P)
    ends = again.chain_ends(stored, f.columns)
    at = again.resumption(ends, new)
    fresh = again.resume(f, at, P)
    assert shown(again.merged(stored, fresh, at)) == shown(again.analysed(f, P))
    # what is read: the frames from the touched chain on, and none of a run without new ones
    begun = {(x.run_id, x.chain): x.started_ms for x in ends.collect()}
    first = {run: min(x[2] for x in late if x[0] == run) for run in {x[0] for x in late}}
    cut = {run: max((t for (k, _), t in begun.items() if k == run and t < ms), default=-1) for run, ms in first.items()}
    read = again.resumed_frames(f, at).count()
    assert read == fresh.count() == sum(x[2] >= cut[x[0]] for x in rows if x[0] in cut)
    assert sum(x[0] == 5 and x[2] >= cut[5] for x in rows) < 45  # the last frame of a run costs its last chain only


def test_ends_of_a_resumed_analysis_go_on(spark):
    rows = runs(random.Random(3))[:89]
    parts = [rows[:30], rows[30:50], rows[50:]]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    stored, have = again.analysed(df(parts[0]), P), list(parts[0])
    for new in parts[1:]:
        have += new
        f = df(have)
        at = again.resumption(again.chain_ends(stored, f.columns), df(new))
        stored = again.merged(stored, again.resume(f, at, P), at)
    assert shown(stored) == shown(again.analysed(df(rows), P))


def test_resumed_query_deals_runs_by_their_frames(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "FRAMES_EACH", 50)
    d = "/root/testdata/sf0.001"
    parts = telemetry.parts_of(spark, d)
    plan = telemetry.i10_resumed_analysis(spark, d)._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\(run_id#\d+L, (\d+)\)", plan))
    assert parts > 4 and dealt == {str(parts)}  # none to the session's partitions, however many frames there are
