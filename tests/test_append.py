"""The append job against a plain version that takes batches one by one, and its steps broken off and run again."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cryolog.sources import batches
from cryolog.streaming import append

ASSIGNMENTS = "run_id long, assignment_id long, version_id long, assigned_ms long, role string, active boolean"
STATES = "version_id long, state_id long, code string, external_code string, sort_order int"


def stamp(minute: float) -> str:
    return (datetime(2026, 8, 14, 10) + timedelta(minutes=minute)).isoformat(timespec="milliseconds")


def ms(text: str) -> int:
    return round((datetime.fromisoformat(text) - datetime(1970, 1, 1)).total_seconds() * 1000)


def sample(minute, seq=None, state=None, **cells):
    out = {"sampled_at": stamp(minute), "source_sequence": seq, "measurements": [{"channel_code": c} | v for c, v in (cells or {"RAF1": {"numeric_value": 1.0}}).items()]}
    return out | ({"state_observation": {"source_state_code": state}} if state else {})


def rows(spark, parts):
    shape = "run_id long, batch_id long, samples string"
    df = spark.createDataFrame([(r, b, json.dumps({"samples": s})) for r, b, s in parts], shape)
    return df.select("run_id", "batch_id", F.from_json("samples", batches.SCHEMA)["samples"].alias("samples"))


def catalogue(spark):
    assigned = spark.createDataFrame([(1, 10, 7, 0, "primary", True), (2, 20, 7, 5, "primary", True), (2, 19, 8, 9, "secondary", True)], ASSIGNMENTS)
    states = spark.createDataFrame([(7, 1, "A", "x", 1), (7, 2, "B", "y", 2), (7, 3, "x", "A", 3), (8, 9, "A", "A", 1)], STATES)
    closed = spark.createDataFrame([(9,)], "run_id long")
    return append.Catalogue(lambda: closed, lambda: assigned, lambda: states)


def plain(parts):
    """What the batches leave, one after another."""
    runs, out = {}, {"samples": [], "events": [], "refusals": set(), "reports": []}
    segments = {}
    assigned, states = {1: 10, 2: 20}, {"A": 1, "B": 2, "x": 3, "y": 2}
    for run, batch, samples in sorted(parts, key=lambda p: p[:2]):
        if run == 9:
            out["refusals"].add((run, batch, "run is closed"))
            continue
        held = runs.setdefault(run, {"seqs": {}, "channels": set()})
        mine = [list(s) for s in segments.get(run, [])]
        following, before = max(held["seqs"], default=0) + 1, max(held["seqs"].values(), default=None)
        first_before, new, events, skipped, why = before, {}, [], 0, None
        for s in samples:
            seq = s["source_sequence"]
            if seq is None:
                seq, following = following, following + 1
            if seq in held["seqs"] or seq in new:
                skipped += 1
                continue
            t = ms(s["sampled_at"])
            new[seq] = (t, first_before is not None and t < first_before)
            if before is not None and t < before:
                events.append((run, batch, seq, "timestamp_out_of_order"))
            elif before is not None and t - before > 360_000:
                events.append((run, batch, seq, "time_gap"))
            before = t
            code = (s.get("state_observation") or {}).get("source_state_code")
            if code and run in assigned:
                if code not in states:
                    events.append((run, batch, seq, "state_unmapped"))
                elif mine and t < mine[-1][1]:
                    why = "state older than its segment"
                    break
                else:
                    if mine:
                        mine[-1][2] = t
                    if not mine or mine[-1][0] != states[code]:
                        mine.append([states[code], t, None])
            for m in s["measurements"]:
                if m.get("quality") == "suspect":
                    events.append((run, batch, seq, "suspect_value"))
                elif m.get("numeric_value") is None:
                    events.append((run, batch, seq, "parse_error"))
        if why:
            out["refusals"].add((run, batch, why))
            continue
        held["seqs"] |= {q: t for q, (t, _) in new.items()}
        held["channels"] |= {m["channel_code"] for s in samples for m in s["measurements"]} if new else set()
        segments[run] = mine
        out["samples"] += [(run, q, t, late) for q, (t, late) in new.items()]
        out["events"] += events
        out["reports"].append((run, batch, len(new), skipped, sum(e[3] != "parse_error" for e in events), sum(e[3] == "parse_error" for e in events), list(new.values())[-1][0] if new else None))
    out["segments"] = sorted((r, k, *s) for r, x in segments.items() for k, s in enumerate(x, 1))
    out["runs"] = sorted((r, min(h["seqs"].values()), max(h["seqs"].values()), len(h["seqs"]), max(h["seqs"]), sorted(h["channels"])) for r, h in runs.items() if h["seqs"])
    return out


def stored(store):
    get = lambda name, *names: [tuple(r) for r in store.read(name).select(*names).collect()]
    segments = [(r.run_id, r.segment, r.state_id, r.started_ms, r.finished_ms) for r in store.segments().collect()]
    runs = [(r.run_id, r.started_ms, r.finished_ms, r.rows, r.last_seq, r.channels) for r in store.runs().collect()]
    return {
        "samples": sorted(get("samples", "run_id", "seq", "ms", "late")), "events": sorted(get("events", "run_id", "batch_id", "seq", "event_type")), "refusals": set(get("refusals", "run_id", "batch_id", "reason")),
        "reports": sorted(get("reports", "run_id", "batch_id", "inserted", "skipped", "warnings", "errors", "latest_ms"), key=repr), "segments": sorted(segments), "runs": sorted(runs),
    }


def random_batches(seed):
    r, out, minute = random.Random(seed), [], {1: 0.0, 2: 0.0, 3: 0.0, 9: 0.0}
    for batch in range(12):
        for run in minute:
            samples = []
            for _ in range(r.randint(1, 4)):
                minute[run] += r.choice([0, 1, 2, 9])
                cells = {"RAF1": {"numeric_value": 1.5}, "NOTE": r.choice([{"raw_text": "abc"}, {"numeric_value": 2.0, "quality": "suspect", "quality_reason": "q"}, {"numeric_value": 3.0}])}
                back = r.choice([0, 0, 0, 0, 7])
                samples.append(sample(minute[run] - back, r.choice([None, None, r.randint(1, 60)]), r.choice([None, "A", "A", "B", "x", "y", "zz"]), **cells))
            out.append((run, batch, samples))
    return out


def test_steps_against_batches_one_by_one(spark, tmp_path):
    parts = random_batches(1)
    want = plain(parts)
    assert len(want["refusals"]) > 13 and {e[3] for e in want["events"]} == {"timestamp_out_of_order", "time_gap", "state_unmapped", "suspect_value", "parse_error"}
    store = append.Store(spark, str(tmp_path))
    for step in range(2):
        append.run_step(store, rows(spark, [p for p in parts if p[1] // 6 == step]), step, catalogue(spark))
    got = stored(store)
    for name in want:
        assert got[name] == (want[name] if isinstance(want[name], set) else sorted(want[name], key=repr if name == "reports" else None)), name


def test_a_look_reads_only_runs_that_the_one_before_refused_a_batch_of(spark, tmp_path):
    parts = random_batches(1)
    again = {r for r, _, why in plain(parts)["refusals"] if why != "run is closed"}
    assert again and again < {r for r, _, _ in parts}
    append.run_step(append.Store(spark, str(tmp_path)), rows(spark, parts), 0, catalogue(spark))
    looks = sorted(tmp_path.glob("work/open-*"), key=lambda p: int(p.name[5:]))
    read = [spark.read.parquet(str(p)) for p in looks]
    assert len(read) > 2 and {r.run_id for r in read[1].select("run_id").distinct().collect()} == again
    counts = [df.count() for df in read]
    assert all(a > b for a, b in zip(counts, counts[1:])) and "measurements" not in read[0].columns


def test_a_step_that_breaks_off_is_done_again(spark, tmp_path, monkeypatch):
    parts = random_batches(3)[:8]
    one, two = append.Store(spark, str(tmp_path / "one")), append.Store(spark, str(tmp_path / "two"))
    steps = [rows(spark, [p for p in parts if p[1] == k]) for k in range(2)]
    for store in (one, two):
        append.run_step(store, steps[0], 0, catalogue(spark))
    whole, write = stored(two), append.Store.write

    def broken(self, name, df, step):
        if name == "segments":
            raise OSError("lost")
        write(self, name, df, step)

    monkeypatch.setattr(append.Store, "write", broken)
    with pytest.raises(OSError):
        append.run_step(two, steps[1], 1, catalogue(spark))
    assert stored(two) == whole  # nothing of half a step is seen
    monkeypatch.setattr(append.Store, "write", write)
    for store in (one, two, two):  # also twice
        append.run_step(store, steps[1], 1, catalogue(spark))
    assert stored(one) == stored(two) != whole
    with pytest.raises(ValueError):
        append.run_step(two, steps[0], 0, catalogue(spark))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = append.Store(spark, str(tmp_path / "store"))
    store.seed({"samples": spark.createDataFrame([(5, 3, 0, "t", None, None, False)], append.TABLES["samples"]), "runs": spark.createDataFrame([(5, "imported", ms(stamp(-9)), ms(stamp(-1)), 1, 3, ["VACUM"])], append.TABLES["runs"])})
    put = lambda n, *s: (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"run_id": 5, "batch_id": n, "samples": list(s)}))
    analysed = []
    go = lambda: append.append_stream(store, str(tmp_path / "in"), str(tmp_path / "check"), analyse=lambda df: analysed.append(df.count())).awaitTermination()
    put(1, sample(0), sample(5, 3), sample(5))
    go()
    put(2, sample(1), sample(20, 9, **{"RAF1": {"numeric_value": 1.0}, "raf 1": {"numeric_value": 1.0}}))
    put(3, sample(1, 8), sample(1, None, "A"))
    go()
    assert sorted((r.seq, r.late) for r in store.read("samples").collect()) == [(3, False), (4, False), (5, False), (6, True), (8, True)] and analysed == [3, 5]  # without a sequence: behind what was there when the batch began
    assert [tuple(r) for r in store.read("refusals").select("batch_id", "batch_pos", "reason").collect()] == [(2, 1, "channel twice")]
    run = store.runs().first()
    assert (run.status, run.started_ms, run.finished_ms, run.rows, run.last_seq, run.channels) == ("running", ms(stamp(-9)), ms(stamp(5)), 5, 8, ["RAF1", "VACUM"])
    assert [r.channels for r in store.read("reports").orderBy("batch_id").collect()] == [2, 2]
    assert store.read("cells").count() == 4 and store.read("observations").count() == 1


def test_breaches_of_new_kinds(spark):
    bad = sample(0, 1, "A") | {"state_observation": {"source_state_code": "  "}}
    df = batches.samples(rows(spark, [(1, 1, [bad, sample(0, 2, RAF1={"quality": "good"})])]))
    assert sorted(r.reason for r in batches.violations(df).collect()) == ["measurement without value", "state without code"]


def executions(found):
    runs = found.executionsList()
    return [runs.apply(i) for i in range(runs.size())]


def test_a_step_sends_no_table_by_run_to_the_driver(spark, tmp_path):
    parts, store = random_batches(3), append.Store(spark, str(tmp_path))
    found, done = spark._jsparkSession.sharedState().statusStore(), lambda: spark._jsc.sc().listenerBus().waitUntilEmpty()
    done()
    began = max((r.executionId() for r in executions(found)), default=-1)
    for step in range(2):
        append.run_step(store, rows(spark, [p for p in parts if p[1] % 2 == step]), step, catalogue(spark))
    done()
    sent, merged = [], 0
    for run in (r for r in executions(found) if r.executionId() > began):
        values, nodes = found.executionMetrics(run.executionId()), found.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            merged += node.name() == "SortMergeJoin"
            if node.name() == "BroadcastExchange":
                metrics = [node.metrics().apply(j) for j in range(node.metrics().size())]
                sent += [int(values.get(m.accumulatorId()).get()) for m in metrics if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined()]
    assert merged and set(sent) == {5}  # names of the recipes' states
