"""Consistent weighted sampling against exact generalised Jaccard similarities."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from cryolog.llm import op12_fingerprints as op

SCHEMA = "doc_id long, text string, copies int, x string, lanes string, _id string"


def similarity(a: str, b: str) -> float:
    one, two = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t) or [""]) for t in (a, b))
    return sum((one & two).values()) / sum((one | two).values())


def texts() -> list[str | None]:
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefé漢😀") for _ in range(4)) for _ in range(120)]
    prose = lambda n: " ".join(r.choice(vocabulary[: r.choice([20, 120])]) for _ in range(n))
    out = [None, "", " \n ", "one", "ab", "a a a a", prose(20_000), *(prose(r.randint(1, 250)) for _ in range(150))]
    return out + [out[10], out[10], out[11] + " more"]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(3 * i - 50, t, 1, "x", "y", "z") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return rows, {r.doc_id: r for r in op.compare_edited(docs).collect()}, {r.doc_id: r.fingerprint for r in op.fingerprints(docs).collect()}


def test_edited_texts_and_their_likeness(found):
    rows, got, alone = found
    assert sorted(got) == [r[0] for r in rows]
    off = []
    for k, (i, text, *_) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == alone[i] and len(r.fingerprint) == 4 * op.LANES
        assert r.near_edited == sum(r.fingerprint[j : j + 4] == r.edited_fingerprint[j : j + 4] for j in range(0, 4 * op.LANES, 4)) / op.LANES
        assert r.near_next == sum(r.fingerprint[j : j + 4] == got[rows[(k + 1) % len(rows)][0]].fingerprint[j : j + 4] for j in range(0, 4 * op.LANES, 4)) / op.LANES
        off += [(r.near_edited - similarity(text, edited), similarity(text, edited)), (r.near_next - similarity(text, following), similarity(text, following))]
    assert abs(sum(x for x, _ in off)) / len(off) < 0.02  # no bias
    inside = sum(abs(x) <= 3 * (s * (1 - s) / op.LANES) ** 0.5 + 1e-9 for x, s in off)
    assert inside >= 0.98 * len(off)


def test_equal_texts_have_equal_fingerprints(found):
    rows, got, _ = found
    by: dict = {}
    for i, text, *_ in rows:
        by.setdefault((text or "").strip(), set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)


def test_weights_decide_how_often_a_term_is_sampled(spark):
    weights = {7: 1, 8: 2, 9: 5}
    rows = [(k, (1000 * k + x) * 0x9E3779B97F4A7C1 % (1 << 63), w) for k in range(300) for x, w in weights.items()]
    lanes = op.signatures(spark.createDataFrame(rows, "k long, x long, w long"), ["k"]).collect()
    hits = Counter()
    for r in lanes:
        own = {x & 0xFFFF: w for k, x, w in rows if k == r.k}
        hits.update(own.get(v & 0xFFFF) for v in r.lanes)  # of weight 1 all, of others those of t = 0
    assert abs(hits[1] / (300 * op.LANES) - 1 / 8) < 0.02


def test_repeated_rows_one_row_and_none(spark):
    twice = spark.createDataFrame([(1, "a b c d", 1, "", "", ""), (1, "a b c d", 1, "", "", ""), (None, "a b c e", 1, "", "", "")], SCHEMA)
    got = op.compare_edited(twice).collect()
    assert [r.doc_id for r in got].count(1) == 2 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1 and len(got) == 3
    one = op.compare_edited(twice.limit(1)).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a").hexdigest()
    assert op.compare_edited(twice.where("false")).count() == 0 and op.fingerprints(twice.where("false")).count() == 0
