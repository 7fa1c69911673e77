"""Bidiagonal qd whitening against a library's eigenvectors and exact whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cryolog.llm import op11_whitening as op

SCHEMA = "vec_id long, embedding array<float>, x int, component string, white string"


def matrices():
    r = np.random.default_rng(4)
    yield r.normal(size=(30, 12))
    yield r.normal(size=(9, 9)) @ np.diag(10.0 ** -np.arange(9.0)) @ r.normal(size=(9, 9))
    yield np.diag([3.0, 3.0, 3.0, 2.0, 0.0, 1.0])
    yield np.kron(np.eye(3), np.array([[2.0, 1.0], [0.0, 1.0]]))  # each value three times
    yield np.outer(np.arange(5.0), np.ones(5))
    yield np.tril(np.ones((21, 21))) + 1e-9 * r.normal(size=(21, 21))
    yield np.zeros((4, 4))
    yield np.array([[2.5]])


@pytest.mark.parametrize("a", list(matrices()))
def test_values_and_vectors(a):
    r = np.linalg.qr(a, mode="r")
    values, vectors = op.singular(r, 16)
    want = np.sort(np.linalg.svd(a, compute_uv=False))[::-1] ** 2
    want = want[want > 1e-26 * max(want[0], 1e-300)][:16]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-12, atol=1e-13 * max([*want, 1]))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-11
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max(initial=0) < 1e-12 * max([*want, 1])


def test_small_values_keep_their_accuracy():
    d, e = 10.0 ** -np.arange(12.0), 10.0 ** -(np.arange(11.0) + 0.5)
    values = np.sort(op.squared_values(d, e))
    from fractions import Fraction

    def below(s: Fraction) -> int:  # number of values under s, by exact Sturm counts
        q, b = [Fraction(float(x)) ** 2 for x in d], [Fraction(float(x)) ** 2 for x in e]
        diagonal = [q[0], *(q[k] + b[k - 1] for k in range(1, 12))]
        off = [q[k] * b[k] for k in range(11)]
        count, p = 0, None
        for k in range(12):
            p = diagonal[k] - s - (off[k - 1] / p if k else 0)
            count += p < 0
        return count

    for k, v in enumerate(values):
        assert below(Fraction(v * (1 - 1e-13))) == k and below(Fraction(v * (1 + 1e-13))) == k + 1


def rows():
    r = random.Random(8)
    vectors = [[r.gauss(0, 0.2 * (1 + j % 5)) for j in range(20)] for _ in range(300)]
    out = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[7]) for i in range(150)] + [(2000, [x + 1e-6 for x in vectors[9]])]
    return out + [(3000, None), (3001, [None] * 20), (3002, [1.0] * 19 + [math.nan]), (3003, [math.inf] + [0.0] * 19), (3004, []), (3005, [1.0] * 19), (None, vectors[3]), (5, vectors[5])]


def test_report(spark):
    df = spark.createDataFrame([(i, v, 1, "c", "w") for i, v in rows()], SCHEMA).repartition(5)
    got = op.report(df).collect()
    clean = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows() if v and len(v) == 20 and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in clean})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = (n * np.array(fit) - np.array(sums)) / n
    v = centred.T @ centred / n
    e, directions = np.linalg.eigh(v)
    e, directions = e[::-1][:16], directions[:, ::-1][:, :16]
    assert len(got) == 16 * len(clean) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-10
    by: dict = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    signs = {}
    for i, x in clean:
        away = [n * c - s for c, s in zip(x, sums, strict=True)]
        want = np.array(away) / n @ directions / np.sqrt(e)
        for r in by[i]:
            k = r.component - 1
            assert r.deviation == sum(a * a for a in away) and abs(r.explained - e[k] / np.trace(v)) < 1e-12
            if abs(want[k]) > 1e-6:
                signs.setdefault(k, set()).add(round(r.whitened / want[k], 8))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 16


def test_whole_vectors_keep_columns(spark):
    df = spark.createDataFrame([(i, v, 1, "c", "w") for i, v in rows()], SCHEMA)
    clean = op.cleaned(df)
    out = op.whitened(clean, op.fit(clean, 3))
    assert out.columns == ["vec_id", "embedding", "component", "white"] and {len(r.white) for r in out.collect()} == {3}


def test_few_rows_and_none(spark):
    make = lambda vs: spark.createDataFrame([(i, v, 1, "c", "w") for i, v in enumerate(vs)], SCHEMA)
    assert op.report(make([])).collect() == [] and op.report(make([None, []])).collect() == []
    assert op.report(make([[1.0, 2.0]] * 3)).collect() == []  # one vector: no variance
    two = op.report(make([[1.0, 2.0], [2.0, 4.0], [2.0, 4.0]])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 12)), round(r.explained, 12)) for r in two) == [(i, 1, 2, 64**2 + 128**2, 1.0, 1.0) for i in range(3)]


def test_folding_many_triangles(spark, monkeypatch):
    monkeypatch.setattr(op, "FAN", 2)
    monkeypatch.setattr(op, "BLOCK", 3)
    r = np.random.default_rng(1)
    x = r.integers(-50, 50, (200, 6)) + 1_000_000
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(9)
    got = op._triangles(df, 200, x.sum(0))
    centred = x - x.mean(0)
    assert np.allclose(got.T @ got, centred.T @ centred)
