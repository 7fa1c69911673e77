"""Whitening of embeddings by the singular values of their centred rows, by bidiagonal qd iterations.

* Blockwise QR: each task folds its centred rows, BLOCK at a time, into one upper triangle R of the vectors' dimension, and
  triangles are folded together FAN at a time until one is left.  The covariance is never formed; R'R is n times it.
* R becomes bidiagonal by Householder reflections; those from the right are kept.
* dqds: with squares of the diagonal and the off-diagonal as q and e, each step shifts by a lower bound of the smallest
  squared value, 1 / sum(1 / d) over the d of a step without shift (a Newton step from below), so q and e stay positive and
  small values keep their relative accuracy.
* Twisted factorisations of LDL' - s give a vector for each squared value s: the factorisation from above and that from below
  meet where the pivot is smallest.  Vectors of values closer than CLOSE of their size are made orthogonal to each other.

Only R, of the square of the dimension, and sums of its size come to the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import common

BLOCK, FAN, CLOSE = 4096, 32, 1e-3
SCALE, OFFSET = 64, 1_000_000
_EPS, _LEAST = np.finfo(float).eps, np.finfo(float).tiny


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper off-diagonal of U'RV, and V, by Householder reflections from both sides."""
    a, v = r.astype(float).copy(), np.eye(r.shape[1])

    def mirror(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        u = x / norm
        u[0] += 1.0 if u[0] >= 0 else -1.0
        return u / np.linalg.norm(u)

    n = r.shape[1]
    for k in range(n):
        if (u := mirror(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < n - 2 and (u := mirror(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds step; None if the shift is too large."""
    d, new_q, new_e, ds = q[0] - shift, [], [], []
    for k in range(len(e)):
        if not d >= 0:
            return None
        ds.append(d)
        new_q.append(d + e[k])
        ratio = q[k + 1] / new_q[-1] if new_q[-1] > 0 else 0.0
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if not d >= 0:
        return None
    return [*new_q, d], new_e, [*ds, d]


def squared_values(diagonal: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The squared singular values of an upper bidiagonal matrix, in no order, by dqds with deflation and splits."""
    found: list[float] = []
    rest = [((diagonal**2).tolist(), (off**2).tolist(), 0.0)]
    while rest:
        q, e, shifted = rest.pop()
        while q:
            if len(q) == 1:
                found.append(shifted + q.pop())
                break
            if e[-1] <= _EPS**2 * (shifted + q[-1]) or e[-1] <= _LEAST:
                found.append(shifted + q.pop())
                e.pop()
                continue
            cut = next((k for k in range(len(e)) if e[k] <= _EPS**2 * (shifted + q[k]) or e[k] <= _LEAST), None)
            if cut is not None:
                rest.append((q[: cut + 1], e[:cut], shifted))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            q, e, d = _step(q, e, 0.0)
            shift = 1 / sum(1 / x for x in d) if min(d) > _LEAST else 0.0
            while shift > _EPS * shifted and shift > 0:
                if (moved := _step(q, e, shift * (1 - 4 * len(q) * _EPS))) is not None:
                    q, e, _ = moved
                    shifted += shift * (1 - 4 * len(q) * _EPS)
                    break
                shift /= 2
    return np.array(found)


def twisted(diagonal: np.ndarray, off: np.ndarray, s: float, skip: int = 0) -> tuple[np.ndarray, float]:
    """A vector of B'B for the squared value ``s`` of the upper bidiagonal B, and what to add to ``s``.

    ``skip``: take the twist at the place of the next smallest pivots instead, for further vectors of one value.
    """
    n = len(diagonal)
    guard = lambda x: x if abs(x) > _LEAST else _LEAST
    d, ratio = diagonal**2, np.array([b / guard(a) for a, b in zip(diagonal, off, strict=False)])
    above, below, down, up = np.empty(n), np.empty(n), np.zeros(n), np.zeros(n)
    above[0], below[-1] = -s, d[-1] - s
    for k in range(n - 1):  # LDL' - s from the top
        down[k] = d[k] * ratio[k] / guard(above[k] + d[k])
        above[k + 1] = down[k] * ratio[k] * above[k] - s
    for k in range(n - 2, -1, -1):  # and from the bottom
        t = d[k] / guard(d[k] * ratio[k] ** 2 + below[k + 1])
        up[k] = ratio[k] * t
        below[k] = below[k + 1] * t - s
    pivot = above + below + s
    at = int(np.argsort(np.abs(np.where(np.isfinite(pivot), pivot, np.inf)), kind="stable")[min(skip, n - 1)])
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -up[k] * z[k]
    size = float(z @ z)
    return z / np.sqrt(size), float(pivot[at] / size)


def singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values of ``r``, falling, and their right vectors as columns; values that are
    zero to working accuracy are left out."""
    diagonal, off, v = bidiagonal(r)
    n, top = len(diagonal), max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0))
    if not top:
        return np.zeros(0), np.zeros((n, 0))
    diagonal = np.where(np.abs(diagonal) < _EPS * top, _EPS * top, diagonal)  # within rounding; a factorisation needs it
    ends = [k + 1 for k in range(n - 1) if abs(off[k]) <= _EPS * min(abs(diagonal[k]), abs(diagonal[k + 1]))] + [n]
    parts = [(low, high) for low, high in zip([0, *ends], ends)]  # an off-diagonal of no weight parts the matrix
    found = [(s, low, high) for low, high in parts for s in squared_values(diagonal[low:high], off[low : high - 1])]
    found.sort(key=lambda x: -x[0])
    found = [x for x in found if x[0] > 16 * (n * _EPS) ** 2 * found[0][0]][:most]
    out = np.zeros((n, len(found)))
    for k, (s, low, high) in enumerate(found):
        d, e = diagonal[low:high], off[low : high - 1]
        near = [out[low:high, j] for j in range(k) if found[j][1] == low and found[j][0] - s <= CLOSE * found[j][0]]
        for skip in range(high - low):
            z, more = twisted(d, e, s, skip)
            if abs(more) <= 1e-6 * s:  # one correction by the Rayleigh quotient
                z = twisted(d, e, s + more, skip)[0]
            size = 1.0
            for other in [*near, *near]:
                z = z - (other @ z) * other
                size *= np.linalg.norm(z)
                z = z / max(np.linalg.norm(z), _LEAST)
            if size >= 0.01:
                break
        out[low:high, k] = z
    return np.array([x[0] for x in found]), v @ out


class Whitening(NamedTuple):
    """What is fitted: number and sums of the fit list, explained shares and directions (columns, over the square root of
    their variance), and the largest error of the whitened fit list's covariance."""

    n: int
    sums: np.ndarray
    explained: np.ndarray
    directions: np.ndarray
    identity_error: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in whole numbers."""
        return self.n * x - self.sums

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x) / self.n @ self.directions


def _long(v: str) -> str:
    return f"CAST(floor({SCALE}D * CAST({v} AS DOUBLE)) AS BIGINT) + {OFFSET}"


def cleaned(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """``embeddings`` with x, the vector in whole numbers; rows without a vector or with null or non-finite entries go, and so
    do vectors that have another length than most (the longest of those that are as many)."""
    fine = F.forall(column, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(fine)
    lengths = rows.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = lengths["size"] if lengths else 0
    return rows.where(F.size(column) == size).withColumn("x", F.expr(f"transform({column}, v -> {_long('v')})"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: pa.DataType = pa.float64()) -> dict[int, float]:
    """Sums over all ``x`` of the arrays that ``of`` (a block of vectors) gives, by place; one array a task."""
    schema = pa.schema([("at", pa.int64()), ("v", kind)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = of(_matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield common.batch(schema, [np.arange(len(total)), total])

    parts = rows.select("x").mapInArrow(scan, f"at long, v {'long' if kind == pa.int64() else 'double'}")
    return {r["at"]: r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}


def _totals(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0)])


def _triangles(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of all centred rows: a triangle a task, then FAN triangles a task until one is left."""
    d = len(sums)
    schema = pa.schema([("r", pa.list_(pa.float64()))])

    def folded(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for block in blocks:
            r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        if len(r):
            yield common.batch(schema, [[r.ravel()]])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for b in batches:
                x = (n * _matrix(b.column(0)) - sums) / n if b.num_rows else np.zeros((0, d))
                yield from (x[k : k + BLOCK] for k in range(0, len(x), BLOCK))

        return folded(blocks())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded(np.asarray(v).reshape(-1, d) for b in batches for v in b.column(0).to_pylist())

    found = common.stored(rows.select("x").mapInArrow(first, "r array<double>"), "triangles")
    while (left := found.count()) > 1:
        found = common.stored(found.repartition(ceil(left / FAN)).mapInArrow(again, "r array<double>"), "triangles")
    return np.asarray(found.first()["r"]).reshape(-1, d)


def fit(rows: DataFrame, components: int = 16) -> Whitening:
    """The whitening of ``rows`` (x, see ``cleaned``); each different vector counts once."""
    once = common.stored(rows.select("x").distinct(), "vectors")
    totals = _summed(once, _totals, pa.int64())
    if not totals:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums = totals[0], np.array([totals[k] for k in range(1, len(totals))], np.int64)
    r = _triangles(once, n, sums)
    values, vectors = singular(r, components)
    explained = values / max(float((r * r).sum()), _LEAST)
    found = Whitening(n, sums, explained, vectors / np.sqrt(values / n), 0.0)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = found.whiten(x)  # of rows whose mean is zero to working accuracy; what is left of it is taken off below
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    if k:
        got = _summed(once, moments)
        flat = np.array([got[i] for i in range(k + k * k)]) / n
        error = float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())
        found = found._replace(identity_error=error)
    return found


_WHITE = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whitened(rows: DataFrame, by: Whitening) -> DataFrame:
    """``rows`` with their whitened vectors as ``white``, an array of doubles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            white = by.whiten(_matrix(b.column(b.num_columns - 1))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(white), pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "white"])

    others = rows.drop("x", "white").schema
    return rows.select(*(f"`{f.name}`" for f in others), "x").mapInArrow(scan, others.add("white", ArrayType(DoubleType())))


def report(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each of the components, numbered
    from 1 by falling variance, of every row of ``embeddings`` (vec_id, embedding) that has a clean vector.

    Components are at most ``components`` and as many as have a variance; where all vectors are equal there are none and so no
    rows.  Of equal variances any directions that are orthogonal to each other count.  Repeated rows come out as often as
    they come in.  A deviation beyond 63 bits is an error, not a wrong number.
    """
    rows = cleaned(embeddings)
    by = fit(rows, components)
    k = len(by.explained)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and k:
                x = _matrix(b.column(1))
                away = by.deviations(x)
                if float((away.astype(float) ** 2).sum(1).max()) >= 2.0**63:
                    raise OverflowError("a deviation is beyond 63 bits")
                each = lambda v: np.repeat(v, k)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                shared = [np.tile(np.arange(1, k + 1), len(x)), np.full(len(x) * k, by.n), each((away**2).sum(1)), by.whiten(x).ravel(), np.tile(by.explained, len(x)), np.full(len(x) * k, by.identity_error)]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(shared, list(_WHITE)[1:], strict=True))], schema=_WHITE)

    return rows.select("vec_id", "x").mapInArrow(scan, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
