"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased (A-Z), its white space and control characters become single spaces, and its n-grams of 4 to 6
characters are hashed to BUCKETS; a feature is whether a text has a bucket at all.  Over the training rows, Spark counts
each bucket by class.  Every bucket whose two rates differ by MIN_Z standard errors or more is a feature, scaled by the log
ratio of the smoothed rates; ridge logistic regression weighs them.

Training takes labelled rows outside the held-out fold, at most TRAIN_ROWS of them, those of the smallest hash of
their id; this bound is all that limits what the driver holds.  Scores cover every whole text.

Null and empty texts have no features and get the score of the intercept.  A null id hashes as an empty text.  Repeated
label rows count once, as toxic if one of them is.  Without labelled rows of both classes, the score is their rate, or
0 if there are none.  A model without features can't tell texts apart; ``drop_toxic`` then keeps every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS, SIZES = 20, (4, 5, 6)
TRAIN_ROWS, MIN_Z, SMOOTH, RIDGE, THRESHOLD = 12_000, 4.0, 1.0, 1.0, 0.3
BUCKETS = 1 << BITS
_FOLD = bytes(32 if b <= 32 or b == 127 else b | 32 if 65 <= b <= 90 else b for b in range(256))
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def buckets(text: bytes) -> np.ndarray:
    """The bucket of every n-gram, with a space at either end of the text."""
    folded = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    data = np.frombuffer(folded, np.uint8) if folded.isascii() else np.frombuffer(folded.decode(errors="replace").encode("utf-32-le"), "<u4")
    data = data.astype(np.uint64) + np.uint64(1)
    out, gram = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        gram = gram[: len(data) - n + 1] * _BASE + data[n - 1 :]
        if n in SIZES:
            out.append(((gram + np.uint64(n)) * _MIX) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    weights: np.ndarray  # float32 by bucket
    intercept: float

    def score(self, text: bytes) -> float:
        at = buckets(text)
        at = at[self.weights[at] != 0]
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[np.unique(at)].sum(dtype=np.float64), -30, 30))))


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4


def _counts(sample: DataFrame) -> DataFrame:
    """Per task and bucket, how many texts of either class have it."""
    schema = pa.schema([("bucket", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for text, toxic in zip(common.as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                seen[1 - toxic, np.unique(buckets(text))] += 1
        at = np.flatnonzero(seen.any(0))
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield common.batch(schema, (part, seen[0, part], seen[1, part]))

    return sample.select("text", "toxic").mapInArrow(scan, "bucket int, pos long, neg long")


class Rows:
    """Labels and 0/1 features of the training rows, each scaled by a factor of its own; a sparse matrix by rows."""

    def __init__(self, y: np.ndarray, found: np.ndarray, sizes: np.ndarray, scale: np.ndarray):
        self.y, self.found, self.scale, self.row = y, found, scale, np.repeat(np.arange(len(y)), sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, (w * self.scale)[self.found], len(self.y))

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.found, v[self.row], len(self.scale)) * self.scale


def _features(sample: DataFrame, chosen: np.ndarray, scale: np.ndarray) -> Rows:
    """At most TRAIN_ROWS rows, each with those of its distinct n-grams that are features."""
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = sample.sparkSession.sparkContext.broadcast(place)
    schema = pa.schema([("toxic", pa.int32()), ("found", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(at[at >= 0]) for text in common.as_bytes(b.column(0)) for at in [shared.value[buckets(text)]]]
            yield common.batch(schema, (b.column(1).to_pylist(), found))

    rows = sample.select("text", "toxic").mapInArrow(scan, "toxic int, found array<int>").toArrow().combine_chunks()
    lists = rows.column(1).combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return Rows(rows.column(0).to_numpy().astype(np.float64), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), scale)


def _regression(rows: Rows) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients; the intercept is not shrunk."""
    n = len(rows.scale)
    ridge, w = np.append(np.full(n, RIDGE), 1e-6), np.zeros(n + 1)
    apply = lambda v: rows.dot(v[:-1]) + v[-1]
    back = lambda v: np.append(rows.back(v), v.sum())
    squares = np.append(np.bincount(rows.found, minlength=n) * rows.scale**2, len(rows.y))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(apply(w), -30, 30)))
        s = p * (1 - p) + 1e-6
        r = back(rows.y - p) - ridge * w
        step, z_of = np.zeros(n + 1), 1 / (squares * s.mean() + ridge)
        z = r * z_of
        d, rz, least = z, r @ z, 1e-8 * (r @ (r * z_of))
        for _ in range(100):
            hd = back(s * apply(d)) + ridge * d
            a = rz / (d @ hd)
            step += a * d
            r = r - a * hd
            z = r * z_of
            rz, before = r @ z, rz
            if rz <= least:
                break
            d = z + rz / before * d
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, seed_rows: int = TRAIN_ROWS) -> Model:
    """``labels`` (doc_id, toxic); rows of the held-out fold are never read as labels."""
    known = labels.where("toxic IN (0, 1)").where(fold() != 2).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    bound = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(seed_rows)  # two numbers a row: a bounded broadcast
    sample = common.stored(docs.select("doc_id", "text").join(F.broadcast(bound), "doc_id").select("text", "toxic"), "train")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        rate = n.get(1, 0) / max(1, sum(n.values()))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))
    rates = _counts(sample).groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = (F.col("pos") + F.col("neg")) / (n[0] + n[1])
    rates = rates.withColumn("z", F.abs(F.col("pos") / n[1] - F.col("neg") / n[0]) / F.sqrt(both * (1.0000001 - both) * (1 / n[0] + 1 / n[1])))
    top = rates.where(f"z >= {MIN_Z}").orderBy("bucket").toArrow()  # BUCKETS rows at most
    chosen = top.column("bucket").to_numpy()
    pos, neg = (top.column(k).to_numpy().astype(np.float64) for k in ("pos", "neg"))
    ratio = np.log(((pos + SMOOTH) / (n[1] + 2 * SMOOTH)) / ((neg + SMOOTH) / (n[0] + 2 * SMOOTH)))
    w, intercept = _regression(_features(sample, chosen, ratio))
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = w * ratio
    return Model(weights, intercept)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([shared.value.score(t) for t in common.as_bytes(b.column(1))], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), values], schema=schema)

    found = docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, score double")
    return found.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are."""
    if not model.weights.any():
        return docs
    common.small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) < threshold for t in common.as_bytes(b.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
