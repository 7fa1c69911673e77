"""Retrieval packing: windows filled with a seed document and its nearest unused neighbours by BM25.

The documents are sorted by content, the three smallest hashes among their ROUTE_TERMS rarest terms one after another, and
cut by range into index shards of about SHARD_BYTES of text, so that texts that share rare terms tend to lie in one.  A
shard is an inverted index over token ids, scored with document frequencies and the mean length of the whole corpus.
Document by document, the next unused one opens a window; all its terms are asked for, and its best unused neighbours
fill the window in order of score.  The last of them is cut where the window ends, its rest opening the next window.  So
only a shard's last window has padding.  Documents of a window or more give whole windows first.

A stated limit: neighbours come from the seed's own shard, so the work for a document does not grow with the corpus.

A null text is empty and has the end id only.  Repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

WINDOW, SHARD_BYTES, ROUTE_TERMS, K1, B = 4096, 16 << 20, 12, 1.2, 0.75


def gains(tf: np.ndarray, idf: np.ndarray, lengths: np.ndarray | int, mean: float) -> np.ndarray:
    """What terms of these frequencies and idf add to a document's BM25 score."""
    return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / mean))).astype(np.float32)


class Index:
    """BM25 over one shard, a document's tokens as its terms."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
        owner = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        lengths = np.array([len(d) for d in docs])
        flat, tf = np.concatenate(self.terms), np.concatenate(counts)
        gain = gains(tf, idf[flat], lengths[owner], mean)
        order = np.argsort(flat, kind="stable")
        self.owner, self.gain = owner[order], gain[order]
        self.starts = np.searchsorted(flat[order], np.arange(len(idf) + 1))
        # a term of an eighth of the documents or more is a row over all of them: eight times the postings at most
        often = np.flatnonzero(np.diff(self.starts) * 8 >= len(docs))
        self.row = np.full(len(idf), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(docs)), np.float32)
        for r, t in zip(self.rows, often.tolist(), strict=True):
            r[self.owner[self.starts[t] : self.starts[t + 1]]] = self.gain[self.starts[t] : self.starts[t + 1]]
        self.unused = np.ones(len(docs), np.float32)

    def neighbours(self, seed: int, most: int = 64) -> list[int]:
        """The best unused documents that share a term with ``seed``, best first and ties in order; ask again for more."""
        scores = np.zeros(len(self.unused), np.float32)
        terms = self.terms[seed]
        rows = self.row[terms]
        for r in rows[rows >= 0].tolist():
            scores += self.rows[r]
        rare = terms[rows < 0]
        at = common.ranges(self.starts[rare], self.starts[rare + 1] - self.starts[rare])
        np.add.at(scores, self.owner[at], self.gain[at])  # one after another, in order of terms
        scores *= self.unused
        if len(scores) > most:
            least = np.partition(scores, -most)[-most]
            top = np.concatenate([np.flatnonzero(scores > least), np.flatnonzero(scores == least)])[:most]
        else:
            top = np.arange(len(scores))
        top = top[scores[top] > 0]
        return top[np.lexsort((top, -scores[top]))].tolist()


def windows(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """The windows of a shard, each a list of (document, start, length)."""
    rest = []  # where the part that is not packed yet begins
    for i, d in enumerate(docs):
        whole = len(d) // window * window
        for at in range(0, whole, window):
            yield [(i, at, window)]
        rest.append(whole)
    index = Index(docs, idf, mean)
    for i, d in enumerate(docs):
        index.unused[i] = rest[i] < len(d)
    cut, following = None, 0
    while True:
        while following < len(docs) and not index.unused[following]:
            following += 1
        seed = cut if cut is not None else following
        if seed == len(docs):
            return
        pieces, room, cut = [], window, None
        index.unused[seed] = 0
        queue, ranked = [seed], False
        while room:
            if not queue and not ranked:
                queue = index.neighbours(seed)[::-1]  # the next best each time, until none is left
                ranked = not queue
            if not queue:
                while following < len(docs) and not index.unused[following]:
                    following += 1
                if following == len(docs):
                    break
                queue = [following]
            i = queue.pop()
            index.unused[i] = 0
            length = min(room, len(docs[i]) - rest[i])
            pieces.append((i, rest[i], length))
            rest[i] += length
            room -= length
            if rest[i] < len(docs[i]):
                cut = i
        yield pieces


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("ids", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, spaces=False)
        small = max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        width, mark = ("<u2", b"\2") if small else ("<u4", b"\4")
        end = np.array([end_id], width).tobytes()
        begun, packed = deque(), []

        def texts() -> Iterator[str]:
            for b in batches:
                if b.num_rows:
                    begun.append(b.columns[:2])
                    yield from (t or "" for t in b.column(2).to_pylist())

        for ids in coder.encode_all(texts()):
            packed.append(mark + ids.astype(width).tobytes() + end)
            if len(packed) == len(begun[0][0]):
                yield pa.RecordBatch.from_arrays([*begun.popleft(), pa.array(packed, pa.binary())], schema=schema)
                packed = []

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), "text").mapInArrow(scan, "doc_id long, _row long, ids binary")


def route(ids: np.ndarray, idf: np.ndarray, mean: float) -> int:
    """Place of a document in the content order: three hashes of 16 bits, smallest first."""
    terms, tf = np.unique(ids, return_counts=True)
    rare = terms[np.argsort(-gains(tf, idf[terms], len(ids), mean), kind="stable")[:ROUTE_TERMS]]
    first = np.sort(rare.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48))[:3].tolist()
    a, b, c = first + [(1 << 16) - 1] * (3 - len(first))
    return a << 32 | b << 16 | c


def _routed(encoded: DataFrame, statistics: Broadcast) -> DataFrame:
    schema = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("_row", pa.int64()), ("ids", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = pa.array([route(_ids(x), *statistics.value) for x in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([places, *b.columns], schema=schema)

    return encoded.mapInArrow(scan, "place long, doc_id long, _row long, ids binary")


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _statistics(encoded: DataFrame, vocabulary: int) -> tuple[np.ndarray, float]:
    """idf by token id and mean document length, over all documents; the result is as long as the vocabulary."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, totals = np.zeros(vocabulary, np.int32), np.zeros(2, np.int64)  # a part has fewer than 2^31 documents
        seen = np.zeros(vocabulary, np.int32)
        for b in batches:
            for packed in b.column(0).to_pylist():
                ids = _ids(packed)
                seen[ids] = 1
                df += seen
                seen[ids] = 0
                totals += (1, len(ids))
        at = np.flatnonzero(df)
        yield common.batch(schema, (np.concatenate([[-1, -2], at]), np.concatenate([totals, df[at]])))

    rows = encoded.select("ids").mapInArrow(scan, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms, counts = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    df = np.zeros(vocabulary + 2)
    df[terms] = counts  # -1: documents, -2: ids
    n, ids = df[-1], df[-2]
    return np.log1p((n - df[:-2] + 0.5) / (df[:-2] + 0.5)), ids / max(1, n)


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of ``docs`` (doc_id, text)."""
    from tokenizers import Tokenizer

    common.small_batches(docs.sparkSession)
    shards = common.parts_for(docs, shard_bytes)
    encoded = common.stored(_encoded(docs, tokenizer, end_id), "ids")
    statistics = docs.sparkSession.sparkContext.broadcast(_statistics(encoded, max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)))
    routed = common.stored(_routed(encoded, statistics), "routed")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, shard = [], [], TaskContext.get().partitionId()
        for b in batches:
            names += b.column(0).to_pylist()
            ids += map(_ids, b.column(1).to_pylist())
        rows = []
        for number, pieces in enumerate(windows(ids, *statistics.value, window) if ids else ()):
            offset = 0
            for i, start, length in pieces:
                rows.append((names[i], start, length, zlib.crc32(ids[i][start : start + length].astype("<u4").tobytes()), len(ids[i]), shard << 32 | number, offset))
                offset += length
            if len(rows) >= 10_000:
                yield common.batch(_PIECES, zip(*rows, strict=True))
                rows = []
        if rows:
            yield common.batch(_PIECES, zip(*rows, strict=True))

    # a range is a shard; rows of one place, such as copies, are cut apart by id and row where they are more than that
    order = ["place", "doc_id", "_row"]
    ordered = routed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return ordered.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
