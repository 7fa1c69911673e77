"""Benchmark decontamination by a broadcast set of the benchmark's n-grams.

Words are runs of ASCII letters and digits (lower-cased) and of all characters beyond ASCII.  A window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window.  The windows are broadcast only in
blocks of BLOCK_WINDOWS of them, some 100 MB in memory, whatever the benchmark: a longer one is scanned block by block
and what the blocks found in a document is put together.

Null or empty texts have no words and no hits.  A null item id takes part under the empty string.  Repeated rows are
judged one by one; other columns are ignored by the report and kept by the filters.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N, BLOCK_WINDOWS = 13, 400_000
_FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """The windows of a block of benchmark items, by length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.ids: dict[bytes, int] = {}
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, words in items:
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], "<u4").tobytes()
            size = min(n, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found[size][ids[4 * i : 4 * (i + size)]].add(item)
        self.by_size = {size: {k: tuple(v) for k, v in windows.items()} for size, windows in found.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that are occurrences of windows, and their items."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), "<u4", len(words))
        known, raw, spans, items = np.concatenate([[0], np.cumsum(ids > 0)]), ids.tobytes(), [], set()
        for size, windows in self.by_size.items():
            for p in np.flatnonzero(known[size:] - known[:-size] == size).tolist() if len(ids) >= size else ():
                if hit := windows.get(raw[4 * p : 4 * (p + size)]):
                    spans.append((p, p + size))
                    items.update(hit)
        return spans, items


def _blocks(benchmark: DataFrame, n: int) -> Iterator[Windows]:
    """BLOCK_WINDOWS windows of the benchmark in the driver at a time; a very long item is cut into overlapping parts."""
    items, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    for r in rows.toLocalIterator():
        words, at = words_of(bytes(r.text)), 0
        while at == 0 or at + n <= len(words):
            part = words[at : at + BLOCK_WINDOWS - size + n - 1]
            items.append((r.item, part))
            size += max(1, len(part) - n + 1)
            at += max(1, len(part) - n + 1)
            if size >= BLOCK_WINDOWS:
                yield Windows(items, n)
                items, size = [], 0
    yield Windows(items, n)


def _covered(spans: list[tuple[int, int]], n_words: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int32)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


_FOUND = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _scan(docs: DataFrame, windows: Windows, keys: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in common.as_bytes(b.column(b.num_columns - 1)):
                spans, items = shared.value.scan(words := words_of(text))
                out.append((len(words), [x for s in spans for x in s], sorted(items)))
            found = common.batch(_FOUND, zip(*out, strict=True) if out else ([], [], []))
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + found.columns, names=[*keys, *_FOUND.names])

    types = dict(docs.dtypes)
    return docs.select(*keys, "text").mapInArrow(scan, ", ".join(f"{k} {types[k]}" for k in keys) + ", n_words long, spans array<int>, items array<string>")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    common.small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, n)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _scan(docs, first, ["doc_id"])
    else:
        keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
        keyed = common.stored(keyed, "keyed")
        found = _scan(keyed, first, ["_row", "doc_id"])
        for windows in chain([second], blocks):
            found = found.unionByName(_scan(keyed, windows, ["_row", "doc_id"]))
        found = found.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items")).drop("_row")
        found = found.withColumn("items", F.array_sort(F.array_distinct("items")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n_words, spans, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n_hit = int(_covered([*zip(spans[::2], spans[1::2], strict=True)], n_words).sum()) if spans else 0
                rows.append((doc_id, n_words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words))
            if rows:
                yield common.batch(_HITS, zip(*rows, strict=True))

    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


Judge = Callable[[str | None, list[tuple[int, int]]], tuple[bool, str | None]]


def _rows(docs: DataFrame, benchmark: DataFrame, n: int, judge: Judge) -> DataFrame:
    """``docs`` through ``judge``: from a row's text and the spans of all blocks in it, whether it stays, and its text."""
    common.small_batches(docs.sparkSession)
    blocks, at = _blocks(benchmark, n), docs.columns.index("text")
    first, second = next(blocks), next(blocks, None)

    def judged(columns: list[pa.Array], schema: pa.Schema, spans: Iterable[list[tuple[int, int]]]) -> pa.RecordBatch:
        rows = [judge(t, s) for t, s in zip(columns[at].to_pylist(), spans, strict=True)]
        columns[at] = pa.array([t for _, t in rows], schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array([k for k, _ in rows], pa.bool_()))

    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = common.as_bytes(b.column(at))
                yield judged(b.columns, b.schema, [shared.value.scan(words_of(t))[0] for t in texts])

        return docs.mapInArrow(keep, docs.schema)

    keyed = common.stored(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "keyed")
    plain, parts = keyed.select("_row", F.col("_doc.text").alias("text")), []
    for windows in chain([first, second], blocks):  # stored block by block, so the driver drops a block before the next
        parts.append(common.stored(_scan(plain, windows, ["_row"]).where("size(spans) > 0").select("_row", "spans"), "spans"))
    found = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def keep_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = (x or [] for x in b.column(1).to_pylist())
            yield judged(b.column(0).flatten(), pa.schema(list(b.schema.field(0).type)), [[*zip(x[::2], x[1::2], strict=True)] for x in flat])

    return keyed.join(found, "_row", "left").select("_doc", "spans").mapInArrow(keep_joined, docs.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` without the documents of which a twentieth or more of the words are hit; other rows as they are."""

    def judge(text: str | None, spans: list[tuple[int, int]]) -> tuple[bool, str | None]:
        if not spans:
            return True, text
        n_words = len(words_of((text or "").encode()))
        return 20 * int(_covered(spans, n_words).sum()) < n_words, text

    return _rows(docs, benchmark, n, judge)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the hit words, and what stands between them, cut out of the texts."""

    def judge(text: str | None, spans: list[tuple[int, int]]) -> tuple[bool, str | None]:
        if not spans:
            return True, text
        raw = (text or "").encode()
        places, kept, at = [m.span() for m in _WORDS.finditer(raw)], [], 0
        for a, b in sorted(spans):
            kept.append(raw[at : max(at, places[a][0])])
            at = max(at, places[b - 1][1])
        return True, b"".join([*kept, raw[at:]]).decode()

    return _rows(docs, benchmark, n, judge)
