"""Token-id shards as sorted string tables.

A shard holds documents in ascending key order: blocks of prefix-compressed keys with their token ids, then a sparse
index (first key and place of each block), a Bloom filter over the keys, and a footer that says where these lie.
``Shard.get`` reads footer, filter and index once and then one block for a key, found by binary search.

Order and ties: null ids come first, then ascending ids; rows that share an id are ordered by text and all stored.
A null text is empty and gets the end id only.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAGIC = b"CRYSST01"
FOOTER = struct.Struct("<QQQQQQI8s")  # index at, index bytes, filter at, filter bytes, documents, ids, crc32 of these, magic
BLOCK_IDS, SHARD_IDS, BITS_PER_KEY, HASHES = 1 << 16, 1 << 24, 10, 7
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, nulls first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, seed=1) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class ShardWriter:
    def __init__(self, sink, width: int):
        self.sink, self.width, self.zip = sink, width, zstandard.ZstdCompressor(level=1)
        self.at, self.n_docs, self.n_ids, self.index, self.keys = 0, 0, 0, [], []
        self._open()

    def _open(self) -> None:
        self.heads, self.ids, self.in_block, self.docs_in_block, self.last, self.first = [], [], 0, 0, b"", None

    def _put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first = key
        same = next((i for i, (a, b) in enumerate(zip(self.last, key)) if a != b), min(len(self.last), len(key)))
        self.heads.append(struct.pack("<BBI", same, len(key) - same, len(ids)) + key[same:])
        self.ids.append(ids.astype(f"<u{self.width}").tobytes())
        self.last = key
        self.keys.append(key)
        self.in_block += len(ids)
        self.docs_in_block += 1
        if self.in_block >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        if self.first is None:
            return
        head = b"".join(self.heads)
        body = self.zip.compress(struct.pack("<BII", self.width, self.docs_in_block, len(head)) + head + b"".join(self.ids))
        at, length = self._put(body)
        self.index.append(struct.pack("<BQIQ", len(self.first), at, length, self.n_ids) + self.first)
        self.n_docs += self.docs_in_block
        self.n_ids += self.in_block
        self._open()

    def close(self) -> None:
        self.flush()
        index = self._put(self.zip.compress(b"".join(self.index)))
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self._put(struct.pack("<Q", bits) + bytes(bloom))
        fields = (*index, *bloom_at, self.n_docs, self.n_ids)
        self._put(FOOTER.pack(*fields, zlib.crc32(repr(fields).encode()), MAGIC))
        self.sink.close()


class Shard:
    """A written shard, read by place."""

    def __init__(self, source):
        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        *fields, crc, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or crc != zlib.crc32(repr(tuple(fields)).encode()):
            raise ValueError("not a whole shard")
        index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_ids = fields
        raw, self.firsts, self.places, i = self.unzip.decompress(self._at(index_at, index_len)) if self.n_docs else b"", [], [], 0
        while i < len(raw):
            k, at, length, before = struct.unpack_from("<BQIQ", raw, i)
            i += 21 + k
            self.firsts.append(raw[i - k : i])
            self.places.append((at, length, before))
        bloom = self._at(bloom_at, bloom_len)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _at(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        raw = self.unzip.decompress(self._at(*self.places[i][:2]))
        width, docs, head = struct.unpack_from("<BII", raw)
        ids, at, key, n = np.frombuffer(raw, f"<u{width}", offset=9 + head), 9, b"", 0
        for _ in range(docs):
            same, more, length = struct.unpack_from("<BBI", raw, at)
            at += 6 + more
            key = key[:same] + raw[at - more : at]
            yield key, ids[n : n + length]
            n += length

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document with this key."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        i, found = max(0, bisect_right(self.firsts, key) - 1), []
        while i > 0 and self.firsts[i] == key:  # ties may have begun in an earlier block
            i -= 1
        while i < len(self.places) and self.firsts[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


def open_shard(path: str) -> Shard:
    system, place = fs.FileSystem.from_uri(path)
    return Shard(system.open_input_file(place))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, spaces: bool = True) -> DataFrame:
    """Writes ``docs`` (doc_id, text) and returns the manifest, a row for each shard in key order.

    An attempt writes under a name of its own and the manifest names only what successful tasks wrote, so a lost
    executor costs its tasks and nothing else.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    folder = folder or f"{common.shared_dir(spark)}/shards-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        coder, end = encoder(tokenizer, spaces), np.array([end_id], "<u4")
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, shard, rows = TaskContext.get().partitionId(), None, []

        def done() -> None:
            shard.close()
            rows.append((part, len(rows), shard.path, shard.n_docs, shard.n_ids))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard is None:
                    name = f"{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.sst"
                    shard = ShardWriter(system.open_output_stream(f"{root}/{name}"), width)
                    shard.path = f"{folder}/{name}"
                shard.add(key_of(doc_id), np.concatenate([np.frombuffer(coder.encode(text or ""), "<u4"), end]))
                if shard.n_ids + shard.in_block >= SHARD_IDS:
                    done()
                    shard = None
        if shard is not None:
            done()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "path", "n_docs", "n_ids"), r, strict=True)) for r in rows], _MANIFEST)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.stored(ordered.mapInArrow(write, MANIFEST), "manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row for each stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    places = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("start"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard, rows = open_shard(path), []
                for key, ids in shard:
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield common.batch(_READ, zip(*rows, strict=True))
                        rows = []
                if rows:
                    yield common.batch(_READ, zip(*rows, strict=True))

    # a task for each shard; the manifest has a row for 16 million ids
    return places.repartition(max(1, manifest.count())).mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")
