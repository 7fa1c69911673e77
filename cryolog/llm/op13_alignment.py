"""Alignment of two tokenizers' tokens over the same bytes, by lockstep vectorised merging.

Both token sequences of a text cover the bytes of a space and the text.  A lane walks both at once: it links the token of A
and the token of B that it stands on, then steps over the one that ends first, or over both where they end together, which
is a cut between groups.  NumPy vectors hold where the lanes of all documents of a batch stand, one step moves them
all, and lanes that are through are taken out.  A document has a lane for every LANE_TOKENS tokens of A, so a very long
text does not walk alone for long.

A pair of ids (of A, of B) counts the documents that hold it linked, over the whole corpus.  Documents are dealt to parts
by a hash; a part hands each pair on once, with its number of documents, and gets back the pair's count and whether that
is the highest of its A id.  So a pair in all documents is a row a part, not a row a document, and nothing is broadcast.

Texts that are null, empty, or that a tokenizer does not give back byte for byte have no tokens.  Repeated rows are documents
of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import _ALPHABET, TextEncoder, _Pieces

LANE_TOKENS, PART_BYTES, CHUNK_BYTES, ENTRIES = 1024, 8 << 20, 2 << 20, 300_000
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
_WORD = re.compile(" +[^ ]*")


class ByteTokens:
    """Tokens of a byte-level vocabulary (JSON file), their ids and bytes; special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.encoder = TextEncoder(path, True)
        self.encoder.tokenizer.encode_special_tokens = True
        self.encoder.plain = True
        self.encoder.pieces.entries = ENTRIES
        known, back = self.encoder.tokenizer.get_vocab(True), {c: b for b, c in _ALPHABET.items()}
        self.token_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(" " + text), "<u4").astype(np.int64)


class PieceTokens:
    """Tokens of a sentence-piece model, which puts a space before a text.

    No piece of such a vocabulary goes on with a space behind another character, so no merge crosses the beginning of a run
    of spaces; a text is encoded run by run with the word behind it, from a bounded cache.  A vocabulary that has such a
    piece encodes whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token_bytes = [bytes.fromhex(m[1]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        space = [self.model.piece_to_id("▁")]  # alone at the end of a text; the model puts none before an empty text
        self.pieces = _Pieces(lambda word: np.asarray(self.model.encode(word[1:]) or space, "<u4").tobytes())
        self.pieces.entries = ENTRIES

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word or "▁" in text:
            return np.asarray(self.model.encode(text), np.int64)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, _WORD.findall(" " + text))), "<u4").astype(np.int64)


@lru_cache(maxsize=4)
def tokens(path: str) -> ByteTokens | PieceTokens:
    """One for a worker process, so that its cache outlives a task."""
    return PieceTokens(path) if path.endswith(".model") else ByteTokens(path)


class Side(NamedTuple):
    """The tokens of one vocabulary for many documents, one after another."""

    ids: np.ndarray
    ends: np.ndarray  # bytes, over all documents
    first: np.ndarray  # of each document and one more


def lockstep(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of all linked tokens, and of the last tokens of all groups, in no order."""
    per_doc = -(-np.diff(a.first) // LANE_TOKENS)
    nth = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    at_a = np.repeat(a.first[:-1], per_doc) + nth * LANE_TOKENS
    stop = np.minimum(at_a + LANE_TOKENS, np.repeat(a.first[1:], per_doc))
    start = np.concatenate([[0], a.ends])[at_a]
    at_b = np.searchsorted(b.ends, start, "right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(at_a):
        links_a.append(at_a)
        links_b.append(at_b)
        end_a, end_b = a.ends[at_a], b.ends[at_b]
        over_a, over_b = end_a <= end_b, end_b <= end_a
        both = over_a & over_b
        cuts_a.append(at_a[both])
        cuts_b.append(at_b[both])
        at_a, at_b = at_a + over_a, at_b + over_b
        going = at_a < stop
        if not going.all():
            at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return joined(links_a), joined(links_b), joined(cuts_a), joined(cuts_b)


class Aligned(NamedTuple):
    """One document: token ids, first tokens of all groups (and one past the end), pairs with their numbers of links."""

    a: np.ndarray
    b: np.ndarray
    groups_a: np.ndarray
    groups_b: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


def align(texts: list[str | None], first: ByteTokens | PieceTokens, second: ByteTokens | PieceTokens) -> list[Aligned]:
    """The alignment of each text; a pair is the A id times 2**32 and the B id."""
    sides: list[tuple[list[np.ndarray], np.ndarray]] = []
    encoded: list[list[np.ndarray]] = [[], []]
    for text in texts:
        found = [x.encode(text) for x in (first, second)] if text else []
        want = (" " + text).encode() if text else b""
        whole = text and all(b"".join(map(x.token_bytes.__getitem__, ids.tolist())) == want for x, ids in zip((first, second), found, strict=True))
        for out, ids in zip(encoded, found if whole else [np.zeros(0, np.int64)] * 2, strict=True):
            out.append(ids)
    for x, docs in zip((first, second), encoded, strict=True):
        ids = np.concatenate([*docs, np.zeros(0, np.int64)])
        sides.append(Side(ids, np.cumsum(_lengths(x)[ids]), np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)))
    a, b = sides
    links_a, links_b, cuts_a, cuts_b = lockstep(a, b)
    order = np.argsort(cuts_a)
    cuts_a, cuts_b = cuts_a[order] + 1, cuts_b[order] + 1
    doc = np.searchsorted(a.first, links_a, "right") - 1  # in a stretch without tokens the last of equal places counts
    high, low = int(a.ids.max(initial=0)).bit_length(), int(b.ids.max(initial=0)).bit_length()
    key = np.sort(doc << (high + low) | a.ids[links_a] << low | b.ids[links_b])
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    links, key = np.diff(np.concatenate([at, [len(key)]])), key[at]
    pairs = (key >> low & (1 << high) - 1) << 32 | key & (1 << low) - 1
    docs = range(len(texts) + 1)
    of_pairs, of_cuts = np.searchsorted(key >> (high + low), docs), np.searchsorted(cuts_a, a.first, "right")
    out = []
    for d in docs[:-1]:
        (a0, a1), (b0, b1), (c0, c1), (p0, p1) = (x[d : d + 2] for x in (a.first, b.first, of_cuts, of_pairs))
        out.append(Aligned(a.ids[a0:a1], b.ids[b0:b1], np.concatenate([[0], cuts_a[c0:c1] - a0]), np.concatenate([[0], cuts_b[c0:c1] - b0]), pairs[p0:p1], links[p0:p1].astype(np.int32)))
    return out


@lru_cache(maxsize=4)
def _lengths(x: ByteTokens | PieceTokens) -> np.ndarray:
    return np.fromiter(map(len, x.token_bytes), np.int64, len(x.token_bytes))


@lru_cache(maxsize=8)
def _written(n: int, mark: str) -> np.ndarray:
    return np.array([f"{i}{mark}" for i in range(n)], object)


def groups_text(x: Aligned, n_a: int, n_b: int) -> str:
    """The groups in order as ``a1,a2|b1;a3|b2,b3``, for vocabularies of ``n_a`` and ``n_b`` ids."""
    if not len(x.a):
        return ""
    size_a, size_b = np.diff(x.groups_a), np.diff(x.groups_b)
    out = np.empty(len(x.a) + len(x.b), object)
    at_a = np.arange(len(x.a)) + np.repeat(x.groups_b[:-1], size_a)
    at_b = np.arange(len(x.b)) + np.repeat(x.groups_a[1:], size_b)
    out[at_a], out[at_b] = _written(n_a, ",")[x.a], _written(n_b, ",")[x.b]
    last_a, last_b = x.groups_a[1:] - 1, x.groups_b[1:] - 1
    out[at_a[last_a]], out[at_b[last_b]] = _written(n_a, "|")[x.a[last_a]], _written(n_b, ";")[x.b[last_b]]
    return "".join(out.tolist())[:-1]


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of some CHUNK_BYTES together, which bounds what is aligned at a time."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


_INT, _INTS = pa.int64(), pa.list_(pa.int64())
_ALIGNED = pa.schema([("part", pa.int32()), ("doc_id", _INT), ("n_a", _INT), ("n_b", _INT), ("n_groups", _INT), ("n_links", _INT), ("groups_sha256", pa.string()), ("pairs", _INTS), ("links", pa.list_(pa.int32()))])
_GROUPS = pa.schema([("doc_id", _INT), ("a", _INTS), ("b", _INTS), ("groups_a", _INTS), ("groups_b", _INTS)])
_REPORT = pa.schema([(n, _INT) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def _columns(schema: pa.Schema) -> str:
    names = {_INT: "long", _INTS: "array<long>", pa.int32(): "int", pa.list_(pa.int32()): "array<int>", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, the token ids a and b, and the places groups_a and groups_b where groups begin in them (and the ends), of every
    row of ``docs`` (doc_id, text)."""
    common.small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for part in _chunks(texts):
                found = align(texts[part], tokens(a_path), tokens(b_path))
                yield common.batch(_GROUPS, [ids[part], *([x[k] for x in found] for k in range(4))])

    return docs.select("doc_id", "text").mapInArrow(scan, _columns(_GROUPS))


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    parts = common.parts_for(docs, PART_BYTES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokens(a_path), tokens(b_path)
        for batch in batches:
            part, ids, texts = (c.to_pylist() for c in batch.columns)
            for run in _chunks(texts):
                rows = []
                for p, i, x in zip(part[run], ids[run], align(texts[run], first, second), strict=True):
                    said = groups_text(x, len(first.token_bytes), len(second.token_bytes))
                    digest = hashlib.sha256(said.encode()).hexdigest() if said else ""
                    rows.append((p, i, len(x.a), len(x.b), len(x.groups_a) - 1, int(x.links.sum()), digest, x.pairs, x.links))
                yield common.batch(_ALIGNED, zip(*rows, strict=True))

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")
    return common.stored(docs.select(part, "doc_id", "text").mapInArrow(scan, _columns(_ALIGNED)), "aligned")


def _counted(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of (part, pair), and for each pair its count and whether it is the highest of its A id; both stored."""
    held = common.stored(aligned.select("part", F.explode("pairs").alias("pair")).groupBy("part", "pair").agg(F.count("*").alias("n")), "held")
    counts = held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32))
    highest = Window.partitionBy("a")  # at most a row for each id of B
    return held, common.stored(counts.withColumn("best", F.col("count") == F.max("count").over(highest)).select("pair", "count", "best"), "counts")


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each pair of linked ids: a, b, count (documents that hold it) and best (no pair of this ``a`` has more)."""
    _, counts = _counted(_aligned(docs, a_path, b_path))
    return counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "count", "best")


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text)."""
    aligned = _aligned(docs, a_path, b_path)
    held, counts = _counted(aligned)
    known = held.select("part", "pair").join(counts, "pair")

    def look_up(mine: pa.Table, table: pa.Table) -> Iterator[pa.RecordBatch]:
        pair, count, best = (table.column(k).to_numpy().astype(np.int64) for k in range(3))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order]
        for b in mine.to_batches():
            pairs, links = b.column(6), b.column(7)
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            n = links.flatten().to_numpy().astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[edges])
            yield common.batch(_REPORT, [*b.columns[:5], total(n * best[at]), total(n * count[at]), b.column(5)])

    def scan(mine: pa.Table, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(look_up(mine, table), _REPORT)

    columns = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links", "part")
    return columns.groupBy("part").cogroup(known.select("pair", "count", "best", "part").groupBy("part")).applyInArrow(scan, _columns(_REPORT))
