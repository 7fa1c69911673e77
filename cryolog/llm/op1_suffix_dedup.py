"""Exact substring dedup by enhanced suffix arrays over anchored suffixes.

A string of ``length`` bytes that starts at two places holds the same anchor at both: the leftmost of the smallest
hashes among its ``gram``-byte grams (winnowing), so whether a position is an anchor depends on nothing outside a
string, and each string has one anchor.  Grams that occur once in all documents drop out after a count.  Around the
rest, an occurrence keeps at most ``length - gram`` bytes to either side; equal surroundings are one context.

The contexts of one gram are a suffix array: sorted by what follows the anchor, with the common prefixes of neighbours.
A stack scan visits its interval tree from the longest common prefixes down.  In an interval, the members' left sides
are sorted, and a second stack scan over them finds where they part: members that share a left side which no byte
extends for all of them (left-diverse), and that do not all lie in one interval inside (right-diverse), are the
occurrences of a maximal repeat.  These groups, of all members and not of neighbours, say which bytes are repeated.

A gram of more than MOST anchors has its strings counted one by one instead, by hash and in chunks, so that no task
holds all of its contexts; the outcome is the same.  Grams of more anchors than that are at most 2**20 by the share of
all anchors that makes them so, which bounds their broadcast.

Null texts are empty.  Repeated rows count as documents of their own.  Texts shorter than ``length`` are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .op5_jaccard import mixed

LENGTH, GRAM, PASSAGE = 400, 200, 280
MOST, MOST_GRAMS, CHUNK, FILTER_BITS = 50_000, 1 << 20, 2000, 1 << 27
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of the base and of its inverse, as far as texts have needed them."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << n.bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position."""
    up, down = _Powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[1:], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


class WindowMinima:
    """For each window of some values, the position of its leftmost smallest one; a wider window goes on from a narrower one."""

    def __init__(self, h: np.ndarray):
        self.best, self.at, self.span = h, np.arange(len(h), dtype=np.int32), 1  # texts are below 2 GB

    def of(self, width: int) -> np.ndarray:
        while self.span < width:  # minima over `span` values from each position; two of them make a window twice as long
            step = min(self.span, width - self.span)
            left, right = self.best[: len(self.best) - step], self.best[step:]
            keep = left <= right
            self.best, self.at = np.minimum(left, right), np.where(keep, self.at[: len(self.at) - step], self.at[step:])
            self.span += step
        return self.at


def anchors(text: bytes, length: int, gram: int, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of strings of ``dense`` bytes, ascending, their gram hashes, and which of them are anchors
    of strings of ``length`` bytes too."""
    if len(text) < dense:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    distinct = lambda at: at[np.concatenate([[True], at[1:] != at[:-1]])]
    minima = WindowMinima(h)
    where = distinct(minima.of(dense - gram + 1))
    main = np.zeros(len(h), bool)
    if len(text) >= length:
        main[where if dense == length else minima.of(length - gram + 1)] = True
    return where, h[where].view(np.int64), main[where]


def _common_prefix(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The nodes of the interval tree of an array with these common prefixes of neighbours: (prefix, first, last), each
    before the one that holds it, for prefixes of ``least`` or more."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            yield depth, first, i
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))


class Contexts:
    """The distinct contexts of one gram: left sides reversed, right sides from the anchor on, numbers of occurrences."""

    def __init__(self, lefts: list[bytes], rights: list[bytes], counts: list[int]):
        self.order = sorted(range(len(rights)), key=rights.__getitem__)
        self.lefts = [lefts[i] for i in self.order]
        self.rights = [rights[i] for i in self.order]
        self.counts = [counts[i] for i in self.order]
        self.lcp = [_common_prefix(a, b) for a, b in zip(self.rights, self.rights[1:])]

    def maximal_repeats(self, length: int) -> Iterator[tuple[int, int, list[int]]]:
        """(bytes before the anchor, bytes from it on, contexts) of each maximal repeat of ``length`` bytes or more
        within the contexts' reach; a context that occurs more than once is one by itself."""
        for i, n in enumerate(self.counts):
            if n > 1 and len(self.lefts[i]) + len(self.rights[i]) >= length:
                yield len(self.lefts[i]), len(self.rights[i]), [self.order[i]]
        longest = max(map(len, self.lefts), default=0)
        inside = list(range(len(self.lefts)))  # of each member, the largest interval seen so far that holds it
        for node, (right, first, last) in enumerate(intervals(self.lcp, max(1, length - longest)), len(inside)):
            members = sorted(range(first, last + 1), key=self.lefts.__getitem__)
            shared = [_common_prefix(self.lefts[a], self.lefts[b]) for a, b in zip(members, members[1:])]
            for left, low, high in intervals(shared, max(0, length - right)):  # left sides part here: left-diverse
                if len({inside[m] for m in members[low : high + 1]}) > 1:  # and they go on differently to the right
                    yield left, right, [self.order[m] for m in members[low : high + 1]]
            inside[first : last + 1] = [node] * len(members)

    def repeated(self, length: int) -> list[list[tuple[int, int]]]:
        """For each context, ranges around the anchor that maximal repeats of ``length`` bytes or more cover."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.rights]
        for left, right, members in self.maximal_repeats(length):
            for m in members:
                out[m].append((left, right))
        return [_frontier(x) for x in out]


def _frontier(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that no other one covers."""
    out: list[tuple[int, int]] = []
    for left, right in sorted(pairs, reverse=True):
        if not out or right > out[-1][1]:
            out.append((left, right))
    return out


_FOUND = pa.schema([("gram", pa.int64()), ("main", pa.bool_())])
_ANCHOR = pa.struct([("at", pa.int32()), ("gram", pa.int64()), ("main", pa.bool_())])
_SCANNED = pa.schema([("doc_id", pa.int64()), ("_id", pa.int64()), ("_row", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.binary()), ("sha256", pa.string()), ("anchors", pa.list_(_ANCHOR))])
_USES = pa.schema([("_id", pa.int64()), ("_row", pa.int64()), ("at", pa.int32()), ("chunk", pa.int64()), ("context", pa.binary()), ("gram", pa.int64()), ("many", pa.bool_()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.int64())])
_RANGES = pa.schema([("context", pa.binary()), ("ranges", pa.list_(pa.int32()))])
_STRINGS = pa.schema([("string", pa.binary()), ("context", pa.binary()), ("left", pa.int32()), ("n", pa.int64())])


def _anchors(keyed: DataFrame, length: int, gram: int, dense: int) -> DataFrame:
    """The anchors of strings of ``dense`` bytes; main are those of strings of ``length`` bytes, which are among them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(text, length, gram, dense) for text in common.as_bytes(b.column(0))]
            if found:
                yield common.batch(_FOUND, [np.concatenate([x[1] for x in found]).astype(np.int64), np.concatenate([x[2] for x in found]).astype(bool)])

    return keyed.select("text").mapInArrow(scan, "gram long, main boolean")


_SHIFTS = (0, 18, 37)


def _filter(often: DataFrame) -> np.ndarray:
    """A Bloom filter of the repeated grams of FILTER_BITS bits: 16 MB, whatever the input.  Where it fills up, it leaves less
    out, and the join behind it does the rest."""
    bits = F.array(*(F.shiftrightunsigned("gram", k).bitwiseAND(FILTER_BITS - 1) for k in _SHIFTS))
    words = often.select(F.explode(bits).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def _may_be_in(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for k in _SHIFTS:
        bit = h.view(np.uint64) >> np.uint64(k) & np.uint64(FILTER_BITS - 1)
        found &= (bloom[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) > 0
    return found


def _scanned(docs: DataFrame, length: int, gram: int, dense: int, often: Broadcast) -> DataFrame:
    """Every row of ``docs`` with the anchors that may be repeated and, if it has any, its text; else with its digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, key, row, text in zip(*(c.to_pylist() for c in b.columns[:3]), common.as_bytes(b.column(3)), strict=True):
                where, h, main = anchors(text, length, gram, dense)
                at = np.flatnonzero(_may_be_in(often.value, h))
                found = [{"at": int(where[k]), "gram": int(h[k]), "main": bool(main[k])} for k in at]
                rows.append((i, key, row, len(text), *((text, None) if found else (None, hashlib.sha256(text).hexdigest())), found))
            if rows:
                yield common.batch(_SCANNED, zip(*rows, strict=True))

    kept = docs.select("doc_id", *common.row_key(), "text").mapInArrow(scan, "doc_id long, _id long, _row long, n_bytes long, text binary, sha256 string, anchors array<struct<at:int,gram:long,main:boolean>>")
    return common.stored(kept, "scanned")


def _sides(text: bytes, at: int, length: int, gram: int) -> tuple[bytes, bytes]:
    return text[max(0, at - length + gram) : at][::-1], text[at : at + length]


def _context(left: bytes, right: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"%d:" % len(left) + left + right)


def _uses(marked: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each repeated anchor; the first of a context in an Arrow batch (a chunk) has its bytes and how many there
    are.  One row more for each text, without a context, has how many of its anchors are repeated."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            rows, first = [], {}
            for i, r, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                rows.append((i, r, None, None, None, None, None, None, None, len(marks)))
                for m in marks:
                    if m["main"]:
                        left, right = _sides(text, m["at"], length, gram)
                        c = _context(left, right)
                        if c in first:
                            first[c][9] += 1
                            rows.append((i, r, m["at"], chunk, c, m["gram"], m["many"], None, None, None))
                        else:
                            rows.append(row := [i, r, m["at"], chunk, c, m["gram"], m["many"], left, right, 1])
                            first[c] = row
            chunk += 1
            if rows:
                yield common.batch(_USES, zip(*rows, strict=True))

    return marked.mapInArrow(scan, "_id long, _row long, at int, chunk long, context binary, gram long, many boolean, left binary, right binary, n long")


def _by_gram(contexts: DataFrame) -> DataFrame:
    return contexts.select("gram", "context", "left", "right", "n").repartition("gram").sortWithinPartitions("gram", "context")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], Contexts]]:
    """Gram, contexts and their tree, from rows in order of gram and context."""
    gram, rows = None, []

    def done() -> tuple[int, list[bytes], Contexts]:
        return gram, [r[1] for r in rows], Contexts(*([r[k] for r in rows] for k in (2, 3, 4)))

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and row[0] != gram:
                yield done()
                rows = []
            gram = row[0]
            if rows and rows[-1][1] == row[1]:  # the same context from another chunk
                rows[-1] = (*row[:4], rows[-1][4] + row[4])
            else:
                rows.append(row)
    if rows:
        yield done()


def _ranges(contexts: DataFrame, length: int) -> DataFrame:
    """For each context the ranges that repeat, as pairs of bytes before and from the anchor; by trees."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, tree in _trees(batches):
            found = [(c, [x for pair in ranges for x in pair]) for c, ranges in zip(names, tree.repeated(length), strict=True) if ranges]
            if found:
                yield common.batch(_RANGES, zip(*found, strict=True))

    return _by_gram(contexts).mapInArrow(scan, "context binary, ranges array<int>")


def _counted(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated strings of ``length`` bytes, for grams of very many contexts: string (its hash), context, left (bytes before
    the anchor).  They are counted within a chunk of contexts and then over the chunks, of which each hands on a string once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            seen: dict[bytes, list] = {}
            for gram_, context, left, right, n in rows:
                text = left[::-1] + right
                for start in range(max(0, len(left) - length + gram), min(len(left), len(text) - length) + 1):
                    # with the gram and its place, as one string may lie around several anchors
                    string = xxhash.xxh3_128_digest(b"%d %d " % (gram_, len(left) - start) + text[start : start + length])
                    seen.setdefault(string, []).append((context, len(left) - start, n))
            out: list[tuple] = []
            for string, places in seen.items():
                if len(places) > 1 or places[0][2] > 1:  # known to be repeated; for the other chunks it counts as two
                    out += [(string, c, left, 0) for c, left, _ in places]
                    out.append((string, None, None, 2))
                else:
                    out.append((string, *places[0]))
            return common.batch(_STRINGS, zip(*out, strict=True) if out else ([], [], [], []))

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[-1][1] == row[1]:
                    rows[-1] = (*row[:4], rows[-1][4] + row[4])
                    continue
                if len(rows) == CHUNK:
                    yield done(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield done(rows)

    dealt = contexts.select("gram", "context", "left", "right", "n").repartition("gram", F.pmod(F.hash("context"), F.lit(MOST))).sortWithinPartitions("gram", "context")
    strings = common.stored(dealt.mapInArrow(scan, "string binary, context binary, left int, n long"), "strings")
    place = F.when(F.col("context").isNotNull(), F.struct("context", "left"))
    over = strings.where("n > 0").groupBy("string").agg(F.sum("n").alias("n"), F.collect_set(place).alias("places")).where("n > 1")
    return strings.where("n = 0").select("string", "context", "left").unionByName(over.select("string", F.inline("places")))


def _counted_ranges(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    pairs = F.transform(F.array_sort(F.collect_set("left")), lambda x: F.array(x, F.lit(length) - x))
    return _counted(contexts, length, gram).groupBy("context").agg(F.flatten(pairs).alias("ranges"))


def _contexts(docs: DataFrame, length: int, gram: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs``, see ``_scanned``, and the uses of all repeated anchors, see ``_uses``; both stored."""
    counted = _anchors(docs, length, gram, dense).groupBy("gram").agg(F.count("*").alias("count"), F.count_if("main").alias("mains"))
    often = common.stored(counted.where("count > 1"), "often")
    scanned = _scanned(docs, length, gram, dense, docs.sparkSession.sparkContext.broadcast(_filter(often)))
    most = max(MOST, (often.agg(F.sum("count")).first()[0] or 0) // MOST_GRAMS)
    salts = F.ceil(F.col("count") / most)
    many = often.where(F.col("count") > most).select("gram", salts.alias("salts"))  # fewer than MOST_GRAMS
    salt = F.coalesce(F.pmod(F.xxhash64("_row", "at"), "salts"), F.lit(0).cast("long")).alias("salt")
    found = scanned.where("text IS NOT NULL").select("_id", "_row", F.inline("anchors"))
    places = found.join(F.broadcast(many), "gram", "left").select("gram", "_id", "_row", "at", "main", salt)
    kept = often.select("gram", (F.col("mains") > 1).alias("compared"), (F.col("mains") > most).alias("many"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    mark = F.struct("at", "gram", (F.col("main") & F.col("compared")).alias("main"), "many")
    marks = places.join(kept, ["gram", "salt"]).groupBy("_id", "_row").agg(F.collect_set(mark).alias("marks"))
    texts = scanned.where("text IS NOT NULL").select("_id", "_row", "text")
    return scanned, common.stored(_uses(texts.join(marks, ["_id", "_row"]), length, gram), "uses")


def _pieces(docs: DataFrame, length: int, gram: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and _id, _row, pieces (repeated ranges around anchors) and n_anchors (repeated ones) of those that
    have any."""
    scanned, uses = _contexts(docs, length, gram, dense)
    first = uses.where("context IS NOT NULL AND n IS NOT NULL")
    ranges = common.stored(_ranges(first.where("NOT many"), length).unionByName(_counted_ranges(first.where("many"), length, gram)), "ranges")
    # a context in very many texts meets its ranges once in a chunk, and the chunk's other texts there
    led = first.select("context", "chunk").join(ranges, "context")
    pieces = uses.join(led, ["context", "chunk"]).select("_id", "_row", F.struct("at", "ranges").alias("piece"), F.lit(None).cast("long").alias("n"))
    whole = uses.where("context IS NULL").select("_id", "_row", F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece"), "n")
    return scanned, pieces.unionByName(whole).groupBy("_id", "_row").agg(F.collect_set("piece").alias("pieces"), F.max("n").alias("n_anchors"))


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The maximal repeats of ``length`` bytes or more with all their occurrences, a row for each: repeat (a number),
    n_bytes, doc_id and start (in bytes).

    A repeat is maximal within the reach of its anchor, ``length - gram`` bytes before and ``length`` bytes from it on;
    a longer one comes as a chain of such groups, one for each of its anchors.  Around a gram of more than MOST anchors
    they are the repeated strings of just ``length`` bytes.
    """
    common.small_batches(docs.sparkSession)
    _, uses = _contexts(docs, length, gram, length)
    schema = pa.schema([("repeat", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("context", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram_, names, tree in _trees(batches):
            rows = [(xxhash.xxh3_64_intdigest(f"{gram_}:{k}") >> 1, left, right, names[m]) for k, (left, right, members) in enumerate(tree.maximal_repeats(length)) for m in members]
            if rows:
                yield common.batch(schema, zip(*rows, strict=True))

    first = uses.where("context IS NOT NULL AND n IS NOT NULL")
    groups = _by_gram(first.where("NOT many")).mapInArrow(scan, "repeat long, left int, right int, context binary")
    strings = _counted(first.where("many"), length, gram).select(F.xxhash64("string").alias("repeat"), "left", (F.lit(length) - F.col("left")).alias("right"), "context")
    placed = groups.unionByName(strings).join(uses.select("_id", "_row", "at", "context"), "context").distinct()
    named = placed.join(docs.select("doc_id", *common.row_key()), ["_id", "_row"])
    return named.select("repeat", (F.col("left") + F.col("right")).alias("n_bytes"), "doc_id", (F.col("at") - F.col("left")).alias("start"))


def merged_spans(pieces: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs, from pieces around anchors."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((p["at"] - left, p["at"] + right) for p in pieces or () for left, right in zip(p["ranges"][::2], p["ranges"][1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_shared_anchors", pa.int64())])


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shared_anchors of every row of ``docs`` (doc_id, text).

    The last counts anchors whose ``gram`` bytes start elsewhere too, where anchors lie so close that every repeat of
    ``passage`` bytes or more has one: a text with none of them shares no such passage with any other.
    """
    common.small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, pieces, n in zip(b.column(0).to_pylist(), common.as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                spans = merged_spans(pieces)
                rows.append((i, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(text, spans)).hexdigest(), n or 0))
            if rows:
                yield common.batch(_REPORT, zip(*rows, strict=True))

    scanned, pieces = _pieces(docs, length, gram, min(length, passage))
    texts = scanned.where("text IS NOT NULL").select("doc_id", "_id", "_row", "text").join(pieces, ["_id", "_row"], "left")
    judged = texts.select("doc_id", "text", "pieces", "n_anchors").mapInArrow(scan, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_anchors long")
    none = F.lit(0).cast("long")
    whole = scanned.where("text IS NULL").select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha256").alias("kept_sha256"), none.alias("n_shared_anchors"))
    return judged.unionByName(whole)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; characters that a cut has split go too, and null stays null.

    Columns other than text are kept as they are, but for n_chars, which follows the text where there is one.
    """
    common.small_batches(docs.sparkSession)
    spans = _pieces(docs, length, gram, length)[1].where("size(pieces) > 0")
    whole = common.keyed(docs).join(spans, ["_id", "_row"], "left")
    names = docs.columns
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0)
            columns, texts = doc.flatten(), []
            for text, pieces in zip(columns[at].to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.append(cut(text.encode(), merged_spans(pieces)).decode(errors="ignore") if pieces else text)
            if counted is not None:
                new = [n if p is None else len(t) for n, t, p in zip(columns[counted].to_pylist(), texts, b.column(1).to_pylist(), strict=True)]
                columns[counted] = pa.array(new, columns[counted].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return whole.select("_doc", "pieces").mapInArrow(scan, docs.schema)
