"""Exact Jaccard self-join of word-shingle sets, and the components of its links: a size-aware heavy-light join.

Sets are 64-bit hashes of ``k``-word shingles.  Equal sets are one class from the start, so copies never meet in pairs.

* Light: both sets have at most B shingles.  A pair of sizes n <= m that links shares o(n, m) shingles, so each set
  enumerates its subsets of that size, all within B, and equal subsets meet.
* Heavy: the larger set has more than B.  A size band fixes how many shingles H two linked sets can differ in; the hash
  range is cut into more than H parts, so that both sets fill some part alike, and the inverted list of a part's
  content holds every set that fills it so.  A list keyed by a part of several shingles stays short where a single
  common shingle would gather half the corpus.  There are so many parts that those of fewer than a band's least number
  of shingles can be left out; a set with too many such parts lists them too, for others of its kind.
* B is where enumerating a set's subsets would begin to cost more than its lists and their checks.

In a list, two sets stay candidates if histograms of their shingles over SKETCH ranges differ by no more than linked
sets can.  Larger sets have more ranges, as two that share nothing differ by no more than that where a range holds many.  Such members are tied as stars, never as all pairs; components of these ties hold all candidates.  Each
component then gets its whole sets and an exact check: a member is compared with a member of each class group
found so far, and fully scanned only where that does not decide, so a dense group costs a line, not a square.

Null texts and texts without words have an empty set, no link and themselves as component.  Rows that share a doc_id
are told apart by their text.  Null ids take part and, as smallest id of a component, count as none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, exp, factorial, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD_ENTRIES, _BAND, SKETCH = 400_000, 1.3, 128


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _WORD_ENTRIES:
            self[word] = h
        return h


_HASHES = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that leaves no pattern of the input."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence if there are fewer words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        acc = mixed(acc + h[j : len(h) - size + 1 + j])
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


class Rule:
    """Link if 100 * intersection >= percent * union; what follows from it for sizes n <= m."""

    def __init__(self, percent: int):
        self.percent = percent
        self.light = 0
        while self.light < 64 and self._subsets(self.light + 1) <= self._lists(self.light + 1):
            self.light += 1
        self.bands = [max(1, -(-percent * (self.light + 1) // 100))]
        # sets of n shingles that share none differ by about 2 n / sqrt(pi x) at x in a range, linked ones by this share of n at most
        self.in_range = min(8.0, 4 / pi / (2 * (100 - percent) / (100 + percent)) ** 2 / 3) if percent < 100 else 8.0

    def overlap(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def largest(self, n: int) -> int:
        return n * 100 // self.percent

    def smallest(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def ranges(self, n: int) -> int:
        """How many hash ranges a histogram of ``n`` shingles has."""
        return max(SKETCH, 1 << ceil(log2(max(1, n) / self.in_range))) if self.in_range < n else SKETCH

    def _subsets(self, n: int) -> int:
        return sum(comb(n, self.overlap(n, m)) for m in range(self.smallest(n), self.largest(n) + 1) if self.overlap(n, m) <= min(n, m))

    def _lists(self, n: int) -> int:
        """Rows in lists, and the shingles of a set that a check reads, at a row for two."""
        return 2 * (n + self.largest(n) - 2 * self.overlap(n, self.largest(n)) + 1) + n // 2

    def band(self, n: int) -> int:
        """Index of the band in which ``n`` as the smaller size lies; -1 below all."""
        while self.bands[-1] <= n:
            self.bands.append(max(self.bands[-1] + 1, int(self.bands[-1] * _BAND)))
        return int(np.searchsorted(self.bands, n, "right")) - 1

    @lru_cache(maxsize=None)
    def parts(self, band: int) -> tuple[int, int, int]:
        """Number of parts, least shingles of a part that is listed, and how many smaller parts a set may leave out."""
        low, top = self.bands[band], self.bands[band + 1] - 1
        differ = (top + self.largest(top)) * (100 - self.percent) // (100 + self.percent)
        for least in (3, 2, 1):
            for k in range(differ + 1, differ + 3 + differ * (4 - least) // 8):
                x = low / k
                small = exp(-x) * sum(x**i / factorial(i) for i in range(least))
                if k * small + 2 * sqrt(k * small) <= k - differ - 1:
                    return k, least, k - differ - 1
        return differ + 1, 1, 0

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n, out = len(s), []
        values = mixed(s)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        if n <= self.light:
            for m in range(self.smallest(n), min(self.light, self.largest(n)) + 1):
                o = self.overlap(n, m)
                if o > min(n, m) or (n == m == o):
                    continue
                key = np.uint64(min(n, m) << 40 | max(n, m) << 20 | o)
                gone = np.array([np.sum(values[list(c)], dtype=np.uint64) for c in combinations(range(n), n - o)], np.uint64)
                out.append(mixed(mixed(total[-1] - gone) + key))
        if self.largest(n) > self.light and n >= self.bands[0]:
            for band in range(max(0, self.band(self.smallest(n))), self.band(n) + 1):
                k, least, spare = self.parts(band)
                edges = np.array([(j << 64) // k for j in range(1, k)], np.uint64)
                cut = np.concatenate([[0], np.searchsorted(s, edges), [n]])
                filled = np.diff(cut)
                tag = (np.arange(k, dtype=np.uint64) << np.uint64(32)) + (np.uint64(band + 1) << np.uint64(52)) + filled.astype(np.uint64)
                sigs = mixed(mixed(total[cut[1:]] - total[cut[:-1]]) + mixed(tag))
                out.append(sigs if np.count_nonzero(filled < least) > spare else sigs[filled >= least])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """One number for equal sets."""
    return int(mixed(np.sum(mixed(s), dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


def sketch(s: np.ndarray, ranges: int = SKETCH) -> bytes:
    """How many shingles fall into each of ``ranges`` (a power of two) hash ranges, 15 at most, two in a byte."""
    found = np.minimum(np.bincount((s >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64), minlength=ranges), 15).astype(np.uint8)
    return (found[::2] << 4 | found[1::2]).tobytes()


def folded(sketches: list[bytes], ranges: int) -> np.ndarray:
    """``sketches`` over as few as ``ranges`` ranges, a row for each."""
    out = np.empty((len(sketches), ranges), np.int16)
    sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        some = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint8).reshape(len(at), size)
        out[at] = np.stack([some >> 4, some & 15], 2).reshape(len(at), ranges, 2 * size // ranges).sum(2, dtype=np.int16)
    return out


_TIES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _ties(lists: DataFrame, percent: int) -> DataFrame:
    """``lists`` (sig, cls, n, sketch): ties (a, b) that connect the members of each list that can be linked."""

    def near(sizes: np.ndarray, sketches: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
        gap = np.abs(sketches - other).sum(-1, dtype=np.int64)
        return gap <= (sizes + n) - 2 * -(-percent * (sizes + n) // (100 + percent))

    def tie(sig: np.ndarray, cls: np.ndarray, size: np.ndarray, sketches: list[bytes]) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1])
        length = np.diff(np.append(first, len(sig)))
        ranges = np.repeat(2 * np.minimum.reduceat(np.fromiter(map(len, sketches), np.int64, len(sketches)), first), length)  # a list's fewest
        for n in np.unique(ranges).tolist():
            at = np.flatnonzero(ranges == n)
            yield tie_alike(sig[at], cls[at], size[at], folded([sketches[i] for i in at.tolist()], n))

    def tie_alike(sig: np.ndarray, cls: np.ndarray, size: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1])
        length = np.diff(np.append(first, len(sig)))
        lead = np.repeat(first, length)
        ok = near(size, sketches, size[lead], sketches[lead])
        label = np.where(ok, lead, np.arange(len(sig)))  # a member of the same connected part of its list
        for i in np.flatnonzero(~ok & (length.repeat(length) > 2)).tolist():  # not tied to the first: against all of the list
            lo = lead[i]
            hi = lo + length[np.searchsorted(first, lo)]
            part = label[lo:hi]
            met = np.unique(np.append(part[near(size[lo:hi], sketches[lo:hi], size[i], sketches[i])], label[i]))
            part[np.isin(part, met)] = met[0]
        tied = label != np.arange(len(sig))
        pairs = np.unique(np.stack([cls[tied], cls[label[tied]]], 1), axis=0)
        return common.batch(_TIES, (pairs[:, 0], pairs[:, 1]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list | None = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [c.to_numpy() for c in b.columns[:3]]
            kept = [*new, b.column(3).to_pylist()] if kept is None else [*(np.concatenate(x) for x in zip(kept[:3], new, strict=True)), kept[3] + b.column(3).to_pylist()]
            open_ = int(np.searchsorted(kept[0], kept[0][-1]))  # the last list may go on
            if open_:
                yield from tie(*(x[:open_] for x in kept))
                kept = [x[open_:] for x in kept]
        if kept is not None:
            yield from tie(*kept)

    ordered = lists.select("sig", "cls", "n", "sketch").repartition("sig").sortWithinPartitions("sig", "n", "cls")
    return ordered.mapInArrow(scan, "a long, b long").distinct()


_SETS = pa.schema([("doc_id", pa.int64()), ("_id", pa.int64()), ("_row", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("sigs", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: size, class and signatures; the signatures only once for a class and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, seen = Rule(percent), set()
        for b in batches:
            sizes, classes, sigs, sketches = [], [], [], []
            for text in common.as_bytes(b.column(3)):
                s = shingle_set(text, k)
                c = class_of(s) if len(s) else None
                sizes.append(len(s))
                classes.append(c)
                new = c is not None and c not in seen
                sigs.append(rule.signatures(s).view(np.int64) if new else None)
                sketches.append(sketch(s, rule.ranges(len(s))) if new else None)
                seen.add(c)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=_SETS)

    return docs.select("doc_id", *common.row_key(), "text").mapInArrow(scan, "doc_id long, _id long, _row long, n_shingles long, cls long, sigs array<long>, sketch binary")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def linked_groups(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first set of its component under the exact rule."""
    n, union = len(sets), _Union(len(sets))
    if n < 2:
        return [0] * n
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]])

    def shares(i: int, j: int) -> bool:
        both = np.concatenate([sets[i], sets[j]])
        both.sort()
        common_ = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * common_ >= percent * (len(both) - common_)

    def scan(i: int) -> None:
        """All links of one set, from the lists of its shingles."""
        at = np.searchsorted(flat[starts[:-1]], sets[i])
        owners = np.concatenate([owner[starts[a] : starts[a + 1]] for a in at])
        both = np.bincount(owners, minlength=n)
        for j in np.flatnonzero((100 * both >= percent * (sizes + len(sets[i]) - both)) & (both > 0)).tolist():
            union.join(i, j)

    leaders, short = [], []  # a leader was fully scanned; a short one was tied to a leader and no more
    for i in range(n):
        if any(shares(i, j) and (union.join(i, j) or True) for j in leaders[-8:]):
            short.append(i)
        else:
            scan(i)
            leaders.append(i)
    tied: dict[int, list[int]] = {}
    for i in short:
        tied.setdefault(union.root(i), []).append(i)
    for group in sorted(tied.values(), key=len)[:-1]:  # two short ones of two groups: one of them is scanned
        for i in group:
            scan(i)
    return [union.root(i) for i in range(n)]


_LINKS = pa.schema([("cls", pa.int64()), ("root", pa.int64())])


def _verified(candidates: DataFrame, k: int, percent: int) -> DataFrame:
    """``candidates`` (comp, cls, text), a row for each class: the class and the component's smallest class."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, classes, sets = None, [], []

        def done() -> pa.RecordBatch:
            return common.batch(_LINKS, (classes, [classes[r] for r in linked_groups(sets, percent)]))

        for b in batches:
            for c, cls, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.as_bytes(b.column(2)), strict=True):
                if classes and cls == classes[-1]:  # a repeated row
                    continue
                if c != comp and classes:
                    yield done()
                    classes, sets = [], []
                comp = c
                classes.append(cls)
                sets.append(shingle_set(text, k))
        if classes:
            yield done()

    ordered = candidates.select("comp", "cls", "text").repartition("comp").sortWithinPartitions("comp", "cls")
    return ordered.mapInArrow(check, "cls long, root long")


def link_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): _id, _row (its key, see common.row_key), doc_id, n_shingles, component_id,
    and root, the same for all rows of a component and null for a row without shingles, which is one by itself."""
    common.small_batches(docs.sparkSession)
    sets = common.stored(_sets(docs, k, percent), "sets")
    lists = sets.select("cls", F.explode("sigs").alias("sig"))
    of_sig = Window.partitionBy("sig")
    shared = lists.withColumn("low", F.min("cls").over(of_sig)).withColumn("high", F.max("cls").over(of_sig)).where("low < high").select("sig", "cls").distinct()
    sketches = sets.where("sketch IS NOT NULL").groupBy("cls").agg(F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    candidates = components(_ties(shared.join(sketches, "cls"), percent))

    first = sets.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("_id", "_row")).alias("at"))
    wanted = candidates.join(first, candidates.v == first.cls).select("cls", F.col("root").alias("comp"), "at._id", "at._row")
    texts = docs.select(*common.row_key(), "text").join(wanted, ["_id", "_row"])
    roots = common.stored(_verified(texts, k, percent), "links")

    smallest = sets.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("id"))
    of_class = smallest.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = of_class.groupBy("root").agg(F.min("id").alias("component_id"))
    merged = of_class.join(ids, "root").select("cls", "root", "component_id")
    return sets.join(merged, "cls", "left").select("_id", "_row", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id (of rows that share it, one).

    Components count by their rows, not by ids, so unrelated texts under one id, or without id, all stay.
    """
    alone = F.col("root").isNull()
    rows = link_components(docs, k, percent).groupBy("root", F.when(alone, F.col("_id")), F.when(alone, F.col("_row")))
    kept = rows.agg(F.min(F.struct(F.col("doc_id").isNull(), "_id", "_row")).alias("at")).select("at._id", "at._row")
    # repeated rows are equal in id and text, so any of them may stand for all
    return common.keyed(docs).join(kept, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).select("_doc.*")
