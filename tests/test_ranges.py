"""Ranges folded by joins against ranges folded one by one."""

from __future__ import annotations

import random

from cryolog.streaming import ranges

SCHEMA = "source string, file string, arrival long, from_byte long, to_byte long, size long"


def plain(rows):
    found, end = [], {}
    for row in sorted(rows, key=lambda x: x[2:]):
        source, file, _, low, high, size = row
        at = end.get((source, file), 0)
        verdict = "beyond" if high > size else "hole" if low > at else "replay" if low < at else "accepted"
        if verdict == "accepted":
            end[source, file] = high
        found.append((*row, verdict))
    return sorted(found, key=repr)


def test_fold_equals_one_by_one(spark):
    r = random.Random(9)
    rows = []
    for source, file, n in [("a", "x", 90), ("a", "y", 30), ("b", None, 30), ("b", "x", 1)]:
        low = 0
        for arrival in range(n):
            start = max(0, low + r.choice([0, 0, 0, 0, -3, 2]))
            end = start + r.choice([0, 1, 2, 3])
            rows.append((source, file, arrival, start, end, r.choice([10_000, 10_000, 10_000, end - 1])))
            low = end if start == low and end <= rows[-1][5] else low
    rows += [rows[3], rows[3], ("c", "z", 1, 4, 5, 9), ("c", "z", 1, 0, 4, 9)]  # repeated rows, equal arrivals
    got = ranges.fold_ranges(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    assert sum(x.verdict == "accepted" for x in got) > 40


def test_no_ranges(spark):
    assert ranges.fold_ranges(spark.createDataFrame([], SCHEMA)).count() == 0


def test_what_is_kept_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def looked(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = ranges.kept(spark.range(50).mapInPandas(looked, "id long"))
    assert rows.count() == seen.value == 50
