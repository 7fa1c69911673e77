"""Components against a plain union of sets: long chains, stars, rings, repeated and reversed edges, loops, nothing."""

from __future__ import annotations

import random

from cryolog.llm.components import components


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2000 + (i + 1) % 20) for i in range(20)]
    edges += [(rnd.randrange(3000, 3400), rnd.randrange(3000, 3400)) for _ in range(250)] + [(1, 0), (1, 0), (5000, 5000)]
    group = {v: {v} for e in edges for v in e}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for v in group[b]:
                group[v] = group[a]
    found = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found) == {v for a, b in edges if a != b for v in (a, b)}
    for v, root in found.items():
        assert {x for x, r in found.items() if r == root} == group[v] and root in group[v]


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
