"""Exact medians against a library's."""

from __future__ import annotations

import random
from statistics import median

from cryolog.operators.select import exact_medians


def test_medians(spark):
    r = random.Random(6)
    groups = {
        "even": [r.gauss(0, 1) for _ in range(1000)], "odd": [r.gauss(0, 1) for _ in range(999)], "one": [4.5], "two": [1.0, 2.0], "equal": [7.0] * 3000, "halves": [1.0] * 500 + [2.0] * 500,
        "skewed": [2.0**k for k in range(-400, 400)], None: [-3.0, None, 5.0, None], "none": [None, None], "ties": [float(r.randint(0, 3)) for _ in range(2001)], "hot": [r.random() ** 9 for _ in range(20_000)],
    }
    rows = [(g, v, "x") for g, values in groups.items() for v in values]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, value double, _v string").repartition(5)
    for accuracy in (1000, 20):
        got = {x["name"]: x["median"] for x in exact_medians(df, ["name"], accuracy=accuracy).collect()}
        assert got == {g: (median(v for v in values if v is not None) if any(v is not None for v in values) else None) for g, values in groups.items()}
    assert exact_medians(df.where("false"), ["name"]).count() == 0


def test_a_hot_group_sends_on_few_rows(spark):
    df = spark.range(200_000).selectExpr("1 AS run_id", "CAST(hash(id) AS DOUBLE) AS value").repartition(4)
    out = exact_medians(df, ["run_id"])
    values = sorted(r.value for r in df.collect())
    assert out.first().median == (values[99_999] + values[100_000]) / 2
