"""Every telemetry query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from cryolog.plans import imports, long_runs, oracle, stored, telemetry

QUERIES = telemetry.queries() | imports.queries() | stored.queries() | long_runs.queries()
SQL = oracle.oracle_sql() | imports.oracle_sql() | stored.oracle_sql() | long_runs.oracle_sql()
SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda x: "" if pd.isna(x) else float(x) if not isinstance(x, str) else x
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_parts_of_runs_grow_with_the_frames(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "FRAMES_EACH", 50, raising=False)
    parts = -(-spark.read.parquet(f"{SF}/events.parquet").count() // 50)
    held = [telemetry.frames(spark, SF), telemetry._looped(spark, SF), QUERIES["g2_diagnostics"](spark, SF)]
    assert parts > 4 and [x.rdd.getNumPartitions() for x in held] == [parts] * 3
