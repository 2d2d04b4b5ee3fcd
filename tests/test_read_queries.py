"""Queries of scoring, sheets, lookups, upkeep and reading against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from rosterlake.plans import queries, read_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
NAMES = sorted(n for n, f in queries.QUERIES.items() if f.__module__ == read_queries.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    shown = lambda rows: sorted(tuple(str(round(float(v), 4)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    got = shown(df.collect())
    assert got == shown(want) and got
