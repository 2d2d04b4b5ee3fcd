"""Queries over every stored company-month against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from rosterlake.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", ["segment_lookup_all", "evidence_all"])
def test_every_month_equals_sql(spark, name):
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    shown = lambda rows: sorted((tuple(str(round(v, 4)) if isinstance(v, float) else str(v) for v in r) for r in rows))
    assert shown(got) == shown(want)
    at = df.columns.index("month")
    assert {r[at][5:7] for r in got} == {f"{m:02d}" for m in range(1, 13)} and len({r[at][:4] for r in got}) > 1
