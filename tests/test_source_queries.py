"""Queries of stores, files, exports and logs against SQL."""

from pathlib import Path

import duckdb
import pytest

from rosterlake.plans import queries, source_queries

SF = "/root/testdata/sf0.001"
NAMES = [n for n in queries.QUERIES if hasattr(source_queries, n) and getattr(source_queries, n).__module__ == source_queries.__name__]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{x}"' for x in df.columns)
    want = c.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    shown = lambda rows: sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert shown(map(tuple, df.collect())) == shown(want) and want
