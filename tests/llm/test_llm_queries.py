"""Registered queries against DuckDB, and the pipeline against what its stages promise."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from rosterlake.llm import decontaminate, queries
from rosterlake.llm.queries import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    shown = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert shown(map(tuple, df.collect())) == shown(want)


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "token_ids":
            assert docs.columns == columns
    sizes = {k: v.select("doc_id").distinct().count() for k, v in seen.items()}
    assert sizes["quality_rules"] >= sizes["near_dedup"] >= sizes["decontamination"] > 0
    assert decontaminate.find_leaks(seen["decontamination"], table(spark, SF, "benchmark")).count() == 0
    assert seen["token_ids"].count() == seen["mixing"].count()
    rows = sorted((r.start, r.n_tokens) for r in seen["token_ids"].collect())
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))
