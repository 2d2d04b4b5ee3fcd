"""Readers of text and pages: whole queries against SQL, and single phrases."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rosterlake.functions import text as T
from rosterlake.operators import evidence as X
from rosterlake.operators import pages as P
from rosterlake.operators import reading as RD
from rosterlake.operators import resolution as RS
from rosterlake.plans import queries, text_queries
from rosterlake.sources import tables as TB

SF = "/root/testdata/sf0.001"
NAMES = [n for n in queries.QUERIES if hasattr(text_queries, n) and getattr(text_queries, n).__module__ == text_queries.__name__]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{x}"' for x in df.columns)
    want = c.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and want


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make("t").alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("6m +12% 1y -8% 2y 34", {6: 12.0, 12: -8.0, 24: 34.0}),
        ("6 months: 5%, 1 year 2.5", {6: 5.0, 12: 2.5}),
        ("6m 700% 6m 3%", {6: 3.0}),
        ("nothing here", {}),
        (None, {}),
    ],
)
def test_growth_trends(spark, text, want):
    assert one(spark, text, T.growth_trends) == want


def test_gates(spark):
    rows = [(200, "https://x/company/a", "We noticed unusual activity"), (200, "https://x/checkpoint/1", "x"), (407, None, None), (200, "https://x/a", "please verify you are a human"), (200, None, None)]
    df = spark.createDataFrame(rows, "status int, url string, text string")
    want = ["marker:unusual_activity", "login_redirect", "auth_required", "marker:please_verify_you_are_a_human", None]
    assert [r.g for r in df.select(T.gate_reason("status", "url", "text").alias("g")).collect()] == want


def test_counts_and_classes(spark):
    assert one(spark, "1 member, 12,345 associated members", T.exact_count) == 12345
    assert one(spark, "1 member", T.exact_count) is None
    b = one(spark, "Company size 5,001-10,000 employees", T.size_badge)
    assert (b.low, b.high, b.open_ended) == (5001, 10000, False)
    label = spark.range(1).select(T.size_class(F.lit(5001), F.lit(10000)).alias("a"), T.size_class(F.lit(3), F.lit(9)).alias("b")).first()
    assert (label.a, label.b) == ("5,001-10,000", "3-9")


def test_slugs_of_taxonomy_pages_are_left_out(spark):
    body = "linkedin.com/company/showcase linkedin.com/company/linkedin linkedin.com/company/acme"
    assert one(spark, body, P.result_slugs) == ["acme"] and one(spark, body + " verify you are a human", P.result_slugs) == []


def test_relations_follow_the_type_of_the_event(spark):
    companies = spark.createDataFrame([(1, "Foo Inc"), (2, "Bar"), (3, "Baz")], "company_id long, name string")
    aliases = spark.createDataFrame([(3, "Zed Ltd"), (2, "Foo")], "company_id long, alias string")
    a, r = "acquisition", "rebrand"
    notes = [
        (2, a, "acquired by Foo in 2020"), (3, a, "Acquired by Foo. Then moved"), (1, r, "rebranded as Baz"), (2, a, "acquired by Bar"), (3, a, "acquired by Qux on 1 May"), (3, a, None),
        (1, a, "now part of Bar"), (1, a, "owned by Bar"), (1, a, "subsidiary of Bar"), (2, r, "acquired by Baz"), (2, a, "renamed to Baz"), (2, "merger", "acquired by Baz"), (2, r, 'Now as "Zed"'), (2, r, "now as Zed"), (2, None, "acquired by Baz"),
    ]
    events = spark.createDataFrame(notes, "company_id long, hint_type string, note string")
    got = RS.relations(events, companies, aliases)
    assert sorted(map(tuple, got["edges"].collect())) == [(1, 2, "acquired"), (1, 3, "acquired"), (3, 1, "renamed"), (3, 2, "renamed")]
    assert sorted((x.kind, x.parent_name) for x in got["unresolved"].collect()) == [("acquired", "Qux")]
    again = RS.relations(events, companies, aliases, spark.createDataFrame([(1, 2, "acquired")], "parent_id long, child_id long, kind string"))
    assert again["edges"].count() == 3


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_note_relations_covers_every_company(spark):
    """Each supplier has a link or an unresolved name of either kind; nobody is left out by its number."""
    keys = {r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    rows = text_queries.note_relations(spark, SF).collect()
    edges = {(r.parent_id, r.child_id, r.kind) for r in rows if r.parent_id is not None}
    assert edges == {(k + i, k, kind) for k in keys for kind, steps in (("acquired", 3), ("renamed", 2)) for i in range(1, steps + 1) if k + i in keys}
    missing = {(r.child_id, r.kind, r.unresolved) for r in rows if r.parent_id is None}
    assert missing == {(k, "acquired", f"Nobody {k + 1}") for k in keys} | {(k, kind, f"Firm {k + i}") for k in keys for kind, steps in (("acquired", 3), ("renamed", 2)) for i in range(1, steps + 1) if k + i not in keys}


def test_policy_and_repeats(spark):
    assert X.policy(spark).count() == 12
    rows = [(1, "s", "u", "t", 5), (1, "s", "u", "t", 3), (1, "s", "u", "other", 9)]
    stored = spark.createDataFrame([], "company_id long, source_name string, content_hash string")
    got = TB.new_signals(spark.createDataFrame(rows, "company_id long, source_name string, url string, text string, v long"), stored)
    assert sorted(r.v for r in got.collect()) == [3, 9]
    anchors = spark.createDataFrame([(1, f"a{i}", "2020-01-01", "s", float(i), 0.5) for i in range(12)], "company_id long, anchor_id string, anchor_month string, source_name string, value_point double, confidence double")
    y = RD.anchor_yield(anchors).first()
    assert y.n_anchors == 12 and len(y.examples) == 10 and RD.anchor_matrix(anchors, ["s", "t"]).first().asDict() == {"company_id": 1, "s": 12, "t": 0}
