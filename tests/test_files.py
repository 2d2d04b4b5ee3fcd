"""Analyst files, ordered tables with pages, range joins by blocks, snapshots."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import evidence as X
from rosterlake.operators import series as S
from rosterlake.sources import analyst as AN
from rosterlake.sources import exports as EX

GOOD = """
# a comment
- canonical_name: Acme Inc.
  domain: acme.example
  anchor_month: 2026-04-17
  headcount: {min: 10, point: 12.5, max: 20, kind: range}
  confidence: 0.9
  note: "cited: page 3"
  source_url: https://a.example/x
- {linkedin_slug: acme, anchor_month: "2025-01-01", headcount: {min: 1, point: 1, max: 1}, note: 7}
"""
BAD = """
- just text
- {anchor_month: 2026-01-01, note: x}
- {anchor_month: 2026-01-01, note: x, headcount: {min: 1, point: 2}}
- {anchor_month: 2026-01-01, note: x, headcount: {min: 1, point: .nan, max: 2}}
- {anchor_month: 2026-01-01, note: x, headcount: {min: 1, point: 2, max: 3, kind: other}}
- {anchor_month: 2026-01-01, headcount: {min: 1, point: 2, max: 3}}
- {anchor_month: soon, note: x, headcount: {min: 1, point: 2, max: 3}}
- {note: x, headcount: {min: 1, point: 2, max: 3}}
- {anchor_month: 2026-01-01, note: x, confidence: high, headcount: {min: 1, point: 2, max: 3}}
- {anchor_month: 2026-01-01, note: ok, headcount: {min: 1, point: 2, max: 3}}
"""


def test_analyst_files(spark, tmp_path):
    for name, text in {"a.yaml": GOOD, "b.yaml": BAD, "c.yaml": "", "d.yaml": "key: value", "e.yaml": "- [unclosed", "f.yaml": "[]"}.items():
        (tmp_path / name).write_text(text)
    got = AN.read_analyst_files(spark, f"file://{tmp_path}/*.yaml")
    rows = {(r.file[-6:], r.entry_no): r for r in got["rows"].collect()}
    assert rows.keys() == {("a.yaml", 1), ("a.yaml", 2), ("b.yaml", 10)}
    one, two = rows["a.yaml", 1], rows["a.yaml", 2]
    assert (one.name, one.domain, one.anchor_month, one.value_point, one.kind, one.confidence, one.note) == ("Acme Inc.", "acme.example", dt.date(2026, 4, 1), 12.5, "range", 0.9, "cited: page 3")
    assert (two.name, two.profile_url, two.kind, two.confidence, two.note, two.source_url) == (None, "acme", "exact", 0.95, "7", None)
    reasons = ["not_a_mapping", "headcount_missing", "headcount_unreadable", "headcount_unreadable", "unknown_kind", "note_required", "month_unreadable", "month_unreadable", "confidence_unreadable"]
    assert sorted(((r.file[-6:], r.entry_no, r.reject_reason) for r in got["rejected"].collect()), key=repr) == sorted(
        [("b.yaml", i, x) for i, x in enumerate(reasons, 1)] + [("d.yaml", None, "not_a_list"), ("e.yaml", None, "not_a_list")], key=repr
    )


def test_ordered_pages(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.randrange(20), i, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b long, c string").repartition(7)
    path, order = f"file://{tmp_path}/t", ["a", "b"]
    EX.write_ordered(df, path, order, 6)
    want = sorted(rows)
    for offset, limit in ((0, 10), (245, 60), (490, 30), (0, 1000), (700, 5)):
        assert [tuple(r) for r in EX.read_page(spark, path, order, limit, offset).collect()] == want[offset : offset + limit]
    for at in (0, 99, 250, 499):
        assert [tuple(r) for r in EX.read_after(spark, path, order, want[at][:2], 70).collect()] == want[at + 1 : at + 71]
    assert EX.read_after(spark, path, order, (-1, 0), 3).count() == 3
    index = spark.read.parquet(f"{path}/index")
    assert index.count() > 2 and index.agg(F.sum("n")).first()[0] == 500


def test_unknown_reports(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown report"):
        EX.export_report("nothing", str(tmp_path), "csv")
    queue = spark.createDataFrame([(1, "i1", "manual", 5, "open", None, None, "d", dt.date(2020, 1, 1)), (1, "i2", "manual", 9, "resolved", None, None, "d", dt.date(2020, 1, 1))],
                                  "company_id long, item_id string, reason string, priority int, status string, assignee string, version_id string, detail string, updated_at date")
    companies = spark.createDataFrame([(1, "A")], "company_id long, name string")
    with pytest.raises(ValueError, match="unknown format"):
        EX.export_report("review_queue", f"{tmp_path}/x", "xml", queue, companies)
    assert EX.export_report("review_queue", f"{tmp_path}/y", "CSV", queue, companies).count() == 1
    assert EX.export_report("review_queue", f"{tmp_path}/z", "json", queue, companies, include_resolved=True).count() == 2


def test_ranges_meet_months_by_blocks(spark):
    rnd = random.Random(9)
    month = lambda o: dt.date(1990 + o // 12, o % 12 + 1, 1)
    rows = [(c if c else None, month(rnd.randrange(120)), i) for i in range(300) for c in [rnd.randrange(4)]]
    spans = []
    for i in range(60):
        a = rnd.randrange(120)
        spans.append((rnd.randrange(1, 4), month(a), month(max(0, a + rnd.randrange(-2, 40))), i))
    spans += [(1, None, month(3), 90), (2, month(3), None, 91)]
    left = spark.createDataFrame(rows, "company_id int, month date, row int")
    right = spark.createDataFrame(spans, "company_id int, s date, e date, span int")
    got = sorted((r.row, r.span) for r in S.in_ranges(left, "month", right, "s", "e").collect())
    assert got == sorted((r, k) for c, m, r in rows for d, s, e, k in spans if c == d and s and e and s <= m <= e)


def test_snapshots_nearest_to_each_horizon(spark):
    rnd = random.Random(12)
    month = lambda o: dt.date(2015 + o // 12, o % 12 + 1, 1)
    as_of = 12 * 6
    rows = [(f"o{k}", rnd.randrange(as_of + 3)) for k in range(60) for _ in range(rnd.randrange(1, 6))]
    df = spark.createDataFrame([(o, month(m)) for o, m in rows] + [("x", None)], "origin string, snapshot_month date")
    want = set()
    for o in {o for o, _ in rows}:
        mine, used = sorted({m for q, m in rows if q == o}), set()
        for h in (6, 12, 24):
            off, m = min((abs(m - (as_of - h)), m) for m in mine)
            if off <= 12 and m not in used:
                used.add(m)
                want.add((o, month(m), h, month(as_of - h)))
    got = X.snapshot_choice(df, F.lit(month(as_of)))
    assert set(map(tuple, got.select("origin", "snapshot_month", "horizon", "stamped_month").collect())) == want
    assert X.snapshot_choice(df.limit(0), F.lit(month(as_of))).count() == 0
