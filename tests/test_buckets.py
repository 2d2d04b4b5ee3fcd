"""Bucketed tables with manifests, and estimates of changed companies only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlake.config import Window
from rosterlake.plans import incremental as I
from rosterlake.plans.estimate import estimate
from rosterlake.sources.buckets import BucketStore, Conflict


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, f"file://{tmp_path}/store")


def test_upsert_rewrites_touched_buckets_only(spark, store):
    old = spark.createDataFrame([(i, f"v{i}", None if i % 3 else i) for i in range(200)] + [(None, "none", 1)], "k long, v string, n long")
    first = store.create(old, ["k"], 16)
    assert rows_of(store.read()) == rows_of(old) and len(first.folders) == 16
    new = spark.createDataFrame([(7, "new", 7), (8, "v8", None), (None, "gone", 2), (900, "more", None)], "k long, v string, n long")
    hit = {r[0] for r in new.select(store.bucket(["k"], 16)).collect()}
    second, counts = store.upsert(new)
    assert {b for b in range(16) if second.folders[b] != first.folders[b]} == hit and len(hit) < 6
    want = {r.k: tuple(r) for r in old.collect()} | {r.k: tuple(r) for r in new.collect()}
    assert rows_of(store.read()) == sorted(want.values(), key=repr)
    touched = store.read(buckets=sorted(hit)).count()
    assert counts == {"inserted": 1, "refreshed": 2, "unchanged": 1, "kept": touched - 4}
    assert rows_of(store.read(0)) == rows_of(old)
    assert store.upsert(new.limit(0)) == (second, {"inserted": 0, "refreshed": 0, "unchanged": 0, "kept": 0})
    store.replace(spark.createDataFrame([(k,) for k in range(150)], "k long"), new.limit(0))
    assert store.read().count() == 52
    assert store.vacuum() > 0 and store.versions() == [2] and store.read().count() == 52


def test_failed_and_competing_writers(spark, store):
    store.create(spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.lit(0)), ["k"], 4)
    before = rows_of(store.read())
    with pytest.raises(Exception, match="boom"):
        store.rewrite(store.read().limit(1), lambda old: old.withColumn("v", F.raise_error(F.lit("boom")).cast("int")))
    assert rows_of(store.read()) == before and store.versions() == [0]
    with pytest.raises(ValueError, match="untouched"):
        store.rewrite(spark.createDataFrame([(1,)], "k long"), lambda old: spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v")))

    def overtaken(old):
        other = BucketStore(spark, store.path)
        other.upsert(spark.createDataFrame([(3, 33)], "k long, v int"))
        return old.withColumn("v", F.lit(9))

    with pytest.raises(Conflict):
        store.rewrite(spark.createDataFrame([(1,)], "k long"), overtaken)
    assert {r.k: r.v for r in store.read().collect()} == {k: 33 if k == 3 else 0 for k in range(50)}
    with pytest.raises(Conflict):
        store.create(store.read(), ["k"], 4)
    assert store.vacuum() > 0 and store.read().count() == 50


def test_empty_store(spark, store):
    assert store.manifest() is None
    with pytest.raises(FileNotFoundError):
        store.read()
    store.create(spark.createDataFrame([], "k long, v string"), ["k"], 4)
    assert store.read().count() == 0
    _, counts = store.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    assert counts["inserted"] == 1 and store.read().count() == 1


def test_only_changed_companies_are_estimated(spark, tmp_path, monkeypatch):
    d = dt.date
    companies = spark.createDataFrame([(i,) for i in range(1, 6)], "company_id long")
    work = [(c, p, d(2020, 1, 1), d(2020, 1 + (p + c) % 12, 1), False) for c in range(1, 6) for p in range(9)]
    anchor = [(c, f"a{c}", d(2020, 3, 1), 90.0, 100.0, 110.0, "range", "historical_statement", 0.5, "s") for c in range(1, 6)]
    anchors_schema = "company_id long, anchor_id string, anchor_month date, value_min double, value_point double, value_max double, kind string, anchor_type string, confidence double, source_name string"
    events = spark.createDataFrame([], "company_id long, event_id string, event_type string, event_month date, source_class string, confidence double, description string, created_at timestamp")
    expires = dt.datetime(2021, 1, 1)
    over = [(4, "o4", "current_anchor", '{"anchor_month": "2020-05-01", "value_min": 1, "value_point": 2, "value_max": 3}', "r", expires, expires)]
    overrides = spark.createDataFrame(over, "company_id long, override_id string, field_name string, payload string, reason string, expires_at timestamp, created_at timestamp")
    window = Window("2020-01-01", "2020-12-01", "2020-12-01")

    def of(companies, work, anchor, now="2020-12-15 00:00:00"):
        jobs = spark.createDataFrame(work, "company_id long, person_id long, start_month date, end_month date, is_current boolean")
        return estimate(companies, jobs, spark.createDataFrame(anchor, anchors_schema), events, overrides, window, F.lit(now).cast("timestamp"))

    path = f"file://{tmp_path}/estimates"
    series, prints = BucketStore(spark, f"{path}/series"), BucketStore(spark, f"{path}/fingerprints")
    asked = []
    plain = I._only
    monkeypatch.setattr(I, "_only", lambda e, ids: asked.append({r[0] for r in ids.collect()}) or plain(e, ids))

    def run(e, want):
        asked.clear()
        got = I.refresh(e, series, prints, 8)
        assert {(r.company_id, r.action) for r in got["changed"].collect()} == want
        assert rows_of(got["stored"].select(sorted(got["stored"].columns))) == rows_of(e.stored.select(sorted(e.stored.columns)))
        return asked

    run(of(companies, work, anchor), {(i, "new") for i in range(1, 6)})
    assert run(of(companies, work[::-1], anchor[::-1]), set()) == []
    moved = [(*a[:4], 105.0, *a[5:]) if a[0] == 2 else a for a in anchor]
    assert run(of(companies, work, moved), {(2, "changed")}) == [{2}]
    assert run(of(companies.where("company_id <> 5"), work + work[:1], moved), {(5, "gone"), (1, "changed")}) == [{1, 5}]
    late = of(companies.where("company_id <> 5"), work + work[:1], moved, "2021-06-01 00:00:00")
    assert run(late, {(4, "changed")}) == [{4}]
