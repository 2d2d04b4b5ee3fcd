import datetime as dt

from rosterlake.operators import promotion as P

ANCHOR = "company_id long, anchor_id string, anchor_month date, value_min double, value_point double, value_max double, kind string, anchor_type string, confidence double, source_name string"
MONTH = dt.date(2020, 3, 15)


def test_benchmarks_are_promoted_once_and_counted(spark):
    rows = [(1, "b1", "primary", "headcount_current", MONTH, None, 10.0, None), (1, "b2", "other", "headcount_1y_ago", MONTH, 1.0, 2.0, 3.0), (None, "b3", "primary", "headcount_current", MONTH, None, 1.0, None), (1, "b4", "primary", "headcount_current", MONTH, 5.0, 1.0, 9.0), (1, "b5", "tertiary", "headcount_current", MONTH, None, 1.0, None), (1, "b6", "primary", "growth_1y_pct", MONTH, None, 1.0, None)]
    df = spark.createDataFrame(rows, "company_id long, benchmark_id string, provider string, metric string, as_of_month date, value_min double, value_point double, value_max double")
    out = P.promote_benchmarks(df, spark.createDataFrame([], ANCHOR), ("tertiary",))
    assert {r.outcome: r.n for r in out["counts"].collect()} == {"promoted": 2, "skipped_no_company": 1, "skipped_no_value": 1, "skipped_provider": 1}
    assert {(r.anchor_type, r.confidence, r.value_min, str(r.anchor_month)) for r in out["anchors"].collect()} == {("current_headcount_anchor", 0.7, 10.0, "2020-03-01"), ("historical_statement", 0.5, 1.0, "2020-03-01")}
    again = P.promote_benchmarks(df, out["anchors"], ("tertiary",))
    assert again["anchors"].count() == 0 and {r.outcome for r in again["counts"].collect()} >= {"already_promoted"}


def test_manual_entries_need_a_note_and_a_company(spark):
    comp = spark.createDataFrame([(1, "Acme Inc", "acme.com", None), (2, "Beta", None, None)], "company_id long, name string, domain string, profile_url string")
    alias = spark.createDataFrame([(2, "Old Beta")], "company_id long, alias string")
    rows = [("e1", "x", "www.acme.com", None, MONTH, 1.0, 1.0, 1.0, "exact", None, "seen"), ("e2", "old beta llc", None, None, MONTH, 1.0, 1.0, 1.0, "exact", 0.5, "seen"), ("e3", "Beta", None, None, MONTH, 1.0, 1.0, 1.0, "exact", 0.5, " "), ("e4", "Nobody", None, None, MONTH, 1.0, 1.0, 1.0, "exact", 0.5, "seen")]
    df = spark.createDataFrame(rows, "entry_id string, name string, domain string, profile_url string, anchor_month date, value_min double, value_point double, value_max double, kind string, confidence double, note string")
    out = P.manual_entries(df, comp, alias)
    assert {(r.company_id, r.confidence) for r in out["anchors"].collect()} == {(1, 0.95), (2, 0.5)}
    assert {(r.entry_id, r.reject_reason) for r in out["rejected"].collect()} == {("e3", "note_required"), ("e4", "no_company")}


def test_missing_current_and_trends(spark):
    rows = [(1, "a", dt.date(2020, 1, 1), 1.0, 120.0, 200.0, "exact", "current_headcount_anchor", 0.5, "x"), (1, "b", dt.date(2019, 1, 1), 1.0, 9.0, 9.0, "exact", "current_headcount_anchor", 0.5, "x"), (2, "c", dt.date(2020, 1, 1), 0.0, 0.0, 0.0, "exact", "current_headcount_anchor", 0.5, "x")]
    anchors = spark.createDataFrame(rows, ANCHOR)
    comp = spark.createDataFrame([(1,), (2,), (3,)], "company_id long")
    assert {r.company_id for r in P.missing_current(comp, anchors).collect()} == {2, 3}
    trends = spark.createDataFrame([(1, {12: 20.0, 6: -100.0})], "company_id long, trends map<int,double>")
    got = P.trend_anchors(anchors, trends).collect()
    assert [(str(r.anchor_month), round(r.value_point, 6)) for r in got] == [("2019-01-01", 100.0)]


def test_purge_and_fill(spark):
    obs = spark.createDataFrame([("o1", "good"), ("o2", "bad")], "observation_id string, source_name string")
    anc = spark.createDataFrame([(1, "o1"), (2, "o2"), (3, None)], "company_id long, observation_id string")
    o, a = P.purge_sources(obs, anc, ("bad",))
    assert o.count() == 1 and {r.company_id for r in a.collect()} == {1, 3}
    comp = spark.createDataFrame([(1, " "), (2, "u")], "company_id long, profile_url string")
    res = spark.createDataFrame([(1, "r"), (2, "r")], "company_id long, resolved_url string")
    assert {r.company_id: r.profile_url for r in P.fill_profile_urls(comp, res).collect()} == {1: "r", 2: "u"}
