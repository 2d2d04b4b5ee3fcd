"""Hand-computed cases of the estimation operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlake.config import EstimateConfig, EvaluationConfig, Window
from rosterlake.functions import expressions as X
from rosterlake.functions import text as T
from rosterlake.operators import confidence as C
from rosterlake.operators import evaluation as E
from rosterlake.operators import events as EV
from rosterlake.operators import growth as G
from rosterlake.operators import overrides as OV
from rosterlake.operators import review as R
from rosterlake.operators import series as S

WINDOW = Window("2020-01-01", "2020-06-01", "2020-06-01")


def day(s):
    return dt.date.fromisoformat(s)


def companies(spark, *ids):
    return spark.createDataFrame([(i, f"c{i}") for i in ids], "company_id long, name string")


def intervals(spark, rows):
    return spark.createDataFrame([(c, p, day(s), day(e) if e else None, cur) for c, p, s, e, cur in rows], "company_id long, person_id long, start_month date, end_month date, is_current boolean")


def anchors(spark, rows):
    full = [(c, i, day(m), lo, p, hi, k, t, conf, src) for c, i, m, lo, p, hi, k, t, conf, src in rows]
    return spark.createDataFrame(full, "company_id long, anchor_id string, anchor_month date, value_min double, value_point double, value_max double, kind string, anchor_type string, confidence double, source_name string")


def events(spark, rows):
    return spark.createDataFrame([(c, t, day(m)) for c, t, m in rows], "company_id long, event_type string, event_month date")


def test_profile_counts_once_a_person_and_open_ends(spark):
    rows = [(1, 1, "2020-01-01", "2020-03-01", False), (1, 1, "2020-02-01", "2020-04-01", False), (1, 2, "2020-03-01", None, True), (1, 3, "2020-05-01", None, False), (1, 4, "2019-01-01", "2019-12-01", False)]
    got = S.profile_counts(intervals(spark, rows), companies(spark, 1, 2), WINDOW).orderBy("company_id", "month").collect()
    assert [r.profiles for r in got if r.company_id == 1] == [1, 1, 2, 2, 2, 1]
    assert [r.profiles for r in got if r.company_id == 2] == [0] * 6


def test_profile_counts_agree_with_explode(spark):
    import random

    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a, b = rng.randint(1, 6), rng.randint(1, 6)
        a, b = min(a, b), max(a, b)
        rows.append((rng.randint(1, 3), rng.randint(1, 20), f"2020-0{a}-01", f"2020-0{b}-01", False))
    df = intervals(spark, rows)
    delta = {(r.company_id, r.month): r.profiles for r in S.profile_counts(df, companies(spark, 1, 2, 3), WINDOW).collect()}
    exploded = df.withColumn("month", F.explode(F.sequence("start_month", "end_month", F.expr("interval 1 month")))).groupBy("company_id", "month").agg(F.count_distinct("person_id").alias("n"))
    assert {k: v for k, v in delta.items() if v} == {(r.company_id, r.month): r.n for r in exploded.collect()}


def test_segments_split_at_breaks(spark):
    ev = events(spark, [(1, "acquisition", "2020-03-01"), (1, "layoff", "2020-03-01"), (1, "rebrand", "2020-04-01"), (1, "merger", "2020-01-01"), (1, "merger", "2021-01-01")])
    got = S.segments(ev, companies(spark, 1, 2), WINDOW).orderBy("company_id", "segment_no").collect()
    assert [(r.segment_start, r.segment_end, r.opening_types) for r in got if r.company_id == 1] == [(day("2020-01-01"), day("2020-02-01"), ["merger"]), (day("2020-03-01"), day("2020-06-01"), ["acquisition", "layoff"])]
    assert [(r.segment_start, r.segment_end) for r in got if r.company_id == 2] == [(day("2020-01-01"), day("2020-06-01"))]


def placed(spark, rows):
    segs = S.segments(events(spark, []), companies(spark, 1), WINDOW)
    return S.anchors_in_segments(anchors(spark, rows), segs)


def test_reconcile_keeps_top_tier_and_drops_buckets(spark):
    rows = [(1, "a", "2020-02-01", 90.0, 100.0, 110.0, "range", "historical_statement", 0.6, "x"), (1, "b", "2020-04-01", 200.0, 200.0, 200.0, "exact", "historical_statement", 0.2, "y"), (1, "c", "2020-04-01", 10.0, 500.0, 1000.0, "bucket", "historical_statement", 0.9, "y"), (1, "d", "2020-04-01", 1.0, 1.0, 1.0, "exact", "current_headcount_anchor", 1.0, "z")]
    r = S.reconcile_anchors(placed(spark, rows)).collect()[0]
    assert r.value_point == pytest.approx((100 * 0.6 + 200 * 0.2) / 0.8)
    assert (r.value_min, r.value_max, r.n_top, r.n_point) == (10.0, 1000.0, 3, 2)
    assert r.anchor_month == day("2020-03-01")  # half-way between two month numbers: the even one
    assert sum(r.weights) == pytest.approx(1)


def test_reconcile_without_weight_takes_the_latest(spark):
    rows = [(1, "a", "2020-02-01", 1.0, 1.0, 1.0, "exact", "manual_anchor", 0.0, "x"), (1, "b", "2020-05-01", 7.0, 7.0, 7.0, "exact", "manual_anchor", 0.0, "x")]
    r = S.reconcile_anchors(placed(spark, rows)).collect()[0]
    assert (r.value_point, r.anchor_month, r.contributing_ids) == (7.0, day("2020-05-01"), ["b"])


def run(spark, employment, anchor_rows, event_rows=(), config=EstimateConfig()):
    comp = companies(spark, 1)
    segs = S.segments(events(spark, list(event_rows)), comp, WINDOW)
    counts = S.profile_counts(intervals(spark, employment), comp, WINDOW)
    where = S.anchors_in_segments(anchors(spark, anchor_rows), segs)
    return segs, where, S.monthly_series(segs, counts, where, S.reconcile_anchors(where), WINDOW, config)


ANCHOR = (1, "a", "2020-06-01", 90.0, 100.0, 120.0, "range", "current_headcount_anchor", 0.5, "x")


def test_series_scales_by_corrected_counts(spark):
    people = [(1, p, "2020-01-01" if p < 8 else "2020-06-01", "2020-06-01", False) for p in range(10)]
    _, _, series = run(spark, people, [ANCHOR])
    rows = {r.month: r for r in series.collect()}
    first = rows[day("2020-01-01")]
    ratio = (8 / (0.55 + 0.3 * 5 / 6)) / (10 / 0.55)
    assert first.value_point == pytest.approx(100 * ratio) and first.method == "scaled_ratio_coverage_corrected"
    assert rows[day("2020-06-01")].value_point == pytest.approx(100)
    assert all(r.value_min <= r.value_point <= r.value_max for r in rows.values()) and len(rows) == 6


def test_series_flat_suppressed_zero_and_interpolated(spark):
    few = [(1, p, "2020-01-01", "2020-06-01", False) for p in range(3)]
    assert {r.method for r in run(spark, few, [ANCHOR])[2].collect()} == {"suppressed_low_sample"}
    late = [(1, p, "2020-01-01", "2020-02-01", False) for p in range(9)]
    flat = run(spark, late, [ANCHOR])[2].collect()
    assert {(r.method, r.value_point) for r in flat} == {("degraded_current_only", 100.0)}
    none = run(spark, late, [])[2].collect()
    assert {(r.suppression_reason, r.value_point) for r in none} == {("no_anchor_in_segment", 0.0)}
    two = [(1, "a", "2020-02-01", 80.0, 100.0, 120.0, "range", "manual_anchor", 0.5, "x"), (1, "b", "2020-04-01", 200.0, 200.0, 200.0, "exact", "manual_anchor", 0.5, "x")]
    got = {r.month: r for r in run(spark, [], two)[2].collect()}
    assert got[day("2020-03-01")].value_point == pytest.approx(150) and got[day("2020-03-01")].value_min == pytest.approx(140)
    assert got[day("2020-01-01")].suppression_reason == "extrapolated_beyond_anchor_range" and got[day("2020-06-01")].value_point == 200
    assert got[day("2020-03-01")].contributing_ids == ["a", "b"]


def test_anomalies_and_scores(spark):
    two = [(1, "a", "2020-02-01", 10.0, 100.0, 200.0, "range", "manual_anchor", 0.5, "x"), (1, "b", "2020-04-01", 300.0, 300.0, 300.0, "exact", "manual_anchor", 0.5, "y")]
    segs, where, series = run(spark, [], two)
    breaks = C.break_months(segs)
    series = series.withColumn("suppressed_by", F.lit(None).cast("string"))
    scored = C.confidence(C.anomalies(series, breaks), where, breaks, WINDOW)
    rows = {r.month: r for r in scored.collect()}
    feb, mar = rows[day("2020-02-01")], rows[day("2020-03-01")]
    assert feb.interval_too_wide and not feb.mom_jump and mar.mom_jump
    assert mar.reasons[-1].startswith("mom_jump=1.00>")
    # quality 1, nearest anchor 0 months, spread over 1, no profiles, no breaks, two sources
    assert feb.score == pytest.approx(0.25 + 0.2 + 0.0 + 0 + 0.1 + 0.1)
    assert {r.score_band for r in rows.values()} <= {"medium", "low", "manual_review_required"}


def stored(spark, rows):
    return spark.createDataFrame([(c, day(m), lo, p, hi, me, b) for c, m, lo, p, hi, me, b in rows], "company_id long, month date, value_min double, value_point double, value_max double, method string, band string")


def test_growth_propagates_intervals_and_says_why_not(spark):
    ok = "scaled_ratio_coverage_corrected"
    df = stored(spark, [(1, "2019-12-01", 90.0, 100.0, 110.0, ok, "high"), (1, "2020-06-01", 100.0, 150.0, 160.0, ok, "low"), (2, "2020-06-01", 1.0, 1.0, 1.0, ok, "high")])
    g = G.growth_series(df).collect()
    assert len(g) == 1 and g[0].horizon == "6m"
    assert (g[0].growth_point, g[0].growth_min, g[0].growth_max) == pytest.approx((0.5, 100 / 110 - 1, 160 / 90 - 1))
    w = {(r.company_id, r.horizon): r for r in G.growth_windows(df).collect()}
    assert w[1, "6m"].band == "low" and w[1, "1y"].suppressed_reason == "no_start_month" and len(w) == 6


def test_events_merge(spark):
    rows = [(1, "merger", day("2020-01-01"), "e1", "press", 0.9, None, dt.datetime(2020, 1, 1)), (1, "merger", day("2020-01-01"), "e2", "manual", 0.2, " ", dt.datetime(2020, 1, 2)), (1, "merger", day("2020-01-01"), "e3", "benchmark", 1.4, "told", dt.datetime(2020, 1, 2))]
    df = spark.createDataFrame(rows, "company_id long, event_type string, event_month date, event_id string, source_class string, confidence double, description string, created_at timestamp")
    r = EV.merge_events(df).collect()
    assert len(r) == 1 and (r[0].event_id, r[0].confidence, r[0].description, r[0].merged) == ("e2", 1.0, "told", 3)


def test_overrides_decode_and_reject(spark):
    rows = [("p", "current_anchor", '{"anchor_month": "2020-01-01", "value_min": 1, "value_point": 2, "value_max": 3}', None), ("q", "current_anchor", '{"anchor_month": "2020-01-01"}', None), ("e", "event_segment", '{"event_month": "2020-02-01", "event_type": "nonsense"}', None), ("x", "estimate_suppress_window", '{"start_month": "2020-01-01", "end_month": "2020-02-01"}', dt.datetime(2019, 1, 1))]
    df = spark.createDataFrame([(1, i, f, p, None, x, dt.datetime(2019, 1, 1)) for i, f, p, x in rows], "company_id long, override_id string, field_name string, payload string, reason string, expires_at timestamp, created_at timestamp")
    d = OV.decode(df, F.lit("2020-01-01").cast("timestamp"))
    assert [r.confidence for r in d["pins"].collect()] == [1.0] and d["windows"].count() == 0
    assert [r.event_type for r in d["events"].collect()] == ["acquisition"]
    assert [(r.override_id, r.reject_reason) for r in d["rejected"].collect()] == [("q", "missing:value_min,value_point,value_max")]


def test_queue_upsert_and_transitions(spark):
    q = spark.createDataFrame([(1, "anomaly", "v", 60, "open", "old", None, None), (2, "anomaly", "v", 60, "resolved", "old", None, None)], "company_id long, reason string, version_id string, priority int, status string, detail string, assignee string, updated_at timestamp")
    new = spark.createDataFrame([(1, "anomaly", "v", 70, "new"), (2, "anomaly", "v", 70, "new"), (3, "manual", None, 30, "n")], "company_id long, reason string, version_id string, priority int, detail string")
    now = F.lit("2020-01-01").cast("timestamp")
    after = R.upsert(q, new, now)
    assert {(r.company_id, r.action, r.detail) for r in after.collect()} == {(1, "refreshed", "new"), (2, "skipped", "old"), (3, "inserted", "n")}
    again = R.upsert(after.drop("action"), new, now)
    assert {r.action for r in again.collect()} == {"skipped"}
    req = spark.createDataFrame([(1, 1, "anomaly", "v", "assigned", None), (2, 1, "anomaly", "v", "assigned", "kim"), (3, 9, "anomaly", "v", "open", None)], "request_no long, company_id long, reason string, version_id string, to_status string, assignee string")
    t = R.apply_transitions(q, req, now)
    assert {r.request_no: r.outcome for r in t["audit"].collect()} == {1: "assignee_required", 2: "applied", 3: "no_such_item"}
    assert {r.company_id: (r.status, r.assignee) for r in t["queue"].collect()} == {1: ("assigned", "kim"), 2: ("resolved", None)}


def test_spearman_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 2.0, 3.0), ("a", 5.0, 9.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "k string, x double, y double")
    got = {r.k: r.rho for r in E.spearman(df, ["k"], "x", "y").collect()}
    assert got["b"] is None and got["c"] is None and got["a"] == pytest.approx(0.9486832980505138)


def test_expectations(spark):
    s = stored(spark, [(1, "2020-01-01", 1.0, 10.0, 20.0, "m", "high")])
    exp = spark.createDataFrame([(1, day("2020-01-01"), 10.9, 0.01), (1, day("2020-02-01"), 1.0, 0.1)], "company_id long, month date, value_point double, tolerance double")
    assert sorted(r.verdict for r in E.expectation_diff(exp, s).collect()) == ["missing", "ok"]
    assert EvaluationConfig().top == 25


@pytest.mark.parametrize(("age", "value"), [(0, 0.55), (3, 0.70), (6, 0.85), (36, 0.85), (66, 0.60), (200, 0.35)])
def test_coverage_curve(spark, age, value):
    assert spark.range(1).select(X.coverage_at(F.lit(age))).first()[0] == pytest.approx(value)


VALUES = [("1,000-5,000", (1000, 3000, 5000, "range")), ("500-201", (201, 350.5, 500, "range")), ("10,001+", (10001, 10001, 20002, "bucket")), ("42", (42, 42, 42, "exact")), ("n/a", None), ("-3", None), ("", None), (None, None)]
MONTHS = [("2023-08-15", "2023-08-01", False), ("08/2023", "2023-08-01", False), ("Aug. 2023", "2023-08-01", False), ("September, 2020", "2020-09-01", False), ("Q4 '23", "2023-10-01", True), ("2019", "2019-01-01", True), ("present", None, None), ("13/2020", None, None), ("Foo 2020", None, None), (None, None, None)]


def test_text_readers(spark):
    v = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VALUES)], "i int, t string").withColumn("v", T.size_value("t")).orderBy("i").collect()
    assert [tuple(r.v) if r.v else None for r in v] == [x for _, x in VALUES]
    m = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(MONTHS)], "i int, t string").withColumn("v", T.month_text("t", 2030)).orderBy("i").collect()
    assert [(str(r.v.month), r.v.reduced) if r.v else (None, None) for r in m] == [(x, y) for _, x, y in MONTHS]
    r = spark.createDataFrame([("Aug 2021 - Dec 2023",), ("2020-01 to present",), ("Dec 2023 - Aug 2021",), ("2020",)], "t string").withColumn("v", T.month_range("t", 2030)).collect()
    assert [(str(x.v.start), str(x.v.end), x.v.end_open) if x.v else None for x in r] == [("2021-08-01", "2023-12-01", False), ("2020-01-01", "None", True), None, None]
    n = spark.createDataFrame([("Acmé  Holdings, Inc.", "https://www.Acme.com/x", "https://linkedin.com/company/Acme-Co/"), ("Inc", " ", "a/b")], "name string, domain string, url string").select(T.name_key("name").alias("n"), T.domain_key("domain").alias("d"), T.profile_slug("url").alias("s"), T.legal_suffix("name").alias("l")).collect()
    assert tuple(n[0]) == ("acme", "acme.com", "acme-co", "Holdings, Inc.") and tuple(n[1]) == ("inc", None, None, None)
    s = spark.createDataFrame([("We have over 500 employees and a team of 40. A 50-person team, 200+ strong. Headcount: 75",)], "t string").select(F.explode(T.size_mentions("t")).alias("m")).collect()
    assert [(x.m.qualifier, x.m.value_point) for x in s] == [("over", pytest.approx(550)), ("team of", 40), ("n-person", 50), ("strong", pytest.approx(220)), ("headcount", 75)]
    g = spark.createDataFrame([("6 month growth 12% 1 year growth: -5% 6 months growth 20% 2 year growth 900%",)], "t string").select(T.growth_trends("t").alias("g")).first().g
    assert g == {6: 20.0, 12: -5.0}


def test_median_and_ranks_agree_with_plain_python(spark):
    import random
    import statistics

    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 0.0, 1.0, rng.random()]), rng.choice([0.5, rng.random()])) for _ in range(400)] + [("c", 1.0, 2.0), ("d", 1.0, 3.0), ("d", 4.0, 3.0)]
    df = spark.createDataFrame(rows, "provider string, x double, y double")
    got = {r.provider: r.m for r in E.exact_median(df, ["provider"], "x", "m").collect()}
    assert got == pytest.approx({p: statistics.median(x for q, x, _ in rows if q == p) for p, *_ in rows})
    rho = {r.provider: r.rho for r in E.spearman(df, ["provider"], "x", "y").collect()}
    assert rho["c"] is None and rho["d"] is None

    def ranks(v):
        s = sorted(v)
        return [s.index(x) + (s.count(x) + 1) / 2 for x in v]

    for p in ("a", "b", None):
        rx, ry = ranks([x for q, x, _ in rows if q == p]), ranks([y for q, _, y in rows if q == p])
        assert rho[p] == pytest.approx(statistics.correlation(rx, ry))
