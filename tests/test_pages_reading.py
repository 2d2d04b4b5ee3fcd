import datetime as dt

from pyspark.sql import functions as F

from rosterlake.operators import pages as P
from rosterlake.operators import reading as R


def test_result_slugs(spark):
    body = 'a href="https://www.linkedin.com/company/Acme-Co/" x <a href="/ck/a?u=https%3A%2F%2Flinkedin.com%2Fcompany%2Fbeta&x"> https://linkedin.com/company/showcase l/?uddg=https%3A%2F%2Fwww.linkedin.com%2Fcompany%2Facme-co%2F'
    df = spark.createDataFrame([(body,), (None,)], "body string")
    assert [r.s for r in df.select(P.result_slugs("body").alias("s")).collect()] == [["acme-co", "beta"], []]


def test_judged_pages(spark):
    t = "<title>{} | LinkedIn</title>"
    rows = [(1, "Arable", "arable.com", t.format("Arable Consulting")), (2, "Arable", "arable.com", t.format("Arable") + "see arable.com"), (3, "Arable", "arable.com", t.format("Arable")), (4, "Big Farm", None, t.format("Big Farm Ltd")), (5, "Foo", None, t.format("Bar")), (6, None, None, None)]
    got = {r.company_id: (r.accepted, r.reason) for r in P.judged_pages(spark.createDataFrame(rows, "company_id long, name string, domain string, body string")).collect()}
    assert got == {1: (False, "ambiguous_qualifier:consulting"), 2: (True, "domain_in_body"), 3: (False, "single_token_no_domain_in_body"), 4: (True, "ok"), 5: (False, "no_token_overlap"), 6: (False, "no_token_overlap")}


def test_reading(spark):
    comp = spark.createDataFrame([(i, f"c{i}", f"P{i % 2}") for i in range(6)], "company_id long, name string, tier string")
    assert [r.company_id for r in R.company_page(comp, "P1", 2, 1).collect()] == [3, 5]
    s = spark.createDataFrame([(i, dt.date(2020, m, 1)) for i in range(2) for m in range(1, 5)], "company_id long, month date")
    assert R.series_range(s, comp.where("company_id = 1"), "2020-02-01", "2020-03-01").count() == 2
    o = spark.createDataFrame([("a", 1, "current_anchor", '{"anchor_month": "2020-01-01", "value_point": 5}', "r", None)], "override_id string, company_id long, field_name string, payload string, reason string, expires_at timestamp")
    r = R.flat_overrides(o, F.lit("2020-01-01").cast("timestamp")).first()
    assert r.active and r.value_point == 5.0 and r.event_type is None


def test_logs_and_flat_rows(spark):
    import datetime as dt

    from rosterlake.operators import reading as RD

    at = lambda d: dt.datetime(2020, 1, d)
    audit = spark.createDataFrame([(f"a{d}", "version" if d % 2 else "override", f"t{d % 3}", at(d)) for d in range(1, 10)], "audit_id string, target_type string, target_id string, created_at timestamp")
    assert [r.audit_id for r in RD.audit_log(audit, limit=3).collect()] == ["a9", "a8", "a7"]
    assert [r.audit_id for r in RD.audit_log(audit, "version", "t1").collect()] == ["a7", "a1"]
    runs = spark.createDataFrame([(i, "full" if i % 2 else "part", "done", at(i)) for i in range(1, 6)], "run_id int, kind string, status string, started_at timestamp")
    assert [r.run_id for r in RD.runs(runs, "full", 2).collect()] == [5, 3] and RD.runs(runs).count() == 5
    statuses = spark.createDataFrame([(1, 7, "fetch", "failed", "no route"), (1, 8, "fetch", "succeeded", None), (1, 9, "fetch", "succeeded", None)], "run_id int, company_id int, stage string, status string, error string")
    detail = {r.run_id: r for r in RD.run_detail(runs, statuses).collect()}
    assert [tuple(x) for x in detail[1].stages] == [("fetch", "failed", 1), ("fetch", "succeeded", 2)] and [tuple(x) for x in detail[1].failures] == [(7, "fetch", "no route")]
    assert detail[2].stages is None
    done = spark.createDataFrame([(f"e{d}", at(d), "{}") for d in (2, 5, 3)], "evaluation_id string, evaluated_at timestamp, scoreboard string")
    assert [r.evaluation_id for r in RD.evaluation_history(done, 2).collect()] == ["e5", "e3"] and "scoreboard" not in RD.evaluation_history(done).columns
    assert RD.evaluation_detail(done).first().evaluation_id == "e5" and RD.evaluation_detail(done, "e2").first().scoreboard == "{}" and RD.evaluation_detail(done, "no").count() == 0
    nested = spark.sql("select 1 as company_id, cast(null as string) as name, array(struct('2020-01' as month, 5 as n), struct('2020-02' as month, 6 as n)) as matches")
    assert sorted(map(tuple, RD.flat_comparison(nested).collect())) == [(1, "1", "2020-01", 5), (1, "1", "2020-02", 6)]
    months = nested.withColumnRenamed("matches", "months")
    assert RD.flat_series(months).count() == 2
