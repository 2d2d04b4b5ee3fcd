"""Registered queries of the readers of text and pages, over part, pages, supplier and lineitem.

Texts are put together from row numbers in the phrasings that the readers must
know; the SQL states what each phrasing means instead of reading it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import text as T
from rosterlake.operators import evidence as X
from rosterlake.operators import pages as P
from rosterlake.operators import promotion as PR
from rosterlake.operators import resolution as RS
from rosterlake.plans import adapters as A
from rosterlake.plans import jobs as J
from rosterlake.plans.oracle import sql
from rosterlake.plans.queries import query, rounded


def phrase(number: Column, *templates: str, **values: Column) -> Column:
    """The template that `number` modulo their count picks, with {name} replaced by the text of a value."""
    out = F.element_at(F.array(*map(F.lit, templates)), (number % len(templates)).cast("int") + 1)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


@query("""SELECT p_partkey AS row_id,
  CASE WHEN k IN (0, 1, 4) THEN a WHEN k = 6 THEN 5 END AS pct_6m, CASE WHEN k IN (0, 1) THEN -b WHEN k IN (2, 3) THEN b + 0.5 WHEN k = 6 THEN 2 END AS pct_1y,
  CASE WHEN k = 3 THEN a WHEN k = 1 THEN -a END AS pct_2y
FROM (SELECT p_partkey, p_partkey % 7 AS k, p_size::DOUBLE AS a, (p_partkey % 90)::DOUBLE AS b FROM part)""")
def growth_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    a, b = F.col("p_size"), F.col("p_partkey") % 90
    said = phrase(
        F.col("p_partkey"), "6m +{a}% 1y -{b}%", "6 months growth {a}% 1 year growth: -{b}% 2 years - {a}", "1Y {b}.5", "1 yeaR growth {b}.5% 2y: {a} %", "6 month growth {a}% 2y +900%",
        "grew a lot in 7 months", "6m 3 6m 5 1y +2", a=a, b=b,
    )
    rows = part.select(F.col("p_partkey").alias("row_id"), T.growth_trends(said).alias("t"))
    at = lambda k: F.try_element_at("t", F.lit(k))
    return rows.select("row_id", at(6).alias("pct_6m"), at(12).alias("pct_1y"), at(24).alias("pct_2y"))


@query("""SELECT p_partkey AS row_id, CASE k WHEN 0 THEN 51 WHEN 1 THEN 1001 WHEN 2 THEN 10001 WHEN 3 THEN n END AS low,
  CASE k WHEN 0 THEN 200 WHEN 1 THEN 5000 WHEN 2 THEN 50005 WHEN 3 THEN n + 40 END AS high,
  CASE k WHEN 0 THEN '51-200' WHEN 1 THEN '1,001-5,000' WHEN 2 THEN '10001-50005' WHEN 3 THEN CASE n WHEN 11 THEN '11-51' ELSE n || '-' || (n + 40) END END AS size_class,
  CASE k WHEN 0 THEN 200 WHEN 1 THEN 5000 WHEN 3 THEN n + 40 WHEN 4 THEN 1000 + n WHEN 5 THEN n + 10 END AS exact
FROM (SELECT p_partkey, p_partkey % 7 AS k, p_size AS n FROM part)""")
def badge_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    n = F.col("p_size")
    text = phrase(
        F.col("p_partkey"), "Company size 51-200 employees", "Company size: 1,001 to 5,000 employees", "Employees 10,001+ employees", "Company size about {n}–{m} employees",
        "1,{p} associated members", "See all {q} employees", "1 member", n=n, m=n + 40, q=n + 10, p=F.lpad(n.cast("string"), 3, "0"),
    )
    rows = part.select(F.col("p_partkey").alias("row_id"), T.size_badge(text).alias("b"), T.exact_count(text).alias("exact"))
    label = F.when(F.col("b").isNotNull(), T.size_class("b.low", "b.high"))
    return rows.select("row_id", F.col("b.low").cast("int").alias("low"), F.col("b.high").cast("int").alias("high"), label.alias("size_class"), F.col("exact").cast("int").alias("exact"))


@query("""SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'bot_wall' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'forbidden' WHEN 3 THEN 'auth_required' WHEN 4 THEN 'login_redirect'
  WHEN 5 THEN 'marker:authwall' WHEN 6 THEN 'marker:unusual_activity' WHEN 7 THEN 'marker:please_verify_you_are_a_human' WHEN 8 THEN 'marker:join_linkedin_to_see' WHEN 9 THEN 'marker:sign_in_to_see' WHEN 10 THEN 'marker:captcha' END AS reason FROM pages""")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 12
    status = F.element_at(F.array(*map(F.lit, (999, 429, 403, 401, *[200] * 8))), k.cast("int") + 1)
    url = F.when(k == 4, "https://x.example/authwall?to=1").otherwise("https://x.example/company/login")
    text = phrase(F.col("page_id"), *[""] * 5, "The AuthWall", "We saw Unusual Activity.", "Please verify you are a human", "Join LinkedIn to see more", "sign in to see more, or the captcha", "unusual activity, a Captcha", "sign in")
    return A.table(spark, sf_dir, "pages").select("page_id", T.gate_reason(status, url, text).alias("reason"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'firm-' || page_id WHEN 1 THEN 'firm-' || page_id || ',other' WHEN 2 THEN '' WHEN 3 THEN 'beta-' || page_id ELSE '' END AS slugs FROM pages""")
def search_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = phrase(
        F.col("page_id"), '<a href="https://www.linkedin.com/company/Firm-{n}/"> https://linkedin.com/company/showcase https://linkedin.com/company/linkedin',
        '<a href="https://linkedin.com/company/firm-{n}"> <a href="/ck/a?u=https%3A%2F%2Flinkedin.com%2Fcompany%2Fother&p=1">', "https://linkedin.com/in/person-{n}",
        "l/?uddg=https%3A%2F%2Fwww.linkedin.com%2Fcompany%2Fbeta-{n}%2F linkedin.com/company/company", "https://linkedin.com/company/firm-{n} solve the reCAPTCHA", n=F.col("page_id"),
    )
    return A.table(spark, sf_dir, "pages").select("page_id", F.array_join(P.result_slugs(body), ",").alias("slugs"))


@query("""WITH said AS (SELECT s_suppkey AS k, kind, s_suppkey + step AS n FROM supplier, (VALUES ('acquired', 0), ('acquired', 1), ('acquired', 1), ('acquired', 2), ('acquired', 3), ('renamed', 1), ('renamed', 2)) AS v(kind, step))
SELECT DISTINCT n AS parent_id, k AS child_id, kind, NULL::VARCHAR AS unresolved FROM said WHERE n <> k AND n IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT NULL, k, kind, 'Firm ' || n FROM said WHERE n NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT NULL, s_suppkey, 'acquired', 'Nobody ' || (s_suppkey + 1) FROM supplier""")
def note_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company has every note: three acquirers, itself and a repeat, two new names, an acquirer nobody knows, and what names no owner."""
    k = F.col("s_suppkey")
    notes = [
        ("acquisition", "Was acquired by Firm {n} in 2020.", 1), ("acquisition", "Acquired by Firm {n}. Then moved", 2), ("acquisition", "later ACQUIRED  by Firm {n}, Inc.", 3),
        ("acquisition", "acquired by Firm {n}", 0), ("acquisition", "acquired by Firm {n}", 1), ("acquisition", "acquired by Nobody {n}; ended", 1),
        ("rebrand", "since renamed to Firm {n} during 2019", 1), ("rebrand", "Rebranded as Firm {n} on 1 May", 2),
        ("acquisition", "now part of the merger of Firm {n}", 4), ("acquisition", "building owned by Firm {n}, renamed to Firm {n}", 4), ("rebrand", "acquired by Firm {n}", 4), ("merger", "acquired by Firm {n}", 4),
    ]
    event = lambda hint, note, step: F.struct(F.lit(hint).alias("hint_type"), phrase(k, note, n=k + step).alias("note"))
    s = A.table(spark, sf_dir, "supplier")
    companies = s.select(k.alias("company_id"), F.concat(F.lit("Firm "), k.cast("string"), F.lit(" LLC")).alias("name"))
    events = s.select(k.alias("company_id"), F.explode(F.array(*(event(*x) for x in notes))).alias("e")).select("company_id", "e.*")
    got = RS.relations(events, companies)
    unresolved = got["unresolved"].select(F.lit(None).cast("long").alias("parent_id"), F.col("company_id").alias("child_id"), "kind", F.col("parent_name").alias("unresolved"))
    return got["edges"].withColumn("unresolved", F.lit(None).cast("string")).unionByName(unresolved)


@query("""WITH p AS (SELECT p_partkey AS row_id, p_partkey % 9 AS k, (p_size + 100)::DOUBLE AS n FROM part)
SELECT row_id, ['over', 'about', 'exact', 'team of', 'n-person', 'strong', 'strong', 'headcount', 'over'][k + 1] AS family, CASE WHEN k IN (2, 7) THEN 'exact' ELSE 'range' END AS kind,
  round(n * [1, 0.9, 1, 0.9, 0.9, 1, 1, 1, 1][k + 1], 6) AS value_min, round(n * [1.1, 1, 1, 1, 1, 1.1, 1, 1, 1.1][k + 1], 6) AS value_point, round(n * [1.25, 1.1, 1, 1.15, 1.1, 1.25, 1.1, 1, 1.25][k + 1], 6) AS value_max FROM p""")
def size_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size statements of every family, one of them with a bare count that only repeats it."""
    n = F.col("p_size") + 100
    said = phrase(
        F.col("p_partkey"), "We are over {n} employees.", "nearly {n} Team  Members", "{n} colleagues", "a crew of {n} enthusiasts", "our {n}-person team", "{n}+ strong", "{n} strong", "Headcount: {n}",
        "more than {n} staff, yes, {n} staff", n=n,
    )
    rows = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.explode(T.size_mentions(said)).alias("m"))
    return rows.select("row_id", F.col("m.qualifier").alias("family"), "m.kind", *(F.round(f"m.{c}", 6).alias(c) for c in ("value_min", "value_point", "value_max")))


@query("""SELECT c_custkey AS row_id, CASE c_custkey % 5 WHEN 0 THEN 'firm-' || c_custkey WHEN 1 THEN 'firm_' || c_custkey WHEN 2 THEN 'firm' || c_custkey END AS slug FROM customer""")
def profile_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of profile URLs, of bare slugs, and of what is neither."""
    k = F.col("c_custkey")
    text = phrase(k, "https://www.linkedin.com/company/Firm-{n}/about?x=1", " Firm_{n} ", "linkedin.com/company/firm{n}#top", "https://example.com/firm-{n}", "", n=k)
    return A.table(spark, sf_dir, "customer").select(k.alias("row_id"), T.profile_slug(text).alias("slug"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'ambiguous_qualifier:consulting' WHEN 2 THEN 'domain_in_body' WHEN 3 THEN 'single_token_no_domain_in_body' WHEN 4 THEN 'no_token_overlap' ELSE 'ok' END AS reason,
  page_id % 6 IN (0, 2, 5) AS accepted FROM pages""")
def judged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles before real page bodies: shared words, qualifiers, domains that the body mentions or does not."""
    k = F.col("page_id")
    head = phrase(
        k, '<meta property="og:title" content="Qzacme Robotics Weekly | LinkedIn">', '<meta property="og:title" content="Qzacme Consulting">', '<meta property="og:title" content="Qzacme">see www.QZACME{n}.example',
        '<meta property="og:title" content="Qzacme">', '<meta property="og:title" content="Qzother">', '<meta property="og:title" content="QZACME">', n=k,
    )
    name = phrase(k, "Qzacme Robotics", *["Qzacme"] * 5)
    domain = F.when((k % 6).isin(2, 3), F.concat(F.lit("https://qzacme"), k.cast("string"), F.lit(".example/")))
    rows = A.table(spark, sf_dir, "pages").select("page_id", name.alias("name"), domain.alias("domain"), F.concat(head, "html").alias("body"))
    return P.judged_pages(rows).select("page_id", "reason", "accepted")


@query("""WITH c AS (SELECT c_custkey AS row_id, c_custkey % 4 AS k, 'acme-' || c_custkey AS h, 'acme' || c_custkey AS j FROM customer)
SELECT row_id, CASE k WHEN 0 THEN 'my-site:domain_label,' || h || '-inc:name_slug,' || j || 'inc:name_concat' WHEN 1 THEN h || ':domain_label,' || j || ':name_concat' WHEN 2 THEN j || ':domain_label'
  ELSE h || '-co-kg:name_slug,' || j || 'cokg:name_concat' END AS slugs FROM c""")
def profile_slug_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs to try for names and domains in four shapes."""
    k = F.col("c_custkey")
    name = phrase(k, "Acme {n}, Inc.", " ACME_{n} ", "acme{n}", "Acme {n} & Co. KG", n=k)
    domain = F.when(k % 4 == 0, "https://www.my_site.example.com/x").when(k % 4 == 1, F.concat(F.lit("acme-"), k.cast("string"), F.lit(".org"))).when(k % 4 == 2, F.concat(F.lit("ACME"), k.cast("string"), F.lit(".io")))
    rows = A.table(spark, sf_dir, "customer").select(k.alias("row_id"), T.slug_candidates(domain, name).alias("c"))
    return rows.select("row_id", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x.slug, x.method)), ",").alias("slugs"))


_LD = '<script type="application/ld+json">{"@type": "Organization", "numberOfEmployees": {low_high}}</script>'


@query("""WITH c AS (SELECT s_suppkey AS company_id, s_suppkey % 8 AS k, (s_suppkey % 500 + 20)::DOUBLE AS n FROM supplier)
SELECT company_id, 'json_ld_range' AS statement, 'company' AS part, n AS value_min, n + 20 AS value_point, n + 40 AS value_max, 0.5::DOUBLE AS confidence, NULL AS reason FROM c WHERE k IN (0, 1)
UNION ALL SELECT company_id, 'badge', 'company', n, n + 20, n + 40, 0.45::DOUBLE, NULL FROM c WHERE k = 2
UNION ALL SELECT company_id, 'json_ld_exact', 'about', n, n, n, 0.6::DOUBLE, NULL FROM c WHERE k = 3
UNION ALL SELECT company_id, 'exact', 'people', n + 3, n + 3, n + 3, 0.35::DOUBLE, NULL FROM c WHERE k IN (0, 1, 2)
UNION ALL SELECT company_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE k WHEN 4 THEN 'marker:authwall' WHEN 5 THEN 'bot_wall' ELSE 'marker:captcha' END FROM c WHERE k IN (4, 5, 6)""")
def profile_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By company: 0, 1 JSON-LD behind a gate's words; 2 a badge; 3 only on the about page, people page gated; 4 to 6 gated; 7 nothing."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey") % 500 + 20
    ranged, exact = (_LD.replace("{low_high}", x) for x in ('{"minValue": {n}, "maxValue": {m}}', "{n}"))
    fill = {"n": n, "m": n + 40, "q": n + 3}
    company = phrase(k, f"sign in to see {ranged}", ranged, "<p>Company size {n}-{m} employees</p>", "nothing", "<p>AuthWall</p>", ranged, "open", "open", **fill)
    about = phrase(k, exact, exact, exact, exact, exact, exact, "a captcha", "open", **fill)
    people = phrase(k, *["{q} associated members"] * 3, "authwall {q} members", *["{q} members"] * 4, **fill)
    row = lambda part, status, html: F.struct(F.lit(part).alias("part"), F.lit("https://x.example/p").alias("url"), status.alias("status"), html.alias("html"))
    fine = F.lit(200)
    parts = F.array(row("company", F.when(k % 8 == 5, 999).otherwise(200), company), row("about", fine, about), row("people", fine, people))
    pages = A.table(spark, sf_dir, "supplier").select(k.alias("company_id"), F.explode(parts).alias("p")).select("company_id", "p.*")
    got = X.profile_signals(pages)
    columns = ["company_id", "statement", "part", "value_min", "value_point", "value_max", "confidence"]
    signals = got["signals"].select(*columns, F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast(signals.schema[c].dataType).alias(c) for c in columns[1:]]
    return signals.unionByName(got["gates"].select("company_id", *none, "reason"))


@query("""WITH c AS (SELECT s_suppkey AS company_id, s_suppkey % 4 AS k, (s_suppkey % 500 + 20)::DOUBLE AS n FROM supplier)
SELECT company_id, '/' AS path, 'json_ld' AS statement, n AS value_point, 0.7::DOUBLE AS confidence, NULL AS reason FROM c WHERE k = 0
UNION ALL SELECT company_id, '/about', 'exact', n, 0.65::DOUBLE, NULL FROM c WHERE k = 1
UNION ALL SELECT company_id, '/team', 'range', n, 0.55::DOUBLE, NULL FROM c WHERE k = 2
UNION ALL SELECT company_id, NULL, NULL, NULL, NULL, 'forbidden' FROM c WHERE k = 3""")
def site_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_suppkey") % 500 + 20
    start = phrase(k, _LD.replace("{low_high}", "{n}"), "welcome", "<p>welcome back</p>", "{n} employees", n=n)
    about = phrase(k, "about {n} employees", "<p>we have {n} employees.</p>", "hello", "x", n=n)
    team = phrase(k, "over 9 staff", "a team of {n}", "a team of {n}", "x", n=n)
    row = lambda path, html: F.struct(F.lit(path).alias("path"), F.when(k % 4 == 3, 403).when((k % 4 == 2) & F.lit(path == "/about"), 404).otherwise(200).alias("status"), html.alias("html"))
    parts = F.array(row("/", start), row("/about", about), row("/team", team))
    pages = A.table(spark, sf_dir, "supplier").select(k.alias("company_id"), F.explode(parts).alias("p")).select("company_id", "p.*")
    got = X.site_signals(pages)
    signals = got["signals"].select("company_id", "path", "statement", "value_point", "confidence", F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast(signals.schema[c].dataType).alias(c) for c in ("path", "statement", "value_point", "confidence")]
    return signals.unionByName(got["gates"].select("company_id", *none, "reason"))


@query("""WITH f AS (SELECT p_partkey AS company_id, u AS i, p_size * 100 + u AS val FROM part, (SELECT unnest(range(7)) AS u))
SELECT company_id, CASE i % 4 WHEN 0 THEN 'EmployeeNumberOfEmployees' WHEN 1 THEN 'NumberOfEmployees' WHEN 2 THEN 'EntityNumberOfEmployees' ELSE 'EmployeeEquivalentsFullTimeAndPartTimeTotalNumberOfEmployees' END AS concept,
  strftime(DATE '2010-12-31' + to_years(i::INT), '%Y-%m-%d') AS "end", val::DOUBLE AS value FROM f WHERE i >= 2""")
def filing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five of seven yearly counts in four concepts, beside share counts that are none."""
    part = A.table(spark, sf_dir, "part")
    fact = lambda i: F.to_json(F.struct(F.lit(f"{2010 + i}-12-31").alias("end"), (F.col("p_size") * 100 + i).alias("val"), F.lit(f"{2011 + i}-02-01").alias("filed")))
    concept = lambda name, rows: F.concat(F.lit(f'"{name}": {{"units": {{"pure": ['), F.concat_ws(",", *map(fact, rows)), F.lit("]}}"))
    known = [concept(name, range(j, 7, 4)) for j, name in enumerate(X.CONCEPTS)]
    body = F.concat(F.lit('{"facts": {"dei": {'), F.concat_ws(",", *known, concept("EntityCommonStockSharesOutstanding", range(7))), F.lit("}}}"))
    return X.filing_facts(part.select(F.col("p_partkey").alias("company_id"), body.alias("body"))).select("company_id", "concept", "end", "value")


@query("""WITH p AS (SELECT page_id, page_id % 6 AS k, (page_id % 900 + 10)::DOUBLE AS n, page_id % 25 AS c FROM pages)
SELECT c AS company_id, CASE WHEN k = 2 THEN 'archive' ELSE 'company_page' END AS source_name, CASE k WHEN 0 THEN 'json_ld' WHEN 1 THEN 'exact' ELSE 'text' END AS statement, n AS value_point,
  CASE k WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.65::DOUBLE ELSE 0.45::DOUBLE END AS confidence, CASE WHEN k = 2 THEN '2015-03-01' END AS snapshot_month, count(*) AS pages
FROM p WHERE k < 3 AND c < 20 AND NOT (k = 0 AND n = 50) GROUP BY ALL""")
def archive_reextraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD, plain and archived pages of 25 hosts, 20 of them companies'; signals of 50 people by JSON-LD are stored already."""
    k, n = F.col("page_id") % 6, F.col("page_id") % 900 + 10
    host = F.concat(F.lit("https://www.c"), (F.col("page_id") % 25).cast("string"), F.lit(".example/p"), F.col("page_id").cast("string"))
    url = F.when(k == 2, F.concat(F.lit("https://archive.example/web/20150314000000/"), host)).otherwise(host)
    body = phrase(F.col("page_id"), _LD.replace("{low_high}", "{n}"), "<p>{n} employees</p>", "<p>{n} people</p>", "nothing", _LD.replace("{low_high}", "{n}"), "x", n=n)
    archive = A.table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.when(k == 4, 403).otherwise(200).alias("status"), body.alias("body"))
    ids = spark.range(20).withColumnRenamed("id", "company_id")
    companies = ids.withColumn("domain", F.concat(F.lit("c"), F.col("company_id").cast("string"), F.lit(".example")))
    nothing = spark.createDataFrame([], "company_id long, source_name string, content_hash string")
    stored = J.reextract(archive.where((k == 0) & (n == 50)), companies, nothing)
    rows = J.reextract(archive, companies, stored)
    return rows.groupBy("company_id", "source_name", "statement", "value_point", "confidence", "snapshot_month").agg(F.count("*").alias("pages"))


@query(sql("""SELECT 'benchmarks' AS stage, CASE WHEN provider = 'tertiary' THEN 'skipped_provider' WHEN value_min > value_point OR value_max < value_point THEN 'skipped_no_value' ELSE 'promoted' END AS outcome, count(*) AS n
  FROM benchmark_rows WHERE metric LIKE 'headcount%' GROUP BY ALL
UNION ALL SELECT 'profiles', CASE WHEN l_suppkey % 10 = 0 THEN 'no_company' ELSE 'no_start' END, count(*) FROM lin WHERE l_linenumber = 5 AND (l_suppkey % 10 = 0 OR l_returnflag = 'R') GROUP BY ALL
UNION ALL SELECT 'profiles', 'loaded', count(DISTINCT (l_partkey, l_suppkey, ship_month)) FROM lin WHERE l_linenumber = 5 AND l_suppkey % 10 <> 0 AND l_returnflag <> 'R'
UNION ALL SELECT 'trends', 'added', 2 * count(DISTINCT company_id) FROM (SELECT company_id FROM anchors0 WHERE anchor_type = 'current_headcount_anchor'
  UNION ALL SELECT company_id FROM benchmark_rows WHERE metric = 'headcount_current' AND provider <> 'tertiary' AND value_min <= value_point AND value_point <= value_max)""", 1))
def employment_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = A.companies(spark, sf_dir)
    trends = companies.select("company_id", T.growth_trends(phrase(F.col("company_id"), "6m +{a}% 1y -{a}%", "6 months {a} 1 year {a}", a=F.col("company_id") % 30)).alias("trends"))
    rows = A.lines(spark, sf_dir).where("l_linenumber = 5")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    profiles = rows.select(
        text("l_partkey").alias("person_source_key"), F.when(F.col("l_suppkey") % 10 != 0, text("l_suppkey")).alias("company_id"), none.alias("company_domain"),
        F.when(F.col("l_returnflag") == "R", "junk").otherwise(F.date_format("ship_month", "yyyy-MM-dd")).alias("start_month"), none.alias("end_month"), F.lit("true").alias("is_current_role"),
        none.alias("confidence"), none.alias("job_title"),
    )
    have = spark.createDataFrame([], "person_id string, company_id long, start_month date")
    known = companies.withColumn("domain", F.lit(None).cast("string"))
    return J.employment_stage(A.benchmark(spark, sf_dir), A.anchors(spark, sf_dir), profiles, have, known, trends, ("tertiary",))["counts"]


@query(sql("SELECT company_id, anchor_month, value_point FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY anchor_month DESC, anchor_id DESC) AS k FROM anchors0 WHERE anchor_type = 'current_headcount_anchor') WHERE k = 1", 1, dates=("anchor_month",)))
def latest_current_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(PR.latest_current_anchor(A.anchors(spark, sf_dir)).select("company_id", "anchor_month", "value_point"), "value_point")
