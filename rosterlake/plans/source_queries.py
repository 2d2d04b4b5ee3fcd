"""Registered queries of stores, files, exports and logs, over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import text as T
from rosterlake.operators import evaluation as E
from rosterlake.operators import evidence as X
from rosterlake.operators import growth as G
from rosterlake.operators import overrides as OV
from rosterlake.operators import promotion as PR
from rosterlake.operators import reading as RD
from rosterlake.plans import adapters as A
from rosterlake.plans import jobs as J
from rosterlake.plans.estimate import Estimate
from rosterlake.plans.incremental import refresh
from rosterlake.plans.oracle import sql
from rosterlake.plans.queries import as_of, full, now, query, rounded, stored
from rosterlake.plans.text_queries import phrase
from rosterlake.sources import analyst as AN
from rosterlake.sources import benchmarks as BM
from rosterlake.sources import exports as EX
from rosterlake.sources import tables as TB
from rosterlake.sources.buckets import BucketStore

_SERIES = ("value_min", "value_point", "value_max", "score")


@query(sql(
    "SELECT company_id, month, round(value_min, 4) AS value_min, round(value_point, 4) AS value_point, round(value_max, 4) AS value_max, method, band, round(score, 4) AS score FROM stored",
    6, dates=("month",),
))
def estimate_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of the estimates without a tenth of the anchors and without every ninth company, brought up to date: the same rows as a whole run."""
    e, path = full(spark, sf_dir), TB.scratch(spark)
    before = Estimate(e.companies.where("company_id % 9 <> 0"), e.employment, e.anchors.where("company_id % 10 <> 3"), e.events, e.overrides, e.window, e.now, e.config)
    series, prints = BucketStore(spark, f"{path}/series"), BucketStore(spark, f"{path}/fingerprints")
    refresh(before, series, prints, 16)
    rows = refresh(e, series, prints, 16)["stored"]
    return rounded(rows.select("company_id", "month", *_SERIES[:3], "method", "band", "score"), *_SERIES)


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 4 THEN 'new ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 22 = 4 THEN NULL ELSE c_nationkey END AS nation
FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 11 = 4""")
def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in 32 buckets; every eleventh is renamed (half of them lose their nation) or comes anew."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    store = BucketStore(spark, TB.scratch(spark))
    store.create(c.where("k % 3 <> 0"), ["k"], 32)
    new = c.where("k % 11 = 4").withColumn("name", F.concat(F.lit("new "), F.col("name"))).withColumn("nation", F.when(F.col("k") % 22 != 4, F.col("nation")))
    store.upsert(new)
    return store.read()


_FORMS = (
    '<script type="application/ld+json">{"@type": "Organization", "numberOfEmployees": {n}}</script>',
    "<script type='application/ld+json' id=\"x\">{\"@graph\": [{\"@type\": \"Corporation\", \"numberOfEmployees\": {\"minValue\": {n}, \"maxValue\": \"{m}\"}}]}</script>",
    '<SCRIPT type = "application/ld+json">[{"@type": ["Thing", "LocalOrganization"], "numberOfEmployees": {"value": "{n}"}}]</SCRIPT>',
    '<script type="application/ld+json">{"@type": "Person", "numberOfEmployees": {n}}</script>',
    '<script type="application/ld+json">{"@type": "Organization", "numberOfEmployees": 99999999}</script>',
    '<script type="application/ld+json">{"z": {"@type": "Organization", "numberOfEmployees": {"minValue": {n}, "maxValue": {m}}}, "a": {"@type": "Organization", "numberOfEmployees": {"minValue": 11, "maxValue": 12}}}</script>',
    '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type": "Organization", "numberOfEmployees": "1,{p}"}</script>',
    '<script>var t="we show {n} employees here"</script><style>.a{content:"{n} strong"}</style>',
    '<script>var t="over {m} staff"</script><p>more than {n} staff</p>',
    "<p>a team of {n}</p>",
    "",
)


@query("""WITH p AS (SELECT page_id, page_id % 11 AS k, (page_id % 900 + 20)::DOUBLE AS n FROM pages)
SELECT page_id, 'json_ld' AS method, CASE WHEN k = 6 THEN 1000 + n ELSE n END AS value_min, CASE WHEN k IN (1, 5) THEN n + 20 WHEN k = 6 THEN 1000 + n ELSE n END AS value_point,
  CASE WHEN k IN (1, 5) THEN n + 40 WHEN k = 6 THEN 1000 + n ELSE n END AS value_max, CASE WHEN k IN (1, 5) THEN 'bucket' ELSE 'exact' END AS kind FROM p WHERE k IN (0, 1, 2, 5, 6)
UNION ALL SELECT page_id, 'text', n, round(n * 1.1, 6), round(n * 1.25, 6), 'range' FROM p WHERE k = 8
UNION ALL SELECT page_id, 'text', round(n * 0.9, 6), n, round(n * 1.15, 6), 'range' FROM p WHERE k = 9""")
def page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real pages, each with a statement in one of eleven forms put in: JSON-LD of organisations and others, scripts and styles that only look like one, plain text."""
    n = F.col("page_id") % 900 + 20
    extra = phrase(F.col("page_id"), *_FORMS, n=n, m=n + 40, p=F.lpad(n.cast("string"), 3, "0"))
    rows = X.page_signals(A.table(spark, sf_dir, "pages").select("page_id", F.concat("html", extra).alias("html")))
    values = [F.round(c, 6).alias(c) for c in ("value_min", "value_point", "value_max")]
    return rows.select("page_id", "method", *values, "kind")


@query("""WITH u AS (SELECT *, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www[.]', '') AS host FROM pages), d AS (
  SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 12))::BIGINT AS company_id FROM u WHERE host NOT LIKE 'blog.%' AND host NOT LIKE 'm.%'
), o AS (
  SELECT p.*, company_id FROM u p JOIN d ON p.host = d.host OR p.host LIKE '%.' || d.host
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(d.host) DESC, company_id) = 1
), r AS (
  SELECT DISTINCT company_id, page_id % 7 = 3 AS archived, url, page_id % 3 AS k, (page_id % 900 + 20)::DOUBLE AS n FROM o WHERE page_id % 3 < 2 AND page_id % 11 <> 5
)
SELECT company_id, CASE WHEN archived THEN 'archive' ELSE 'company_page' END AS source_name, CASE WHEN k = 0 THEN 'json_ld' WHEN archived THEN 'text' ELSE 'exact' END AS statement, n AS value_point,
  CASE WHEN k = 0 AND archived THEN 0.55::DOUBLE WHEN k = 0 THEN 0.7::DOUBLE WHEN archived THEN 0.45::DOUBLE ELSE 0.65::DOUBLE END AS confidence,
  CASE WHEN archived THEN '2015-03-01' END AS snapshot_month, count(*) AS pages FROM r GROUP BY ALL""")
def archive_reextraction_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-extraction over the urls and bodies of pages: real hosts name the companies, two pages of three state a size, some came from a web archive or were refused."""
    k, n = F.col("page_id") % 3, (F.col("page_id") % 900 + 20).cast("string")
    pages = A.table(spark, sf_dir, "pages")
    said = F.when(k == 0, F.replace(F.lit(_FORMS[0]), F.lit("{n}"), n)).when(k == 1, F.concat(F.lit("<script>over 77 staff</script><p>"), n, F.lit(" colleagues</p>"))).otherwise("")
    url = F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("https://archive.example/web/20150314000000/"), F.col("url"))).otherwise(F.col("url"))
    status = F.when(F.col("page_id") % 11 == 5, 403).otherwise(200)
    archive = pages.select("page_id", url.alias("url"), status.alias("status"), F.concat("html", said).alias("body"))
    hosts = pages.select(T.domain_key("url").alias("domain")).distinct().where("domain is not null and not domain rlike '^(blog|m)[.]'")
    companies = hosts.withColumn("company_id", F.conv(F.substring(F.md5("domain"), 1, 12), 16, 10).cast("long"))
    stored_signals = spark.createDataFrame([], "company_id long, source_name string, content_hash string")
    rows = J.reextract(archive, companies, stored_signals)
    return rows.groupBy("company_id", "source_name", "statement", "value_point", "confidence", "snapshot_month").agg(F.count("*").alias("pages"))


@query(sql("""SELECT s.company_id, s.month, 'anchor' AS what, p.anchor_id AS item, round(p.value_point, 4) AS value FROM stored s JOIN placed p ON p.company_id = s.company_id AND p.segment_no = s.segment_no
UNION ALL SELECT s.company_id, s.month, 'event', strftime(v.event_month, '%Y-%m-%d') || ' ' || v.event_type, NULL FROM stored s JOIN segments g ON g.company_id = s.company_id AND g.segment_no = s.segment_no
  JOIN events v ON v.company_id = s.company_id AND v.event_month BETWEEN g.segment_start AND g.segment_end
UNION ALL SELECT s.company_id, s.month, 'growth', w.horizon, round(w.growth_point, 4) FROM stored s JOIN growth w ON w.company_id = s.company_id AND w.month = s.month""", dates=("month",)))
def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every evidence record holds, item by item: anchors with their values, events, growth."""
    e = full(spark, sf_dir)
    series = TB.shuffled(TB.checkpointed(e.stored))
    happened = OV.with_events(A.events(spark, sf_dir), e.decoded["events"])
    tree = X.evidence(series.select("company_id", "month"), series, e.segments, e.placed, happened, G.growth_series(series))
    item = lambda what, name, value: F.struct(F.lit(what).alias("what"), name.alias("item"), value.cast("double").alias("value"))
    none = F.lit(None).cast("double")
    of = {
        "anchors": lambda x: item("anchor", x.anchor_id, x.value_point),
        "events": lambda x: item("event", F.concat_ws(" ", F.date_format(x.event_month, "yyyy-MM-dd"), x.event_type), none),
        "growth": lambda x: item("growth", x.horizon, x.growth_point),
    }
    every = F.flatten(F.array(*(F.coalesce(F.transform(c, f), F.array()) for c, f in of.items())))
    return rounded(tree.select("company_id", "month", F.inline(every)), "value")


@query("""WITH s AS (
  SELECT DISTINCT 'site' || (page_id % 97) AS origin, (DATE '2001-11-01' - to_months((page_id * 7 % 61)::INT))::DATE AS snapshot_month FROM pages
), h AS (
  SELECT *, (DATE '2001-11-01' - to_months(horizon))::DATE AS stamped_month, abs((year(snapshot_month) - 2001) * 12 + month(snapshot_month) - 11 + horizon) AS off FROM s, (VALUES (6), (12), (24)) AS v(horizon)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY origin, horizon ORDER BY off, snapshot_month) AS k FROM h WHERE off <= 12
), u AS (
  SELECT *, row_number() OVER (PARTITION BY origin, snapshot_month ORDER BY horizon) AS j FROM n WHERE k = 1
)
SELECT origin, strftime(snapshot_month, '%Y-%m-%d') AS snapshot_month, horizon, strftime(stamped_month, '%Y-%m-%d') AS stamped_month FROM u WHERE j = 1""")
def snapshot_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.table(spark, sf_dir, "pages")
    back = -(F.col("page_id") * 7 % 61).cast("int")
    rows = pages.select(F.concat(F.lit("site"), (F.col("page_id") % 97).cast("string")).alias("origin"), F.add_months(F.lit("2001-11-01").cast("date"), back).alias("snapshot_month"))
    return X.snapshot_choice(rows, F.lit("2001-11-01").cast("date"))


@query("""WITH e AS (SELECT s_suppkey AS k, s_suppkey % 8 AS j FROM supplier)
SELECT 'anchor' AS what, k AS company_id, NULL AS reason, '2001-05-01' AS anchor_month, k::DOUBLE AS value_min, k + 5.0::DOUBLE AS value_point, k + 9.0::DOUBLE AS value_max,
  CASE WHEN j = 1 THEN 'range' ELSE 'exact' END AS kind, CASE WHEN j = 1 THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM e WHERE j < 3
UNION ALL SELECT 'rejected', k, CASE j WHEN 3 THEN 'note_required' WHEN 4 THEN 'headcount_missing' WHEN 5 THEN 'headcount_unreadable' WHEN 6 THEN 'unknown_kind' ELSE 'month_unreadable' END, NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE j > 2""")
def analyst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One YAML file a nation with an entry a supplier, five kinds of them wrong, read back, validated and matched by name."""
    k = F.col("s_suppkey")
    entry = phrase(
        k,
        '- canonical_name: "{name}"\n  anchor_month: 2001-05-17\n  headcount: {min: {k}, point: {p}, max: {m}}\n  note: cited',
        '- {canonical_name: "{name}", anchor_month: "2001-05-01", headcount: {min: "{k}", point: {p}.0, max: {m}, kind: range}, confidence: 0.5, note: x}',
        '- canonical_name: "  {name} "\n  anchor_month: 2001-05-31\n  headcount:\n    min: {k}\n    point: {p}\n    max: {m}\n    kind: exact\n  note: "y: z"',
        '- {canonical_name: "{name}", anchor_month: 2001-05-01, headcount: {min: {k}, point: {p}, max: {m}}, note: "  "}',
        '- {canonical_name: "{name}", anchor_month: 2001-05-01, note: n, source_url: "{k}"}',
        '- {canonical_name: "{name}", anchor_month: 2001-05-01, headcount: {min: {k}, point: many, max: {m}}, note: n}',
        '- {canonical_name: "{name}", anchor_month: 2001-05-01, headcount: {min: {k}, point: {p}, max: {m}, kind: guess}, note: n}',
        '- {canonical_name: "{name}", anchor_month: May 2001, headcount: {min: {k}, point: {p}, max: {m}}, note: n}',
        name=F.concat(F.lit("Firm "), k.cast("string")), k=k, p=k + 5, m=k + 9,
    )
    path = TB.scratch(spark)
    texts = A.table(spark, sf_dir, "supplier").select("s_nationkey", k.alias("k"), entry.alias("value"))
    # a file a nation, its entries in the order of suppliers
    texts.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "k").drop("k").write.partitionBy("s_nationkey").text(path)
    got = AN.read_analyst_files(spark, f"{path}/*/*.txt")
    suppliers = A.table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    companies = suppliers.select(k.alias("company_id"), F.concat(F.lit("firm "), k.cast("string"), F.lit(", LLC")).alias("name"), none.alias("domain"), none.alias("profile_url"))
    aliases = companies.select("company_id", F.col("name").alias("alias")).limit(0)
    kept = PR.manual_entries(got["rows"], companies, aliases)["anchors"]
    # the n-th entry of a file is the n-th supplier of its nation
    number = suppliers.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("ks"))
    nation = F.regexp_extract("file", r"s_nationkey=(\d+)", 1).cast("int")
    bad = got["rejected"].select(nation.alias("s_nationkey"), "entry_no", "reject_reason").join(number, "s_nationkey")
    cells = ["anchor_month", "value_min", "value_point", "value_max", "kind", "confidence"]
    empty = [F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in cells]
    return kept.select(F.lit("anchor").alias("what"), "company_id", none.alias("reason"), *cells).unionByName(
        bad.select(F.lit("rejected").alias("what"), F.get("ks", F.col("entry_no") - 1).alias("company_id"), F.col("reject_reason").alias("reason"), *empty)
    )


@query(sql(
    "SELECT company_id, name AS canonical_name, month, round(value_point, 4) AS estimated_headcount, profiles AS public_profile_count, band AS confidence_band, needs_review, 'v' || company_id AS estimate_version_id"
    " FROM stored JOIN company USING (company_id) WHERE company_id % 3 = 1", 6, dates=("month",),
))
def export_monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series report of a third of the companies, written as JSON in order and read back."""
    companies, path = A.companies(spark, sf_dir), TB.scratch(spark)
    series = stored(spark, sf_dir).withColumn("version_id", F.concat(F.lit("v"), F.col("company_id").cast("string")))
    rows = EX.export_report("monthly_series", path, "JSON", series, companies, companies.where("company_id % 3 = 1"))
    back = spark.read.schema(rows.schema).json(path)
    return rounded(back.select("company_id", "canonical_name", "month", "estimated_headcount", "public_profile_count", "confidence_band", "needs_review", "estimate_version_id"), "estimated_headcount")


@query(sql("SELECT company_id, name AS canonical_name, anchor_month, anchor_type, round(value_point, 4) AS value_point, kind AS value_kind, round(confidence, 4) AS confidence, source_name, 'https://s.example/' || source_name AS source_url"
           " FROM anchors0 JOIN company USING (company_id)", 1, dates=("anchor_month",)))  # fmt: skip
def export_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = TB.scratch(spark)
    rows = A.anchors(spark, sf_dir).withColumn("source_url", F.concat(F.lit("https://s.example/"), F.col("source_name")))
    shaped = EX.export_report("anchors", path, "parquet", rows, A.companies(spark, sf_dir))
    back = spark.read.schema(shaped.schema).parquet(path)
    return rounded(back.drop("value_min", "value_max"), "value_point", "confidence")


_ITEMS = """items0 AS (
  SELECT l_suppkey AS company_id, id, CASE l_returnflag WHEN 'A' THEN 'anomaly' ELSE 'manual' END AS reason, l_quantity::INT AS priority,
    CASE WHEN l_linestatus = 'O' THEN 'open' WHEN l_discount < 0.05 THEN 'assigned' ELSE 'resolved' END AS status, l_shipdate AS updated_at
  FROM lin WHERE l_linenumber = 5
)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.lines(spark, sf_dir).where("l_linenumber = 5")
    status = F.when(F.col("l_linestatus") == "O", "open").when(F.col("l_discount") < 0.05, "assigned").otherwise("resolved")
    return rows.select(
        F.col("l_suppkey").alias("company_id"), F.col("id").alias("item_id"), F.when(F.col("l_returnflag") == "A", "anomaly").otherwise("manual").alias("reason"), F.col("l_quantity").cast("int").alias("priority"),
        status.alias("status"), F.lit(None).cast("string").alias("assignee"), F.lit(None).cast("string").alias("version_id"), F.lit("d").alias("detail"), F.col("l_shipdate").cast("date").alias("updated_at"),
    )


@query(sql("SELECT id, company_id, name AS canonical_name, reason AS review_reason, priority, status, updated_at FROM items0 JOIN company USING (company_id) WHERE status <> 'resolved'", 1, _ITEMS, dates=("updated_at",)))
def export_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = TB.scratch(spark)
    rows = EX.export_report("review_queue", path, "csv", _items(spark, sf_dir), A.companies(spark, sf_dir))
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    return back.select("id", "company_id", "canonical_name", "review_reason", "priority", "status", "updated_at")


@query(sql("""SELECT id, priority, status, updated_at FROM (SELECT * FROM items0 WHERE status <> 'resolved' ORDER BY -priority, id LIMIT 150 OFFSET 300)
UNION ALL SELECT id, priority, status, updated_at FROM (SELECT * FROM items0 WHERE status <> 'resolved' AND priority < 20 ORDER BY -priority, id LIMIT 40)""", 1, _ITEMS, dates=("updated_at",)))
def ordered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue as ordered files: a page by place, and one after a key; the limits are the feature."""
    rows = _items(spark, sf_dir).where("status <> 'resolved'").select((-F.col("priority")).alias("urgency"), "item_id", "priority", "status", "updated_at")
    path, order = TB.scratch(spark), ["urgency", "item_id"]
    EX.write_ordered(rows, path, order, 8)
    both = EX.read_page(spark, path, order, 150, 300).unionByName(EX.read_after(spark, path, order, (-20, "~"), 40))
    return both.select(F.col("item_id").alias("id"), "priority", "status", "updated_at")


@query(sql("""SELECT b.company_id, c.name AS canonical_name, b.provider, s.month, round(s.value_point, 4) AS estimate_point, round(b.value_point, 4) AS benchmark_point,
  (abs(b.value_point - s.value_point) / greatest(1, b.value_point) > 0.25 OR b.value_max < s.value_min OR s.value_max < b.value_min) AS disagreement
FROM benchmark_rows b JOIN stored s ON s.company_id = b.company_id AND s.month = (b.as_of_month - to_months(CASE b.metric WHEN 'headcount_6m_ago' THEN 6 WHEN 'headcount_1y_ago' THEN 12 WHEN 'headcount_2y_ago' THEN 24 ELSE 0 END))::DATE
JOIN company c ON c.company_id = b.company_id WHERE b.metric LIKE 'headcount%'""", 6, dates=("month",)))
def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference row beside the estimate of its month, nested by company and flattened again."""
    nested = E.comparison_matches(A.benchmark(spark, sf_dir), stored(spark, sf_dir), A.companies(spark, sf_dir), as_of_is_shifted=False)
    rows = RD.flat_comparison(nested).select("company_id", "canonical_name", "provider", "month", "estimate_point", "benchmark_point", "disagreement")
    return rounded(rows, "estimate_point", "benchmark_point")


_SHEET = """sheet AS (
  SELECT c.company_id, c.name, u.metric, (DATE '2001-11-01' - to_months(u.back))::DATE AS month, (c.company_id % 40 * 10 + u.back)::DOUBLE AS point
  FROM company c, (VALUES ('headcount_current', 0), ('headcount_6m_ago', 6), ('headcount_1y_ago', 12), ('headcount_2y_ago', 24)) AS u(metric, back)
)"""


@query(sql("""SELECT b.company_id, b.metric, b.month, b.point AS benchmark_point, round(s.value_point, 4) AS estimate_point FROM sheet b JOIN stored s USING (company_id, month)
WHERE abs(b.point - s.value_point) / greatest(1, b.point) > 0.25 OR b.point < s.value_min OR s.value_max < b.point""", 6, _SHEET, dates=("month",)))
def sheet_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a provider's sheet to disagreements: the loader shifts each metric to its month, and nothing shifts it again."""
    companies = A.companies(spark, sf_dir)
    base = F.col("company_id") % 40 * 10
    heads = {"Employee Count": base, "Employee Count (6 months ago)": base + 6, "Employee Count (1 year ago)": base + 12, "Employee Count (2 years ago)": base + 24}
    sheet = companies.select(F.col("company_id").alias("row_index"), F.col("name").alias("Company name"), *(v.cast("string").alias(h) for h, v in heads.items()))
    rows = BM.load_sheet(sheet, BM.LAYOUTS[2], F.lit("2001-11-15").cast("date"))["rows"]
    owned = rows.withColumn("company_id", F.col("row_index")).withColumn("benchmark_id", F.concat_ws("/", F.col("row_index").cast("string"), "metric"))
    found = E.disagreements(owned, stored(spark, sf_dir))
    return rounded(found.select("company_id", "metric", "month", "benchmark_point", "estimate_point"), "estimate_point")


@query(sql("""SELECT company_id, anchor_type, confidence, count(*) AS n FROM (
  SELECT company_id, CASE metric WHEN 'headcount_current' THEN 'current_headcount_anchor' ELSE 'historical_statement' END AS anchor_type, unnest(CASE provider WHEN 'primary' THEN [0.7::DOUBLE, 0.5::DOUBLE] WHEN 'secondary' THEN [0.55::DOUBLE] ELSE [0.45::DOUBLE] END) AS confidence
  FROM benchmark_rows WHERE metric LIKE 'headcount%' AND value_min <= value_point AND value_point <= value_max) GROUP BY ALL""", 1))
def promotion_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence floors of promoted reference rows, by provider; one that the policy does not name has the general floor."""
    rows = A.benchmark(spark, sf_dir)
    rows = rows.unionByName(rows.where("provider = 'primary'").withColumn("provider", F.lit("other")).withColumn("benchmark_id", F.concat(F.lit("o"), F.col("benchmark_id"))))
    made = PR.promote_benchmarks(rows, A.anchors(spark, sf_dir).limit(0), ())["anchors"]
    return made.groupBy("company_id", "anchor_type", "confidence").agg(F.count("*").alias("n"))


@query(sql("""SELECT 'e1' AS evaluation_id, '2001-11-15' AS evaluated_on, (SELECT count(*) FROM company) AS companies, (SELECT count(DISTINCT company_id) FROM stored) AS evaluated""", 6))
def evaluation_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoreboard kept as JSON among older evaluations, found again as the newest."""
    board = E.scoreboard(A.companies(spark, sf_dir), A.benchmark(spark, sf_dir), stored(spark, sf_dir), as_of())
    kept = E.snapshot(board, F.lit("e1"), now())
    older = kept.withColumn("evaluation_id", F.lit("e0")).withColumn("evaluated_at", F.col("evaluated_at") - F.expr("interval 1 day"))
    newest = RD.evaluation_detail(kept.unionByName(older))
    of = lambda c: F.get_json_object("scoreboard", f"$.{c}").cast("long")
    return newest.select("evaluation_id", F.date_format("evaluated_at", "yyyy-MM-dd").alias("evaluated_on"), of("companies_in_scope").alias("companies"), of("companies_evaluated").alias("evaluated"))


@query("""SELECT s_suppkey AS company_id, (s_suppkey % 300 + 1)::DOUBLE AS value_point, CASE WHEN s_suppkey % 3 = 0 THEN '2001-11-01' ELSE '2000-0' || (s_suppkey % 9 + 1) || '-01' END AS anchor_month
FROM supplier WHERE s_suppkey % 4 > 0""")
def knowledge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a knowledge base, one JSON document a company; a quarter of them count nobody, a third are without a date."""
    k = F.col("s_suppkey")
    cell = lambda v: F.struct(v.cast("string").alias("value"))
    count = F.when(k % 4 == 0, F.lit(0)).otherwise(k % 300 + 1)
    day = F.when(k % 3 != 0, F.concat(F.lit("2000-0"), (k % 9 + 1).cast("string"), F.lit("-17T00:00:00Z")))
    bindings = F.array(F.struct(cell(F.concat(F.lit("http://k.example/Q"), k.cast("string"))).alias("company"), cell(count).alias("employees"), F.when(day.isNotNull(), cell(day)).alias("asof")))
    body = F.to_json(F.struct(F.struct(bindings.alias("bindings")).alias("results")))
    return X.knowledge_rows(A.table(spark, sf_dir, "supplier").select(k.alias("company_id"), body.alias("body")), F.lit("2001-11-01").cast("date"))


@query("""SELECT c_custkey AS row_no, c_name AS name, lower('Host' || c_custkey || '.EXAMPLE') AS domain FROM customer WHERE c_custkey % 5 <> 0""")
def seed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate sheet written as CSV with headings of its own, every fifth row without a name, and loaded."""
    k, path = F.col("c_custkey"), TB.scratch(spark)
    sheet = A.table(spark, sf_dir, "customer").select(k.cast("string").alias("Row"), F.when(k % 5 == 0, "  ").otherwise(F.col("c_name")).alias("Company Name "), F.concat(F.lit("Host"), k.cast("string"), F.lit(".EXAMPLE")).alias("Website"))
    sheet.write.option("header", True).csv(path)
    loaded = TB.read_seed(spark, path, {"row": "row_no", "company name": "name", "website": "domain"})
    return loaded.select(F.col("row_no").cast("long").alias("row_no"), "name", "domain")


_STATUSES = """statuses AS (
  SELECT l_orderkey % 50 AS run_id, l_suppkey AS company_id, CASE l_linenumber WHEN 1 THEN 'fetch' WHEN 2 THEN 'parse' ELSE 'score' END AS stage,
    CASE WHEN l_quantity < 3 THEN 'failed' ELSE 'succeeded' END AS status, 'e' || l_linenumber AS error
  FROM lin WHERE l_linenumber <= 3
)"""


@query(sql("""SELECT run_id, (SELECT string_agg(stage || ':' || status || ':' || n, ',' ORDER BY stage, status) FROM (SELECT stage, status, count(DISTINCT company_id) AS n FROM statuses q WHERE q.run_id = r.run_id GROUP BY ALL)) AS stages,
  (SELECT count(*) FROM statuses q WHERE q.run_id = r.run_id AND status = 'failed') AS failures FROM (SELECT DISTINCT run_id FROM statuses) r WHERE run_id % 2 = 0""", 1, _STATUSES))
def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one kind, newest first, with their stages and failed companies."""
    rows = A.lines(spark, sf_dir).where("l_linenumber <= 3")
    stage = F.element_at(F.array(*map(F.lit, ("fetch", "parse", "score"))), F.col("l_linenumber").cast("int"))
    statuses = rows.select(
        (F.col("l_orderkey") % 50).alias("run_id"), F.col("l_suppkey").alias("company_id"), stage.alias("stage"), F.when(F.col("l_quantity") < 3, "failed").otherwise("succeeded").alias("status"),
        F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("error"),
    )
    logged = statuses.select("run_id").distinct().select("run_id", F.when(F.col("run_id") % 2 == 0, "full").otherwise("part").alias("kind"), F.timestamp_seconds(F.col("run_id") * 60).alias("started_at"))
    detail = RD.run_detail(RD.runs(logged, "full", 200), statuses)
    stages = F.array_join(F.transform("stages", lambda x: F.concat_ws(":", x.stage, x.status, x.companies.cast("string"))), ",")
    return detail.select("run_id", stages.alias("stages"), F.coalesce(F.size("failures"), F.lit(0)).cast("long").alias("failures"))
