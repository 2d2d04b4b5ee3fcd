"""Registered queries of scoring, evidence, sheets, lookups, upkeep and reading, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import text as T
from rosterlake.functions.expressions import natural_id
from rosterlake.operators import evaluation as E
from rosterlake.operators import events as EV
from rosterlake.operators import evidence as X
from rosterlake.operators import growth as G
from rosterlake.operators import overrides as OV
from rosterlake.operators import promotion as PR
from rosterlake.operators import reading as RD
from rosterlake.operators import resolution as RS
from rosterlake.operators import review as R
from rosterlake.operators import series as S
from rosterlake.plans import adapters as A
from rosterlake.plans.oracle import sql
from rosterlake.plans.queries import _COMPARED, _SCORED, as_of, full, near, now, query, rounded, stored
from rosterlake.sources import benchmarks as BM
from rosterlake.sources import tables as TB

# --- scoring ---------------------------------------------------------------

_RANKS = """
ranked AS (
  SELECT provider, metric, rank() OVER (PARTITION BY provider, metric ORDER BY estimate_ratio) + (count(*) OVER (PARTITION BY provider, metric, estimate_ratio) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY provider, metric ORDER BY benchmark_ratio) + (count(*) OVER (PARTITION BY provider, metric, benchmark_ratio) - 1) / 2 AS ry FROM grown WHERE NOT skipped
), sums AS (
  SELECT provider, metric, count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx * rx) AS sxx, sum(ry * ry) AS syy, sum(rx * ry) AS sxy FROM ranked GROUP BY ALL
), rho AS (
  SELECT metric, CASE WHEN n >= 3 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS rho FROM sums WHERE provider = 'primary'
), mae AS (
  SELECT provider, metric, avg(error) AS mae FROM grown GROUP BY ALL
)"""


def _rho(h: str) -> str:
    return f"(SELECT round(rho, 4) FROM rho WHERE metric = '{h}') AS spearman_{h}"


def _mae(h: str, *providers: str) -> str:
    tried = ", ".join(f"(SELECT mae FROM mae WHERE metric = '{h}' AND provider = '{p}')" for p in providers)
    return f"(SELECT round(m, 4) FROM (SELECT coalesce({tried}, NULL) AS m)) AS growth_mae_{h}"


@query(sql(f"""SELECT (SELECT round(m, 4) FROM (SELECT avg(error_pct) AS m FROM judged WHERE provider = 'primary' AND metric = 'headcount_current')) AS mape_current,
  {_mae("6m", "primary", "secondary")}, {_mae("1y", "primary", "secondary")}, {_mae("2y", "secondary")}, {_rho("6m")}, {_rho("1y")}, {_rho("2y")}""", 7, _SCORED, _RANKS))  # fmt: skip
def scoreboard_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, series = A.benchmark(spark, sf_dir), stored(spark, sf_dir)
    grown = E.growth_rows(refs, series)
    ranks = E.spearman(grown, ["provider", "metric"], "estimate_ratio", "benchmark_ratio")
    board = E.headline(E.accuracy(E.scored_rows(refs, series, as_of())), E.accuracy(grown), ranks)
    return rounded(board, *board.columns)


@query(sql("""SELECT (SELECT count(DISTINCT company_id) FROM benchmark_rows) AS companies_with_benchmarks, (SELECT count(*) FROM benchmark_rows) AS benchmarks_total, count(*) AS companies_compared,
  coalesce(sum(compared), 0)::BIGINT AS benchmarks_matched, coalesce(sum(disagreements), 0)::BIGINT AS disagreements_total, CASE WHEN sum(compared) > 0 THEN round(1 - sum(disagreements) / sum(compared), 4) ELSE 0 END AS match_rate FROM cmp""", 7, _COMPARED))
def comparison_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = A.benchmark(spark, sf_dir)
    return rounded(E.comparison_totals(refs, E.comparison(refs, stored(spark, sf_dir), as_of_is_shifted=False)), "match_rate")


@query(sql("""SELECT company_id, kind, item, round(expected, 4) AS expected, round(actual, 4) AS actual, expected_band, actual_band FROM (
  SELECT a.company_id, CASE WHEN s.value_point IS NULL THEN 'missing_monthly_estimate' ELSE 'monthly_estimate_out_of_tolerance' END AS kind, strftime(anchor_month, '%Y-%m-%d') AS item, a.value_point AS expected, s.value_point AS actual, NULL AS expected_band, NULL AS actual_band
  FROM anchors0 a LEFT JOIN stored s ON s.company_id = a.company_id AND s.month = a.anchor_month WHERE s.value_point IS NULL OR abs(s.value_point - a.value_point) > greatest(1, abs(a.value_point) * 0.1::DOUBLE)
  UNION ALL SELECT b.company_id, CASE WHEN growth_point IS NULL THEN 'missing_growth_window' ELSE 'growth_out_of_tolerance' END, metric[8:9], b.value_point, growth_point * 100, NULL, NULL
  FROM benchmark_rows b LEFT JOIN latest l ON l.company_id = b.company_id AND l.horizon = metric[8:9] WHERE metric LIKE 'growth%' AND (growth_point IS NULL OR abs(growth_point * 100 - b.value_point) > 5)
  UNION ALL SELECT c.company_id, CASE WHEN b.band IS NULL THEN 'no_estimates' ELSE 'confidence_band_drift' END, 'latest', NULL, NULL, want, b.band
  FROM (SELECT company_id, CASE WHEN company_id % 2 = 0 THEN 'medium' ELSE 'low' END AS want FROM company) c LEFT JOIN (SELECT company_id, arg_max(band, month) AS band FROM stored GROUP BY ALL) b USING (company_id) WHERE b.band IS NULL OR b.band <> want)""", 7))  # fmt: skip
def golden_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor, growth reference and a band a company as expectations of the stored series."""
    samples = A.anchors(spark, sf_dir).select("company_id", F.col("anchor_month").alias("month"), "value_point", F.lit(0.1).alias("tolerance"))
    growths = A.benchmark(spark, sf_dir).where(F.col("metric").startswith("growth")).select("company_id", F.substring("metric", 8, 2).alias("horizon"), F.col("value_point").alias("pct"), F.lit(5.0).alias("tolerance"))
    bands = A.companies(spark, sf_dir).select("company_id", F.when(F.col("company_id") % 2 == 0, "medium").otherwise("low").alias("band"))
    return rounded(E.golden_diff(samples, growths, bands, stored(spark, sf_dir)), "expected", "actual")


@query(sql("SELECT count(*) FILTER (WHERE estimate > 0) AS scored, count(*) FILTER (WHERE estimate <= 0) AS declined, 0::BIGINT AS unmatched, (SELECT round(m, 4) FROM (SELECT avg(abs(estimate - target) / target * 100) AS m FROM t WHERE estimate > 0)) AS mape_pct FROM t", 6, """
t AS (
  SELECT b.company_id, b.value_point AS target, s.value_point AS estimate FROM benchmark_rows b LEFT JOIN stored s ON s.company_id = b.company_id AND s.month = DATE '2001-11-01' WHERE metric = 'headcount_current'
)"""))
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = stored(spark, sf_dir).where(F.col("month") == as_of()).select("company_id", F.col("value_point").alias("estimate"))
    targets = A.benchmark(spark, sf_dir).where("metric = 'headcount_current'").select("company_id", F.col("value_point").alias("target"))
    return rounded(E.error_summary(targets.join(last, "company_id", "left")), "mape_pct")


# --- evidence --------------------------------------------------------------

_TREE = """
ver AS (
  SELECT company_id, arg_max(version_id, (created_at, version_id)) AS version_id FROM (SELECT l_suppkey AS company_id, id AS version_id, l_shipdate AS created_at FROM lin WHERE l_linenumber = 4) GROUP BY ALL
), n_recon AS (SELECT company_id, count(*) AS n FROM reconciled GROUP BY ALL
), n_over AS (SELECT l_suppkey AS company_id, count(*) AS n FROM ov GROUP BY ALL
), n_audit AS (SELECT company_id, sum(1 + l_quantity::INT % 3)::BIGINT AS n FROM ver JOIN lin ON lin.id = ver.version_id WHERE l_linenumber = 4 GROUP BY ALL
), n_place AS (SELECT company_id, segment_no, count(*) AS n FROM placed GROUP BY ALL
)"""


@query(sql("""SELECT s.company_id, s.month, round(s.value_point, 4) AS value_point, coalesce(p.n, 0) AS n_anchors, coalesce(r.n, 0) AS n_reconciled, coalesce(o.n, 0) AS n_overrides, v.version_id, coalesce(a.n, 0) AS n_audit
  FROM stored s LEFT JOIN n_place p USING (company_id, segment_no) LEFT JOIN n_recon r ON r.company_id = s.company_id LEFT JOIN n_over o ON o.company_id = s.company_id LEFT JOIN ver v ON v.company_id = s.company_id LEFT JOIN n_audit a ON a.company_id = s.company_id""", 6, _TREE, dates=("month",)))  # fmt: skip
def evidence_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = full(spark, sf_dir)
    series = TB.shuffled(TB.checkpointed(e.stored))
    happened = OV.with_events(A.events(spark, sf_dir), e.decoded["events"])
    records = X.evidence(series.select("company_id", "month"), series, e.segments, e.placed, happened, G.growth_series(series))
    versions = A.versions(spark, sf_dir)
    tree = X.evidence_tree(records, e.reconciled, OV.active(A.overrides(spark, sf_dir), now()), versions, A.audit(spark, sf_dir))
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    rows = tree.select("company_id", "month", F.col("estimate.value_point").alias("value_point"), n("anchors"), n("reconciled"), n("overrides"), "version_id", n("audit"))
    return rounded(rows, "value_point")


# --- reference sheets and names ---------------------------------------------


def sheets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The three layouts, one row a supplier, in the spelling of their sheets."""
    k = F.col("s_suppkey")
    rows = A.table(spark, sf_dir, "supplier").withColumn("row_index", k)
    size = F.when(k % 4 == 0, "11-50").when(k % 4 == 1, "10,001+").when(k % 4 == 2, "unknown")
    note = F.when(k % 3 == 0, "Acquired by Foo in March 2000").when(k % 3 == 1, " ")
    past = F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))
    grown = F.when(k % 2 == 0, "-5.5").otherwise("12%")
    site = F.concat(F.lit(" WWW.S"), k.cast("string"), F.lit(".COM "))
    first = rows.select("row_index", F.when(k % 10 > 0, F.col("s_name")).alias("Company Name"), k.alias("headcount"), (k % 50 - 25).alias("Headcount % (365d)"))
    second = rows.select("row_index", F.col("s_name").alias("Company name"), site.alias("Company Domain Name"), past.alias("Employee Count (6 months ago)"), grown.alias("Employee Growth % (1 year)"))
    third = rows.select("row_index", F.col("s_name").alias("Company name"), site.alias("Company Domain Name"), size.alias("Employee Range"), (k * 10).alias("Employee Count"), past.alias("Employee Count (2 years ago)"), note.alias("Notes"))
    return [first, second, third]


_SHEET_ROWS = """
k AS (
  SELECT s_suppkey AS k, s_name AS name, lower(trim(' WWW.S' || s_suppkey || '.COM ')) AS site, CASE WHEN s_suppkey % 3 = 0 THEN 'Acquired by Foo in March 2000' END AS note, (1000 + s_suppkey % 1000)::DOUBLE AS past FROM supplier
), sheet_rows AS (
  SELECT 'primary' AS provider, k AS row_index, name, NULL AS domain, 'headcount_current' AS metric, DATE '2001-11-01' AS as_of_month, k::DOUBLE AS value_min, k::DOUBLE AS value_point, k::DOUBLE AS value_max, 'exact' AS kind, NULL AS note FROM k WHERE k % 10 > 0
  UNION ALL SELECT 'primary', k, name, NULL, 'growth_1y_pct', DATE '2001-11-01', k % 50 - 25, k % 50 - 25, k % 50 - 25, 'exact', NULL FROM k WHERE k % 10 > 0
  UNION ALL SELECT 'secondary', k, name, site, 'headcount_6m_ago', DATE '2001-05-01', past, past, past, 'exact', NULL FROM k
  UNION ALL SELECT 'secondary', k, name, site, 'growth_1y_pct', DATE '2001-11-01', -5.5, -5.5, -5.5, 'exact', NULL FROM k WHERE k % 2 = 0
  UNION ALL SELECT 'tertiary', k, name, site, 'headcount_2y_ago', DATE '1999-11-01', past, past, past, 'exact', NULL FROM k
  UNION ALL SELECT 'tertiary', k, name, site, 'headcount_current', DATE '2001-11-01', 11, 30.5, 50, 'range', note FROM k WHERE k % 4 = 0
  UNION ALL SELECT 'tertiary', k, name, site, 'headcount_current', DATE '2001-11-01', 10001, 10001, 20002, 'bucket', note FROM k WHERE k % 4 = 1
)"""


@query(sql("SELECT * FROM sheet_rows", 1, _SHEET_ROWS, dates=("as_of_month",)))
def benchmark_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = [BM.load_sheet(s, layout, as_of())["rows"] for s, layout in zip(sheets(spark, sf_dir), BM.LAYOUTS, strict=True)]
    rows = loaded[0].unionByName(loaded[1]).unionByName(loaded[2])
    return rows.select("provider", "row_index", "name", "domain", "metric", "as_of_month", "value_min", "value_point", "value_max", "kind", "note")


@query("SELECT 'tertiary' AS provider, s_suppkey AS row_index, s_name AS name, 'acquisition' AS hint_type, '2000-03-01' AS event_month, 'Acquired by Foo in March 2000' AS description FROM supplier WHERE s_suppkey % 3 = 0")
def benchmark_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BM.load_sheet(sheets(spark, sf_dir)[2], BM.LAYOUTS[2], as_of())["hints"].drop("domain")


@query("""SELECT c_custkey AS row_id, CASE WHEN c_custkey % 5 < 4 AND c_custkey % 1000 + 1 <= (SELECT max(s_suppkey) FROM supplier) THEN c_custkey % 1000 + 1 END AS company_id FROM customer""")
def target_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers' targets: a supplier's own name, its alias, either with a legal form, or no such name."""
    k = F.col("c_custkey") % 1000 + 1
    name = F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))
    kind = F.col("c_custkey") % 5
    text = F.when(kind == 0, name).when(kind == 1, F.concat(F.upper(name), F.lit(", Inc"))).when(kind == 2, F.concat(F.lit("The \"Alias\" "), k.cast("string"))).when(kind == 3, F.concat(F.lit("the alias "), k.cast("string"), F.lit(" GmbH Corp"))).otherwise(F.lit("nobody"))
    targets = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), text.alias("target"))
    aliases = A.companies(spark, sf_dir).select("company_id", F.concat(F.lit("The Alias "), F.col("company_id").cast("string")).alias("alias"))
    return RS.match_targets(targets, A.companies(spark, sf_dir), aliases).select("row_id", "company_id")


@query("""SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 4 = 0 THEN 'own.com' ELSE d.v END AS domain, u.v AS profile_url FROM customer
  LEFT JOIN (SELECT o_custkey, arg_min('d' || o_orderkey || '.com', o_orderkey) AS v FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL) d ON d.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, arg_min('u' || o_orderkey, o_orderkey) AS v FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL) u ON u.o_custkey = c_custkey""")
def candidate_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    stated = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), k.alias("load_order"), F.when(k % 3 > 0, F.concat(F.lit("d"), k.cast("string"), F.lit(".com"))).otherwise(" ").alias("domain"), F.when(k % 5 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("profile_url"))
    mine = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), F.when(F.col("c_custkey") % 4 == 0, "own.com").alias("domain"))
    return RS.candidate_hints(mine, stated)


# --- lookups ----------------------------------------------------------------


@query("""SELECT c_custkey AS row_id, s_suppkey AS company_id, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM customer JOIN supplier ON s_suppkey = c_custkey % 1000 + 1""")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that a domain, a profile URL or a name ties to a company; keys of lower rank point elsewhere."""
    k, other = F.col("c_custkey") % 1000 + 1, (F.col("c_custkey") + 7) % 1000 + 1
    text = lambda p, c, s="": F.concat(F.lit(p), c.cast("string"), F.lit(s))
    kind = F.col("c_custkey") % 3
    left = A.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.when(kind == 0, text("http://www.d", k, ".com/a")).alias("domain"), F.when(kind == 0, text("s", other)).when(kind == 1, text("https://linkedin.com/company/s", k)).alias("slug"), F.when(kind == 2, text("Firm ", k, " Inc")).otherwise(text("firm ", other)).alias("name")
    )
    right = A.companies(spark, sf_dir).select("company_id", text("d", F.col("company_id"), ".com").alias("domain"), text("s", F.col("company_id")).alias("slug"), text("Firm ", F.col("company_id")).alias("name"))
    hit = RS.lookup_first(RS.keyed(left, "row_id", "domain", "slug", "name"), RS.keyed(right, "company_id", "domain", "slug", "name"), "row_id", "company_id")
    known = A.companies(spark, sf_dir).select("company_id")
    wanted = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), k.alias("company_id"))
    return hit.join(wanted.join(known, "company_id", "left_semi"), ["row_id", "company_id"], "left_semi")


@query("""SELECT o_orderkey AS row_id, CASE WHEN s1.s_suppkey IS NOT NULL THEN s1.s_name ELSE s2.s_name END AS name FROM orders
  LEFT JOIN supplier s1 ON s1.s_suppkey = o_custkey LEFT JOIN supplier s2 ON s2.s_suppkey = o_orderkey % 100 + 1""")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.array(F.col("o_custkey").cast("long"), (F.col("o_orderkey") % 100 + 1).cast("long")).alias("keys"))
    entries = A.companies(spark, sf_dir).select(F.col("company_id").cast("long").alias("key"), "name")
    return RS.ordered_lookup(left, "keys", entries, "key", "name").select("row_id", "name")


_FROM_CANDIDATE = "SELECT l_orderkey AS row_id, l_linenumber AS line, l_extendedprice AS price, coalesce(CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END) AS company_id FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"


def _from_candidate(spark: SparkSession, sf_dir: str, fill) -> DataFrame:
    own = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey"))
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("candidate_id"), own.alias("company_id"))
    candidates = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("company_id"))
    return fill(rows, candidates).select("row_id", "line", "price", "company_id")


@query(_FROM_CANDIDATE)
def backfill_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_candidate(spark, sf_dir, PR.backfill_company)


@query(_FROM_CANDIDATE)
def event_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_candidate(spark, sf_dir, RS.event_company)


@query("SELECT l_suppkey AS company_id, l_returnflag || l_partkey AS alias FROM lineitem GROUP BY ALL HAVING max(l_quantity) < 40")
def alias_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that lines state and that no line of a large quantity has stored before."""
    rows = A.table(spark, sf_dir, "lineitem")
    named = lambda df: df.select(F.col("l_suppkey").alias("company_id"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("alias"))
    return RS.missing_keys(named(rows), named(rows.where("l_quantity >= 40")), ["company_id", "alias"])


@query("SELECT company_id, tier FROM (SELECT s_suppkey AS company_id, 'P' || (s_nationkey % 3) AS tier, row_number() OVER (ORDER BY 'P' || (s_nationkey % 3), s_suppkey) - 1 AS n FROM supplier) WHERE n % 4 = 1")
def cohort_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of four shards, which is the feature."""
    return RS.shard(A.companies(spark, sf_dir).select("company_id", "tier"), ["tier", "company_id"], 2, 4)


# --- upkeep -----------------------------------------------------------------


@query(sql("SELECT c.company_id FROM company c WHERE company_id NOT IN (SELECT company_id FROM (SELECT company_id, arg_max(value_point, (anchor_month, anchor_id)) AS v FROM anchors0 WHERE anchor_type = 'current_headcount_anchor' AND company_id % 3 > 0 GROUP BY ALL) WHERE v > 0)", 1))
def missing_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.missing_current(A.companies(spark, sf_dir), A.anchors(spark, sf_dir).where("company_id % 3 > 0")).select("company_id")


@query("SELECT s_suppkey AS company_id, CASE s_suppkey % 3 WHEN 0 THEN 'kept' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'found' || s_suppkey END END AS profile_url FROM supplier")
def profile_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("company_id")
    mine = A.companies(spark, sf_dir).select("company_id", F.when(k % 3 == 0, "kept").when(k % 3 == 1, " ").alias("profile_url"))
    found = A.companies(spark, sf_dir).where(k % 2 == 0).select("company_id", F.concat(F.lit("found"), k.cast("string")).alias("resolved_url"))
    return PR.fill_profile_urls(mine, found)


@query(sql("SELECT 'observations' AS what, source_name, count(*) AS n FROM anchors0 WHERE source_name <> 'R' GROUP BY ALL UNION ALL SELECT 'anchors', source_name, count(*) FROM anchors0 WHERE source_name <> 'R' GROUP BY ALL", 1))
def purge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.anchors(spark, sf_dir).withColumn("observation_id", F.col("anchor_id"))
    seen, kept = PR.purge_sources(rows.select("observation_id", "source_name"), rows, ("R",))
    count = lambda df, what: df.groupBy(F.lit(what).alias("what"), "source_name").agg(F.count("*").alias("n"))
    return count(seen, "observations").unionByName(count(kept, "anchors"))


@query(sql("SELECT l_suppkey AS company_id, l_returnflag AS source_name, l_partkey AS page, min(l_quantity) AS first_size FROM lineitem GROUP BY ALL HAVING l_partkey % 5 > 0", 1))
def new_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of lines, one a company, source and page; those of every fifth page are stored already."""
    page = F.col("l_partkey").cast("string")
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company_id"), F.col("l_returnflag").alias("source_name"), F.col("l_quantity").alias("first_size"), F.concat(F.lit("u"), page).alias("url"), F.lit("t").alias("text"), F.col("l_partkey").alias("page"))
    none = rows.limit(0).withColumn("content_hash", F.lit(""))
    there = TB.new_signals(rows.where("page % 5 = 0"), none)
    return TB.new_signals(rows, there).select("company_id", "source_name", "page", "first_size")


@query("""SELECT o_orderkey AS row_id, CASE o_custkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 1000000 ELSE o_custkey + 2000000 END AS company_id FROM orders JOIN customer ON c_custkey = o_custkey""")
def merge_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a snapshot whose customers we know by name and domain, by name, or by alias."""
    k = F.col("c_custkey")
    theirs = A.table(spark, sf_dir, "customer").select(k.alias("company_id"), F.col("c_name").alias("name"), F.concat(F.lit("d"), k.cast("string")).alias("domain"))
    ours = theirs.where("company_id % 3 = 0").unionByName(theirs.where("company_id % 3 = 1").select((F.col("company_id") + 1000000).alias("company_id"), "name", F.lit("else").alias("domain")))
    aliases = theirs.where("company_id % 3 = 2").select((F.col("company_id") + 2000000).alias("company_id"), F.col("name").alias("alias"))
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("long").alias("company_id"))
    return TB.remap_companies(rows, theirs, ours, aliases)


@query(sql("""SELECT hint_id, CASE WHEN kind = 'layoff' THEN 'unmapped' WHEN company_id % 11 = 0 THEN 'no_company' WHEN l_quantity::INT % 13 = 0 THEN 'no_month' WHEN there THEN 'duplicate' WHEN n = 1 THEN 'promoted' ELSE 'duplicate' END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, kind, ship_month, fine ORDER BY hint_id) AS n FROM (
    SELECT id AS hint_id, l_suppkey AS company_id, ship_month, l_quantity, CASE l_returnflag WHEN 'A' THEN 'acquisition' WHEN 'N' THEN 'rebrand' ELSE 'layoff' END AS kind,
      l_returnflag <> 'R' AND l_suppkey % 11 > 0 AND l_quantity::INT % 13 > 0 AS fine,
      EXISTS (SELECT 1 FROM events0 e WHERE e.company_id = l_suppkey AND e.event_month = ship_month AND e.event_type = CASE l_returnflag WHEN 'A' THEN 'acquisition' WHEN 'N' THEN 'rebrand' ELSE 'layoff' END) AS there
    FROM lin WHERE l_linenumber = 5))""", 1))
def hint_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.lines(spark, sf_dir).where("l_linenumber = 5")
    hints = rows.select(
        F.col("id").alias("hint_id"), F.when(F.col("l_suppkey") % 11 > 0, F.col("l_suppkey")).alias("company_id"), A.by_flag("acquisition", "rebrand", "layoff").alias("hint_type"), F.when(F.col("l_quantity") % 13 > 0, F.col("ship_month")).alias("event_month"),
        F.lit("note").alias("description"), F.lit("pending").alias("status"),
    )
    return EV.promote_hints(hints, A.events(spark, sf_dir))["status"].select("hint_id", "status")


# --- reading ----------------------------------------------------------------


@query(sql("SELECT company_id, month, round(value_point, 4) AS value_point FROM stored WHERE company_id % 2 = 1 AND month BETWEEN DATE '1998-03-01' AND DATE '2000-06-01'", 6, dates=("month",)))
def series_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months from March 1998 to June 2000 of the asked companies, which is the feature."""
    asked = A.companies(spark, sf_dir).where("company_id % 2 = 1")
    return rounded(RD.series_range(stored(spark, sf_dir), asked, "1998-03-01", "2000-06-01").select("company_id", "month", "value_point"), "value_point")


@query("SELECT s_suppkey AS company_id, s_name AS name FROM supplier WHERE s_nationkey % 3 = 1 ORDER BY s_name, s_suppkey LIMIT 10 OFFSET 1")
def company_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page is the feature."""
    return RD.company_page(A.companies(spark, sf_dir), "P1", 10, 1).select("company_id", "name")


@query("SELECT l_returnflag AS run_id, l_linenumber::VARCHAR AS stage, l_linestatus AS status, count(DISTINCT l_suppkey) AS companies FROM lineitem GROUP BY ALL")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run_id"), F.col("l_linenumber").cast("string").alias("stage"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("company_id"))
    return RD.stage_counts(rows)


@query(sql("SELECT company_id, version_id, strftime(created_at, '%Y-%m-%d') AS created_at FROM (SELECT l_suppkey AS company_id, id AS version_id, l_shipdate AS created_at, l_returnflag AS run_id FROM lin WHERE l_linenumber = 4) ORDER BY created_at DESC, company_id, version_id LIMIT 50", 1))
def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty of a log, which is the feature."""
    return RD.newest(A.versions(spark, sf_dir), "created_at", 50).select("company_id", "version_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


@query(sql("""SELECT id AS override_id, l_suppkey AS company_id, CASE l_returnflag WHEN 'A' THEN 'current_anchor' WHEN 'N' THEN 'estimate_suppress_window' ELSE 'event_segment' END AS field_name, l_discount <> 0.1 AS active, CASE WHEN l_returnflag = 'A' THEN ship_month END AS anchor_month,
  CASE WHEN l_returnflag = 'A' THEN l_quantity * 10 END AS value_point, CASE WHEN l_returnflag = 'N' THEN ship_month END AS start_month, CASE WHEN l_returnflag = 'N' THEN (ship_month + INTERVAL 2 MONTH)::DATE END AS end_month, CASE WHEN l_returnflag = 'R' THEN ship_month END AS event_month, CASE WHEN l_returnflag = 'R' THEN 'merger' END AS event_type
  FROM lin WHERE l_linenumber = 3 AND l_quantity = 50""", 1, dates=("anchor_month", "start_month", "end_month", "event_month")))
def flat_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RD.flat_overrides(A.overrides(spark, sf_dir), now()).drop("reason")


# --- review -----------------------------------------------------------------


def _queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A queue of lines 1 of orders and candidates of lines 2: one item an order."""
    rows = A.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    item = (k.alias("company_id"), F.lit("anomaly").alias("reason"), F.lit("v1").alias("version_id"))
    status = F.element_at(F.array(*map(F.lit, ("open", "assigned", "resolved", "dismissed"))), (k % 4 + 1).cast("int"))
    queue = rows.where("o_orderkey % 7 > 0").select(*item, (k % 90).cast("int").alias("priority"), status.alias("status"), F.lit("old").alias("detail"), F.when(k % 4 == 1, "ann").alias("assignee"), F.lit("2000-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    new = rows.where("o_orderkey % 3 > 0").select(*item, (k % 90 + k % 2).cast("int").alias("priority"), F.lit("old").alias("detail"))
    return queue, new


@query("""SELECT o_orderkey AS company_id, (o_orderkey % 90 + CASE WHEN o_orderkey % 3 > 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 4 < 2) THEN o_orderkey % 2 ELSE 0 END)::INT AS priority,
  CASE WHEN o_orderkey % 7 = 0 THEN 'open' ELSE (['open', 'assigned', 'resolved', 'dismissed'])[o_orderkey % 4 + 1] END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN 'inserted' WHEN o_orderkey % 3 = 0 THEN 'kept' WHEN o_orderkey % 4 >= 2 THEN 'skipped' WHEN o_orderkey % 2 = 1 THEN 'refreshed' ELSE 'skipped' END AS action
  FROM orders WHERE o_orderkey % 7 > 0 OR o_orderkey % 3 > 0""")
def queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, new = _queue(spark, sf_dir)
    return R.upsert(queue, new, now()).select("company_id", "priority", "status", "action")


@query("""SELECT o_orderkey AS company_id, (['open', 'assigned', 'resolved', 'nowhere'])[o_orderkey % 5 % 4 + 1] AS to_status,
  CASE WHEN o_orderkey % 7 = 0 THEN 'no_such_item' WHEN o_orderkey % 5 % 4 = 3 THEN 'unknown_status' WHEN o_orderkey % 5 % 4 = 1 AND o_orderkey % 2 = 0 THEN 'assignee_required' ELSE 'applied' END AS outcome FROM orders""")
def queue_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, _ = _queue(spark, sf_dir)
    k = F.col("o_orderkey")
    to = F.element_at(F.array(*map(F.lit, ("open", "assigned", "resolved", "nowhere"))), (k % 5 % 4 + 1).cast("int"))
    asked = A.table(spark, sf_dir, "orders").select(k.alias("company_id"), F.lit("anomaly").alias("reason"), F.lit("v1").alias("version_id"), to.alias("to_status"), F.when(k % 2 == 1, "bob").otherwise(" ").alias("assignee"), F.lit("me").alias("actor"), F.lit(1).alias("request_no"))
    return R.apply_transitions(queue, asked, now())["audit"].select("company_id", "to_status", "outcome")


@query("""SELECT status, count(*) AS items FROM (SELECT CASE WHEN o_orderkey % 5 % 4 = 3 OR (o_orderkey % 5 % 4 = 1 AND o_orderkey % 2 = 0) THEN (['open', 'assigned', 'resolved', 'dismissed'])[o_orderkey % 4 + 1] ELSE (['open', 'assigned', 'resolved'])[o_orderkey % 5 % 4 + 1] END AS status FROM orders WHERE o_orderkey % 7 > 0) GROUP BY ALL""")
def queue_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of the queue after the transitions of `queue_transitions`."""
    queue, _ = _queue(spark, sf_dir)
    k = F.col("o_orderkey")
    to = F.element_at(F.array(*map(F.lit, ("open", "assigned", "resolved", "nowhere"))), (k % 5 % 4 + 1).cast("int"))
    asked = A.table(spark, sf_dir, "orders").select(k.alias("company_id"), F.lit("anomaly").alias("reason"), F.lit("v1").alias("version_id"), to.alias("to_status"), F.when(k % 2 == 1, "bob").otherwise(" ").alias("assignee"), F.lit("me").alias("actor"), F.lit(1).alias("request_no"))
    return R.status_counts(R.apply_transitions(queue, asked, now())["queue"])


@query("SELECT DISTINCT o_orderkey AS company_id FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 > 0")
def queue_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, new = _queue(spark, sf_dir)
    return R.enqueue_once(new, queue, R.KEY).select("company_id")


# --- texts ------------------------------------------------------------------


@query("""SELECT o_orderkey AS row_id, strftime(a, '%Y-%m-%d') AS start_month, CASE WHEN o_orderkey % 3 > 0 THEN strftime(b, '%Y-%m-%d') END AS end_month, o_orderkey % 3 = 0 AS end_open
  FROM (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS a, date_trunc('month', o_orderdate + to_months((o_orderkey % 40)::INT))::DATE AS b FROM orders) WHERE o_orderkey % 5 > 0""")
def month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as people write them; every fifth is inverted or no span and gives no row."""
    k = F.col("o_orderkey")
    first, last = F.date_format("o_orderdate", "MMMM yyyy"), F.date_format(F.add_months("o_orderdate", (k % 40).cast("int")), "yyyy-MM")
    text = F.when(k % 5 == 0, F.when(k % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit(" to "), F.date_format(F.add_months("o_orderdate", -1), "yyyy-MM"))).otherwise(F.lit("soon"))).when(k % 3 == 0, F.concat(first, F.lit(" - Present"))).otherwise(F.concat(first, F.when(k % 2 == 0, F.lit(" to ")).otherwise(F.lit(" – ")), last))
    rows = A.table(spark, sf_dir, "orders").select(k.alias("row_id"), T.month_range(text, 2030).alias("r")).where("r is not null")
    return rows.select("row_id", F.col("r.start").alias("start_month"), F.col("r.end").alias("end_month"), "r.end_open")


@query("""SELECT o_orderkey AS row_id, CASE o_orderkey % 4 WHEN 0 THEN 'acquisition' WHEN 1 THEN 'rebrand' ELSE 'unknown' END AS hint_type, CASE WHEN o_orderkey % 4 < 3 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') END AS event_month FROM orders WHERE o_orderkey % 6 > 0""")
def note_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, when = F.col("o_orderkey"), F.date_format("o_orderdate", "MMMM yyyy")
    text = F.when(k % 6 == 0, " ").when(k % 4 == 0, F.concat(F.lit("was acquired in "), when)).when(k % 4 == 1, F.concat(F.lit("Rebranded, "), when)).when(k % 4 == 2, F.concat(F.lit("checked "), when)).otherwise(F.lit("no month known"))
    rows = A.table(spark, sf_dir, "orders").select(k.alias("row_id"), T.note_hint(text).alias("h")).where("h is not null")
    return rows.select("row_id", "h.hint_type", "h.event_month")


def _exported(df: DataFrame, fmt: str) -> DataFrame:
    """The rows after an export and reading the file again."""
    path = TB.scratch(df.sparkSession)
    TB.export(df, path, fmt)
    reader = df.sparkSession.read.schema(df.schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else getattr(reader, fmt)(path)


@query(sql("SELECT 'monthly_series' AS what, count(*) AS n, round(sum(value_point), 4) AS total FROM (SELECT near_v AS value_point FROM (SELECT round(value_point, 4) AS near_v FROM stored)) UNION ALL SELECT 'anchors', count(*), round(sum(value_point), 4) FROM anchors0 UNION ALL SELECT 'growth_windows', count(*), 0 FROM latest", 7))
def exported_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series as csv, anchors as json and newest growth as parquet, read back and counted."""
    series = stored(spark, sf_dir)
    monthly = _exported(rounded(series.select("company_id", "month", "value_point", "method", "band"), "value_point"), "csv")
    anchors = _exported(A.anchors(spark, sf_dir), "json")
    growth = _exported(G.latest_growth(series), "parquet")
    count = lambda df, what, total: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"), total.alias("total"))
    rows = count(monthly, "monthly_series", F.sum("value_point")).unionByName(count(anchors, "anchors", F.sum("value_point"))).unionByName(count(growth, "growth_windows", F.lit(0.0)))
    return rows.withColumn("total", near("total"))


@query(sql("""SELECT name, round(value_point, 4) AS headcount, max(CASE WHEN horizon = '1y' THEN round(growth_point, 4) END) AS growth_1y, max(CASE WHEN horizon = '6m' THEN round(growth_point, 4) END) AS growth_6m
FROM company JOIN (SELECT company_id, value_point FROM stored QUALIFY month = max(month) OVER (PARTITION BY company_id)) USING (company_id) LEFT JOIN latest USING (company_id) GROUP BY ALL"""))
def growth_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth report written as CSV and read back."""
    path = TB.scratch(spark)
    report = RD.growth_report(A.companies(spark, sf_dir), stored(spark, sf_dir))
    RD.write_growth_csv(rounded(report, "headcount", "growth_1y", "growth_6m"), path)
    file = spark.read.schema(", ".join(f"`{h}` {'string' if c == 'name' else 'double'}" for c, h in RD.GROWTH_HEADINGS.items())).option("header", True).csv(path)
    return file.toDF(*RD.GROWTH_HEADINGS)


@query("""SELECT o_orderkey AS request_no, o_custkey AS company_id, CASE WHEN o_orderkey % 4 = 3 THEN 'unknown_field' WHEN s_suppkey IS NULL THEN 'company_not_found' ELSE 'created' END AS outcome,
  CASE WHEN outcome = 'created' THEN 'clerk ' || (o_orderkey % 9) END AS actor_id FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey""")
def override_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests for overrides; customers that are no supplier have no company."""
    k = F.col("o_orderkey")
    field = F.element_at(F.array(*map(F.lit, ("current_anchor", "estimate_suppress_window", "event_segment", "colour"))), (k % 4 + 1).cast("int"))
    clerk = F.concat(F.lit("clerk "), (k % 9).cast("string"))
    asked = A.table(spark, sf_dir, "orders").select(k.alias("request_no"), F.col("o_custkey").alias("company_id"), field.alias("field_name"), F.lit("{}").alias("payload"), F.lit("checked").alias("reason"), clerk.alias("entered_by"), F.lit(None).cast("timestamp").alias("expires_at"))
    made = OV.create(asked, A.companies(spark, sf_dir), now())
    ids = made["overrides"].join(made["audit"], F.col("override_id") == F.col("target_id")).select("override_id", "actor_id")
    named = asked.withColumn("override_id", natural_id("company_id", "field_name", "request_no")).select("request_no", "override_id")
    return made["outcomes"].join(named.join(ids, "override_id"), "request_no", "left").select("request_no", "company_id", "outcome", "actor_id")


@query("""WITH o AS (SELECT o_orderkey AS id, (['company_web', 'sec', 'benchmark', 'wayback', 'other'])[o_orderkey % 5 + 1] AS src, o_custkey AS h, o_custkey % 40 + 1 AS their, o_orderkey % 7 > 0 AS anchored FROM orders),
m AS (SELECT o.*, s_suppkey AS ours, src IN ('company_web', 'sec', 'wayback') AS allowed, src = 'sec' AND h % 11 = 0 AS there FROM o LEFT JOIN supplier ON s_suppkey = their AND their % 5 > 0),
j AS (SELECT *, min(CASE WHEN allowed AND NOT there AND anchored AND ours IS NOT NULL THEN id END) OVER (PARTITION BY src, h) AS first FROM m)
SELECT id AS observation_id, CASE WHEN NOT allowed THEN 'skipped_source' WHEN there OR coalesce(first < id, false) THEN 'skipped_dup' WHEN NOT anchored THEN 'no_anchor' WHEN ours IS NULL THEN 'skipped_unmapped' ELSE 'merged' END AS outcome,
  CASE WHEN outcome = 'merged' THEN ours END AS company_id FROM j""")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of another snapshot whose companies have our names in capitals, but every fifth."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    source = F.element_at(F.array(*map(F.lit, ("company_web", "sec", "benchmark", "wayback", "other"))), (k % 5 + 1).cast("int"))
    rows = A.table(spark, sf_dir, "orders").select(k.alias("observation_id"), source.alias("source_name"), F.col("o_custkey").cast("string").alias("content_hash"), (F.col("o_custkey") % 40 + 1).alias("company_id"))
    anchors = rows.where("observation_id % 7 > 0").select(F.col("observation_id").alias("anchor_id"), "observation_id", "company_id")
    name = F.when(c % 5 == 0, F.lit("Nobody")).otherwise(F.concat(F.lit(" SUPPLIER#"), F.lpad(c.cast("string"), 9, "0")))
    theirs = A.table(spark, sf_dir, "customer").select(c.alias("company_id"), name.alias("name"), F.when(c % 3 == 0, "x.com").alias("domain"))
    k = F.col("s_suppkey")
    ours = A.table(spark, sf_dir, "supplier").select(k.alias("company_id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, "x.com").alias("domain"))
    stored_rows = rows.where("source_name = 'sec' AND cast(content_hash AS bigint) % 11 = 0").select("source_name", "content_hash")
    aliases = ours.select("company_id", F.lit(None).cast("string").alias("alias"))
    return PR.consolidate(rows.drop("company_id"), anchors, theirs, ours, aliases, stored_rows, ("company_web", "sec", "wayback"))["judged"]
