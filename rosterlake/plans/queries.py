"""Registered queries of the estimation engine: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.functions import text as T
from rosterlake.operators import confidence as C
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
from rosterlake.plans.estimate import Estimate, estimate, outcome
from rosterlake.plans.incremental import refresh, refreshed
from rosterlake.plans.oracle import sql
from rosterlake.sources import tables as TB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows; dates come out as ISO text."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"})

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return run

    return add


def now():
    return F.lit(A.NOW).cast("timestamp")


def full(spark: SparkSession, sf_dir: str) -> Estimate:
    t = [f(spark, sf_dir) for f in (A.companies, A.employment, A.anchors, A.events, A.overrides)]
    return estimate(*t, A.WINDOW, now())


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored series of these tables in the shared folder, brought up to date: companies whose inputs did not change are not estimated again."""
    place = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    return refreshed(full(spark, sf_dir), f"{TB.shared_folder(spark)}/estimates-{place}", buckets=16)


def near(c: str) -> Column:
    """Four digits, with ties far from where exact results fall; as `oracle.near`."""
    return F.floor(F.col(c) * 10000.0 + 0.50001) / 10000.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: near(c) for c in columns})


_R = "round(value_min, 4) AS value_min, round(value_point, 4) AS value_point, round(value_max, 4) AS value_max"
_VALUES = ("value_min", "value_point", "value_max")


@query(sql("SELECT company_id, month, horizon, round(growth_point, 4) AS growth_point, round(growth_min, 4) AS growth_min, round(growth_max, 4) AS growth_max, round(delta, 4) AS delta FROM latest", dates=("month",)))
def growth_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.latest_growth(stored(spark, sf_dir)).select("company_id", "month", "horizon", "growth_point", "growth_min", "growth_max", "delta")
    return rounded(rows, "growth_point", "growth_min", "growth_max", "delta")


@query(sql("SELECT company_id, month, profiles FROM counts", 2, dates=("month",)))
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.profile_counts(A.employment(spark, sf_dir), A.companies(spark, sf_dir), A.WINDOW)


@query(sql("SELECT company_id, segment_no, segment_start, segment_end, array_to_string(opening_types, ',') AS opening_types FROM segments", 3, dates=("segment_start", "segment_end")))
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = full(spark, sf_dir)
    return e.segments.select("company_id", F.col("segment_no").cast("long").alias("segment_no"), "segment_start", "segment_end", F.array_join("opening_types", ",").alias("opening_types"))


@query(sql("SELECT c.company_id, c.month, segment_no, segment_start, segment_end FROM spine c JOIN segments g ON g.company_id = c.company_id AND c.month BETWEEN segment_start AND segment_end", 3, dates=("month", "segment_start", "segment_end")))
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = full(spark, sf_dir)
    return S.segment_of(e.segments, e.counts.select("company_id", "month")).withColumn("segment_no", F.col("segment_no").cast("long"))


@query(sql("SELECT c.company_id, c.month, segment_no, segment_start, segment_end FROM spine c JOIN segments g ON g.company_id = c.company_id AND c.month BETWEEN segment_start AND segment_end", 3, dates=("month", "segment_start", "segment_end")))
def segment_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`segment_lookup` for every company-month."""
    e = full(spark, sf_dir)
    return S.segment_of(e.segments, e.counts.select("company_id", "month")).withColumn("segment_no", F.col("segment_no").cast("long"))


@query(sql(f"SELECT company_id, segment_no, anchor_month, {_R}, n_top, n_point, precise AS has_precise FROM reconciled", 4, dates=("anchor_month",)))
def anchors_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full(spark, sf_dir).reconciled.select("company_id", F.col("segment_no").cast("long").alias("segment_no"), "anchor_month", *_VALUES, "n_top", "n_point", "has_precise")
    return rounded(rows, *_VALUES)


@query(sql("SELECT company_id, segment_no, anchor_month, anchor_id FROM best", 5, dates=("anchor_month",)))
def best_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_anchor_a_month(full(spark, sf_dir).placed).select("company_id", F.col("segment_no").cast("long").alias("segment_no"), "anchor_month", "anchor_id")


@query(sql("SELECT company_id, segment_no, month, round(i_min, 4) AS i_min, round(i_point, 4) AS i_point, round(i_max, 4) AS i_max, distance AS i_distance FROM interpolated", 5, dates=("month",)))
def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = full(spark, sf_dir)
    months = S.calendar(e.segments, F.col("segment_start"), F.col("segment_end")).select("company_id", "segment_no", "month")
    rows = S.interpolate(months, S.best_anchor_a_month(e.placed)).select("company_id", F.col("segment_no").cast("long").alias("segment_no"), "month", "i_min", "i_point", "i_max", F.col("i_distance").cast("long").alias("i_distance"))
    return rounded(rows, "i_min", "i_point", "i_max")


_SERIES = f"company_id, segment_no, month, {_R}, profiles, round(anchor_value, 4) AS anchor_value, method, band, needs_review, suppression_reason, round(coverage_factor, 4) AS coverage_factor, round(ratio, 4) AS ratio, anchor_month"


def _series(df: DataFrame) -> DataFrame:
    rows = df.withColumn("segment_no", F.col("segment_no").cast("long")).drop("contributing_ids")
    return rounded(rows, *_VALUES, "anchor_value", "coverage_factor", "ratio")


@query(sql(f"SELECT {_SERIES} FROM raw", 5, dates=("month", "anchor_month")))
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(full(spark, sf_dir).raw)


@query(sql(f"SELECT {_SERIES}, suppressed_by FROM series", 5, dates=("month", "anchor_month")))
def suppressed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(full(spark, sf_dir).series)


_FLAGS = "interval_too_wide, sample_floor_violation, mom_jump, non_monotonic_interval, coverage_floor_hit"


@query(sql(f"SELECT company_id, month, {_FLAGS} FROM flags", 6, dates=("month",)))
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, sf_dir).scored.select("company_id", "month", *_FLAGS.split(", "))


@query(sql("SELECT company_id, month, round(score, 4) AS score, score_band FROM scored", 6, dates=("month",)))
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(full(spark, sf_dir).scored.select("company_id", "month", "score", "score_band"), "score")


_PARTS = ("anchor_source_quality", "anchor_recency", "anchor_agreement", "sample_coverage", "event_proximity", "multi_source_corroboration")


@query(sql("SELECT company_id, component, round(avg(value), 4) AS average, count(*) AS n_months FROM (" + " UNION ALL ".join(f"SELECT company_id, '{p}' AS component, {p}::DOUBLE AS value FROM parts" for p in _PARTS) + ") GROUP BY ALL", 6))
def component_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.component_averages(full(spark, sf_dir).scored), "average")


@query(sql(f"SELECT company_id, month, {_R}, profiles, method, band, needs_review, round(score, 4) AS score FROM stored", 6, dates=("month",)))
def estimates_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir).select("company_id", "month", *_VALUES, "profiles", "method", "band", "needs_review", "score")
    return rounded(rows, *_VALUES, "score")


@query(sql("SELECT (SELECT count(*) FROM company) AS attempted, (SELECT count(*) FROM company) - count(DISTINCT company_id) AS failed, count(DISTINCT company_id) FILTER (WHERE needs_review) AS degraded, CASE WHEN (SELECT count(*) FROM company) - count(DISTINCT company_id) > 0 OR count(*) FILTER (WHERE needs_review) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM series", 5))
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome(full(spark, sf_dir).series, A.companies(spark, sf_dir))


@query(sql("SELECT company_id, month, prev_month, horizon, round(growth_min, 4) AS growth_min, round(growth_point, 4) AS growth_point, round(growth_max, 4) AS growth_max, round(delta, 4) AS delta FROM growth", dates=("month", "prev_month")))
def growth_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.growth_series(stored(spark, sf_dir)), "growth_min", "growth_point", "growth_max", "delta")


_WINDOWS = """
ends AS (
  SELECT s.*, h.n, h.label FROM stored s SEMI JOIN last_month USING (company_id, month), (VALUES (6, '6m'), (12, '1y'), (24, '2y')) AS h(n, label)
), wins AS (
  SELECT e.company_id, e.label AS horizon, (e.month - to_months(e.n))::DATE AS start_month, e.month AS end_month, s.value_min AS s_min, s.value_point AS s_point, s.value_max AS s_max, e.value_min AS e_min, e.value_point AS e_point, e.value_max AS e_max, e.band AS e_band, s.band AS s_band,
    CASE WHEN s.method IS NULL THEN 'no_start_month' WHEN e.method IN ('suppressed_low_sample', 'degraded_current_only') OR e.value_point <= 0 THEN 'end_not_usable' WHEN s.method IN ('suppressed_low_sample', 'degraded_current_only') OR s.value_point <= 0 THEN 'start_not_usable' END AS suppressed_reason,
    ['high', 'medium', 'low', 'manual_review_required'] AS bands
  FROM ends e LEFT JOIN stored s ON s.company_id = e.company_id AND s.month = (e.month - to_months(e.n))::DATE
)"""


@query(sql("""SELECT company_id, horizon, start_month, end_month, suppressed_reason, CASE WHEN suppressed_reason IS NULL THEN round(s_point, 4) END AS start_value, CASE WHEN suppressed_reason IS NULL THEN round(e_point, 4) END AS end_value,
  CASE WHEN suppressed_reason IS NULL THEN round(e_min / greatest(s_max, 1e-9) - 1, 4) END AS growth_min, CASE WHEN suppressed_reason IS NULL THEN round(e_point / greatest(s_point, 1e-9) - 1, 4) END AS growth_point, CASE WHEN suppressed_reason IS NULL THEN round(e_max / greatest(s_min, 1e-9) - 1, 4) END AS growth_max,
  CASE WHEN suppressed_reason IS NULL THEN bands[greatest(list_position(bands, e_band), list_position(bands, s_band))] ELSE 'manual_review_required' END AS band FROM wins""", 7, _WINDOWS, dates=("start_month", "end_month")))
def growth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.growth_windows(stored(spark, sf_dir)), "start_value", "end_value", "growth_min", "growth_point", "growth_max")


@query(sql("""SELECT company_id, event_type, event_month, event_id, round(CASE WHEN n > 1 THEN least(1, c) ELSE confidence END, 4) AS confidence, coalesce(description, CASE WHEN n > 1 THEN d END) AS description, n AS merged FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, event_type, event_month ORDER BY CASE source_class WHEN 'first_party' THEN 4 ELSE 3 END DESC, confidence DESC, created_at, event_id) AS k,
    max(confidence) OVER g AS c, count(*) OVER g AS n, first_value(description IGNORE NULLS) OVER (PARTITION BY company_id, event_type, event_month ORDER BY CASE source_class WHEN 'first_party' THEN 4 ELSE 3 END DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d
  FROM events0 WINDOW g AS (PARTITION BY company_id, event_type, event_month)) WHERE k = 1""", 1, dates=("event_month",)))
def event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(EV.merge_events(A.events(spark, sf_dir)).select("company_id", "event_type", "event_month", "event_id", "confidence", "description", "merged"), "confidence")


@query(sql("SELECT count(*) AS groups_considered, count(*) FILTER (WHERE n > 1) AS groups_collapsed, sum(n - 1)::BIGINT AS rows_deleted FROM (SELECT count(*) AS n FROM events0 GROUP BY company_id, event_type, event_month)", 1))
def event_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.merge_counts(A.events(spark, sf_dir))


@query(sql("SELECT company_id, 'pin' AS kind, anchor_month AS month, value_point AS value FROM pins UNION ALL SELECT company_id, 'window', start_month, NULL FROM windows UNION ALL SELECT company_id, 'event', event_month, NULL FROM synthetic", 1, dates=("month",)))
def override_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = OV.decode(A.overrides(spark, sf_dir), now())
    none = F.lit(None).cast("double").alias("value")
    pins = d["pins"].select("company_id", F.lit("pin").alias("kind"), F.col("anchor_month").alias("month"), F.col("value_point").alias("value"))
    return pins.unionByName(d["windows"].select("company_id", F.lit("window").alias("kind"), F.col("start_month").alias("month"), none)).unionByName(d["events"].select("company_id", F.lit("event").alias("kind"), F.col("event_month").alias("month"), none))


@query(sql("SELECT company_id, arg_max(id, (created_at, id)) AS version_id FROM (SELECT l_suppkey AS company_id, id, l_shipdate AS created_at FROM lin WHERE l_linenumber = 4) GROUP BY company_id", 1))
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest_version(A.versions(spark, sf_dir)).select("company_id", "version_id")


_OFFSETS = "CASE metric WHEN 'headcount_current' THEN 0 WHEN 'headcount_6m_ago' THEN 6 WHEN 'headcount_1y_ago' THEN 12 WHEN 'headcount_2y_ago' THEN 24 END"
_SCORED = f"""
met AS (
  SELECT b.company_id, benchmark_id, provider, metric, row_index, s.month, b.value_point AS benchmark_point, s.value_point AS estimate_point, s.band,
    CASE WHEN s.method = 'suppressed_low_sample' THEN true WHEN s.method = 'degraded_current_only' THEN metric <> 'headcount_current' ELSE s.band = 'manual_review_required' END AS skipped,
    NOT (s.value_max < b.value_min OR b.value_max < s.value_min) AS overlap, abs(b.value_point - s.value_point) AS gap
  FROM benchmark_rows b JOIN stored s ON s.company_id = b.company_id AND s.month = (b.as_of_month - to_months({_OFFSETS}))::DATE WHERE metric LIKE 'headcount%'
), judged AS (
  SELECT *, CASE WHEN NOT skipped THEN CASE WHEN overlap THEN 0 ELSE gap END END AS error, CASE WHEN NOT skipped THEN CASE WHEN overlap THEN 0 WHEN benchmark_point <> 0 THEN gap / abs(benchmark_point) END END AS error_pct,
    CASE WHEN NOT skipped THEN gap / greatest(1, abs(benchmark_point)) END AS ratio
  FROM met
), grown AS (
  SELECT b.company_id, benchmark_id, provider, metric[8:9] AS metric, b.value_point / 100 AS benchmark_ratio, growth_point AS estimate_ratio, growth_point IS NULL AS skipped, abs(growth_point - b.value_point / 100) AS error,
    CASE WHEN b.value_point <> 0 THEN abs(growth_point - b.value_point / 100) / abs(b.value_point / 100) END AS error_pct
  FROM benchmark_rows b LEFT JOIN latest l ON l.company_id = b.company_id AND l.horizon = b.metric[8:9] WHERE metric LIKE 'growth%' AND b.company_id IN (SELECT company_id FROM stored)
)"""
_ACCURACY = "SELECT provider, metric, count(error) AS n, round(avg(error), 4) AS mae, round(avg(error_pct), 4) AS mape, round(median(error), 4) AS median_abs_error, count(*) FILTER (WHERE skipped) AS skipped_declined FROM {0} GROUP BY ALL"


def as_of():
    return F.lit(A.WINDOW.as_of).cast("date")


@query(sql(f"""SELECT b.company_id, benchmark_id, provider, metric, s.month, b.value_point AS benchmark_point, round(s.value_point, 4) AS estimate_point, round(abs(b.value_point - s.value_point) / greatest(1, b.value_point), 4) AS relative_gap, NOT (s.value_max < b.value_min OR b.value_max < s.value_min) AS interval_overlap
  FROM benchmark_rows b JOIN stored s ON s.company_id = b.company_id AND s.month = (b.as_of_month - to_months({_OFFSETS}))::DATE WHERE metric LIKE 'headcount%' AND (abs(b.value_point - s.value_point) / greatest(1, b.value_point) > 0.25 OR s.value_max < b.value_min OR b.value_max < s.value_min)""", dates=("month",)))
def benchmark_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.disagreements(A.benchmark(spark, sf_dir), stored(spark, sf_dir), as_of_is_shifted=False)
    return rounded(rows, "estimate_point", "relative_gap")


@query(sql(_ACCURACY.format("judged"), 7, _SCORED))
def accuracy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.accuracy(E.scored_rows(A.benchmark(spark, sf_dir), stored(spark, sf_dir), as_of())), "mae", "mape", "median_abs_error")


@query(sql(_ACCURACY.format("grown"), 7, _SCORED))
def growth_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.accuracy(E.growth_rows(A.benchmark(spark, sf_dir), stored(spark, sf_dir))), "mae", "mape", "median_abs_error")


@query(sql("""SELECT provider, metric, n, CASE WHEN n >= 3 AND sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN round((sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)), 4) END AS rho
  FROM (SELECT provider, metric, count(*) AS n, sum(rx) AS sx, sum(ry) AS sy, sum(rx * rx) AS sxx, sum(ry * ry) AS syy, sum(rx * ry) AS sxy FROM (
    SELECT provider, metric, rank() OVER (PARTITION BY provider, metric ORDER BY estimate_ratio) + (count(*) OVER (PARTITION BY provider, metric, estimate_ratio) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY provider, metric ORDER BY benchmark_ratio) + (count(*) OVER (PARTITION BY provider, metric, benchmark_ratio) - 1) / 2 AS ry FROM grown WHERE NOT skipped) GROUP BY ALL)""", 7, _SCORED))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.growth_rows(A.benchmark(spark, sf_dir), stored(spark, sf_dir))
    return rounded(E.spearman(rows, ["provider", "metric"], "estimate_ratio", "benchmark_ratio"), "rho")


@query(sql("SELECT band, count(company_id) AS months FROM (VALUES ('high'), ('medium'), ('low'), ('manual_review_required')) AS b(band) LEFT JOIN stored USING (band) GROUP BY band", 6))
def band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.band_histogram(stored(spark, sf_dir))


@query(sql("SELECT company_id, benchmark_id, provider, metric, month, benchmark_point, round(estimate_point, 4) AS estimate_point, round(ratio, 4) AS ratio, overlap, band FROM judged WHERE ratio > 0.1 ORDER BY judged.ratio DESC, company_id, provider, metric, benchmark_id LIMIT 25", 7, _SCORED, dates=("month",)))
def top_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.top_disagreements(E.scored_rows(A.benchmark(spark, sf_dir), stored(spark, sf_dir), as_of()))
    return rounded(rows.select("company_id", "benchmark_id", "provider", "metric", "month", "benchmark_point", "estimate_point", "ratio", "overlap", "band"), "estimate_point", "ratio")


_BOARD = """
scope AS (
  SELECT c.company_id, bool_and(CASE WHEN method = 'suppressed_low_sample' THEN true WHEN method = 'degraded_current_only' THEN false ELSE band = 'manual_review_required' END) FILTER (WHERE s.company_id IS NOT NULL) AS all_declined, count(s.company_id) > 0 AS has FROM company c LEFT JOIN stored s USING (company_id) GROUP BY ALL
), refs AS (
  SELECT company_id, bool_or(provider = 'primary') AS prim FROM benchmark_rows GROUP BY ALL
), totals AS (
  SELECT count(*) AS companies_in_scope, count(*) FILTER (WHERE has) AS companies_evaluated, count(*) FILTER (WHERE prim IS NOT NULL) AS companies_with_benchmark, count(*) FILTER (WHERE all_declined) AS companies_declined,
    count(*) FILTER (WHERE has AND prim IS NOT NULL) AS both_n, count(*) FILTER (WHERE prim) AS cohort_size, count(*) FILTER (WHERE prim AND has) AS cohort_evaluated FROM scope LEFT JOIN refs USING (company_id)
)"""


@query(sql("""SELECT * EXCLUDE (both_n), (SELECT count(*) FROM judged WHERE band IN ('high', 'medium') AND ratio >= 1 AND provider = 'primary') AS high_confidence_disagreements, (SELECT count(*) FROM judged WHERE band IN ('high', 'medium') AND ratio >= 1 AND provider <> 'primary') AS supporting_disagreements,
  CASE WHEN companies_in_scope > 0 THEN round(companies_evaluated / companies_in_scope, 4) ELSE 0 END AS coverage_in_scope, CASE WHEN companies_with_benchmark > 0 THEN round(both_n / companies_with_benchmark, 4) ELSE 0 END AS coverage_with_benchmark FROM totals""", 7, _SCORED, _BOARD))
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scoreboard(A.companies(spark, sf_dir), A.benchmark(spark, sf_dir), stored(spark, sf_dir), as_of())


_COMPARED = f"""
cmp AS (
  SELECT b.company_id, count(*) AS compared, count(*) FILTER (WHERE abs(b.value_point - s.value_point) / greatest(1, b.value_point) > 0.25 OR s.value_max < b.value_min OR b.value_max < s.value_min) AS disagreements
  FROM benchmark_rows b JOIN stored s ON s.company_id = b.company_id AND s.month = (b.as_of_month - to_months({_OFFSETS}))::DATE WHERE metric LIKE 'headcount%' GROUP BY ALL
)"""


@query(sql("SELECT company_id, compared, disagreements, round(1 - disagreements / compared, 4) AS match_rate FROM cmp", 7, _COMPARED))
def benchmark_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.comparison(A.benchmark(spark, sf_dir), stored(spark, sf_dir), as_of_is_shifted=False), "match_rate")


_SIDE = f"""
tgt AS (
  SELECT company_id, provider, {", ".join(f"avg(value_point) FILTER (WHERE metric = 'headcount_{m}') AS target_{n}" for m, n in (("current", "now"), ("6m_ago", "6m"), ("1y_ago", "1y"), ("2y_ago", "2y")))} FROM benchmark_rows WHERE metric LIKE 'headcount%' GROUP BY ALL
), est AS (
  SELECT company_id, {", ".join(f"max(value_point) FILTER (WHERE month = DATE '{m}') AS estimate_{n}" for m, n in (("2001-11-01", "now"), ("2001-05-01", "6m"), ("2000-11-01", "1y"), ("1999-11-01", "2y")))} FROM stored GROUP BY ALL
)"""


@query(sql("SELECT company_id, provider, " + ", ".join(f"round({p}_{h}, 4) AS {p}_{h}" for p in ("target", "estimate") for h in ("now", "6m", "1y", "2y")) + ", " + ", ".join(f"CASE WHEN {p}_{h} > 0 THEN round(({p}_now / {p}_{h} - 1) * 100, 4) END AS {p}_growth_{h}" for p in ("target", "estimate") for h in ("6m", "1y", "2y")) + " FROM tgt LEFT JOIN est USING (company_id)", 7, _SIDE))
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.side_by_side(A.benchmark(spark, sf_dir), stored(spark, sf_dir), as_of())
    return rounded(rows, *(c for c in rows.columns if c not in ("company_id", "provider")))


_QUEUE = """
flagged AS (
  SELECT company_id, month, interval_too_wide::INT + sample_floor_violation::INT + mom_jump::INT + non_monotonic_interval::INT + coverage_floor_hit::INT > 0 AS flagged, score, score_band, suppressed_by FROM scored
), items AS (
  SELECT company_id, 'low_confidence' AS reason, count(*) AS months, 1 - min(score) AS severity, min(score) AS confidence, array_to_string(list(strftime(month, '%Y-%m-%d') ORDER BY month)[1:6], ',') AS first_months FROM flagged WHERE score_band IN ('low', 'manual_review_required') GROUP BY ALL
  UNION ALL SELECT company_id, 'anomaly', count(*), least(1, count(*) / greatest(1, max(n_seg) * 6)), NULL, NULL FROM flagged JOIN (SELECT company_id, count(*) AS n_seg FROM segments GROUP BY ALL) USING (company_id) WHERE flagged GROUP BY ALL
  UNION ALL SELECT company_id, 'manual', count(*), 0.3, NULL, array_to_string(list(strftime(month, '%Y-%m-%d') ORDER BY month)[1:6], ',') FROM flagged WHERE suppressed_by IS NOT NULL GROUP BY ALL
)"""


@query(sql("""SELECT company_id, reason, months, round(severity, 4) AS severity, first_months,
  least(99, greatest(0, CASE reason WHEN 'low_confidence' THEN 50 WHEN 'anomaly' THEN 55 ELSE 30 END + round_even(least(1, greatest(0, severity)) * 15, 0) + CASE WHEN confidence IS NULL THEN 0 ELSE round_even(least(1, greatest(0, 1 - confidence)) * 15, 0) END))::INT AS priority FROM items""", 6, _QUEUE))
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = full(spark, sf_dir)
    return rounded(R.candidates(TB.checkpointed(e.scored), e.segments).select("company_id", "reason", "months", "severity", "first_months", "priority"), "severity")


_TEXT = """
texts AS (
  SELECT p_partkey AS row_id, CASE p_partkey % 8 WHEN 0 THEN 'over ' || p_size * 10 || ' employees' WHEN 1 THEN 'about ' || p_size * 10 WHEN 2 THEN p_size * 10 || '-' || (p_size * 10 + 49) WHEN 3 THEN p_size * 10 || '+'
    WHEN 4 THEN '10,001+' WHEN 5 THEN 'a ' || p_size * 10 || '-person team' WHEN 6 THEN 'n/a' ELSE (p_size * 10)::VARCHAR END AS value_text FROM part
)"""


@query(sql(r"""SELECT row_id, value_text, CASE WHEN b IS NOT NULL THEN 'bucket' WHEN lo IS NOT NULL THEN 'range' WHEN one >= 0 THEN 'exact' END AS kind,
  CASE WHEN b IS NOT NULL THEN b WHEN lo IS NOT NULL THEN least(lo, hi) WHEN one >= 0 THEN one END AS value_min, CASE WHEN b IS NOT NULL THEN b WHEN lo IS NOT NULL THEN (lo + hi) / 2 WHEN one >= 0 THEN one END AS value_point,
  CASE WHEN b IS NOT NULL THEN b * 2 WHEN lo IS NOT NULL THEN greatest(lo, hi) WHEN one >= 0 THEN one END AS value_max
  FROM (SELECT row_id, value_text, try_cast(replace(nullif(regexp_extract(value_text, '^\s*(\d[\d,]*)\s*\+\s*$', 1), ''), ',', '') AS DOUBLE) AS b, try_cast(replace(nullif(regexp_extract(value_text, '^\s*(\d[\d,]*)\s*-\s*(\d[\d,]*)\s*\+?\s*$', 1), ''), ',', '') AS DOUBLE) AS lo,
    try_cast(replace(nullif(regexp_extract(value_text, '^\s*(\d[\d,]*)\s*-\s*(\d[\d,]*)\s*\+?\s*$', 2), ''), ',', '') AS DOUBLE) AS hi, try_cast(replace(value_text, ',', '') AS DOUBLE) AS one FROM texts)""", 0, _TEXT))
def value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.size_texts(spark, sf_dir).withColumn("v", T.size_value("value_text"))
    return rows.select("row_id", "value_text", "v.kind", "v.value_min", "v.value_point", "v.value_max")


@query(sql(r"""SELECT row_id, value_text, CASE WHEN value_text LIKE 'over %' THEN n WHEN value_text LIKE '%person%' THEN n * 0.9::DOUBLE END AS value_min, CASE WHEN value_text LIKE 'over %' THEN n * 1.1::DOUBLE ELSE n END AS value_point, CASE WHEN value_text LIKE 'over %' THEN n * 1.25::DOUBLE ELSE n * 1.1::DOUBLE END AS value_max,
  CASE WHEN value_text LIKE 'over %' THEN 'over' ELSE 'n-person' END AS qualifier FROM (SELECT *, regexp_extract(value_text, '\d+')::DOUBLE AS n FROM texts WHERE row_id % 8 IN (0, 5) AND length(regexp_extract(value_text, '\d+')) >= 2)""", 0, _TEXT))
def size_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.size_texts(spark, sf_dir).select("row_id", "value_text", F.explode(T.size_mentions("value_text")).alias("m"))
    return rows.select("row_id", "value_text", "m.value_min", "m.value_point", "m.value_max", "m.qualifier")


@query(sql(r"""SELECT row_id, date_text, CASE WHEN k = 6 THEN NULL WHEN k = 4 THEN date_trunc('quarter', o_orderdate)::DATE WHEN k = 5 THEN date_trunc('year', o_orderdate)::DATE ELSE date_trunc('month', o_orderdate)::DATE END AS month, k IN (4, 5) AS reduced
  FROM (SELECT o_orderkey AS row_id, o_orderkey % 7 AS k, o_orderdate, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%B %Y') WHEN 3 THEN strftime(o_orderdate, '%b %Y') WHEN 4 THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) WHEN 5 THEN year(o_orderdate)::VARCHAR ELSE '13/' || year(o_orderdate) END AS date_text FROM orders)""", 1, dates=("month",)))
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.date_texts(spark, sf_dir).withColumn("d", T.month_text("date_text", 2030)).select("row_id", "date_text", "d.month", F.coalesce("d.reduced", F.lit(False)).alias("reduced"))


@query(sql(r"""SELECT c_custkey AS row_id, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS name_key, lower(replace(c_name, '#', '-')) || '.example.com' AS domain FROM customer""", 1))
def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal forms and URL parts are added to customer names and must come off again."""
    forms = F.element_at(F.array(*map(F.lit, (" Inc.", ", LLC", " GmbH", " Holdings Ltd", ""))), (F.col("c_custkey") % 5).cast("int") + 1)
    host = F.concat(F.lit("HTTPS://www."), F.regexp_replace("c_name", "#", "-"), F.lit(".example.com/about?x=1"))
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), T.name_key(F.concat("c_name", forms)).alias("name_key"), T.domain_key(host).alias("domain"))


# Archive, resolution and maintenance over pages, customers and lineitem.


def _archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived pages: every fifth carries a JSON-LD statement, every third a size phrase."""
    n = (F.col("page_id") % 900 + 10).cast("string")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type": "Organization", "numberOfEmployees": {"minValue": '), n, F.lit(', "maxValue": '), (F.col("page_id") % 900 + 60).cast("string"), F.lit("}}</script>"))
    said = F.concat(F.lit("<p>We are over "), n, F.lit(" employees.</p>"))
    extra = F.when(F.col("page_id") % 5 == 0, ld).when(F.col("page_id") % 3 == 0, said).otherwise("")
    return A.table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", extra).alias("html"))


@query("""SELECT page_id, 'json_ld' AS method, (page_id % 900 + 10)::DOUBLE AS value_min, (page_id % 900 + 35)::DOUBLE AS value_point, (page_id % 900 + 60)::DOUBLE AS value_max, 'bucket' AS kind, 0.7::DOUBLE AS confidence FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, 'text', (page_id % 900 + 10)::DOUBLE, (page_id % 900 + 10) * 1.1::DOUBLE, (page_id % 900 + 10) * 1.25::DOUBLE, 'range', 0.55::DOUBLE FROM pages WHERE page_id % 5 <> 0 AND page_id % 3 = 0""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page_signals(_archive_pages(spark, sf_dir)).select("page_id", "method", "value_min", "value_point", "value_max", "kind", "confidence")


@query("""SELECT url, sha256(html) AS content_hash, min(CASE page_id % 4 WHEN 0 THEN 403 ELSE 200 END) AS status, count(*) * 2 AS seen_count, strftime(min(DATE '2001-01-01' + (page_id % 300)::INT), '%Y-%m-%d') AS first_seen, strftime(max(DATE '2001-02-01' + (page_id % 300)::INT), '%Y-%m-%d') AS last_seen FROM pages GROUP BY url, html""")
def archive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.table(spark, sf_dir, "pages")
    at = lambda day: F.date_add(F.lit(day).cast("date"), (F.col("page_id") % 300).cast("int"))
    status = F.when(F.col("page_id") % 4 == 0, 403).otherwise(200)
    first = TB.archive_merge(pages.select("url", F.col("html").alias("body"), status.alias("status"), at("2001-01-01").alias("fetched_at")))
    return TB.archive_merge(pages.select("url", F.col("html").alias("body"), F.lit(500).alias("status"), at("2001-02-01").alias("fetched_at")), first).drop("body")


@query("""WITH c AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), d AS (SELECT host, ('0x' || substr(md5(host), 1, 12))::BIGINT AS company_id FROM c WHERE host NOT LIKE 'blog.%' AND host NOT LIKE 'm.%')
SELECT page_id, company_id FROM pages p JOIN d ON regexp_replace(regexp_extract(p.url, '://([^/?#]*)', 1), '^(www)\\.', '') = d.host OR regexp_extract(p.url, '://([^/?#]*)', 1) LIKE '%.' || d.host
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(d.host) DESC, company_id) = 1""".replace("regexp_replace(regexp_extract(p.url, '://([^/?#]*)', 1), '^(www)\\\\.', '')", "regexp_extract(p.url, '://([^/?#]*)', 1)"))
def host_to_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = A.table(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain")).distinct().where(~F.col("domain").rlike("^(blog|m)[.]"))
    companies = hosts.withColumn("company_id", F.conv(F.substring(F.md5("domain"), 1, 12), 16, 10).cast("long"))
    return RS.host_to_company(pages, companies)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidate rows: names and domains repeat, so that rows chain over shared keys."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Firm "), (k % 400).cast("string"), F.when(k % 3 == 0, F.lit(" Inc.")).otherwise(F.lit("")))
    domain = F.when(k % 2 == 0, F.concat(F.lit("firm"), (k % 550).cast("string"), F.lit(".example.com")))
    slug = F.when(k % 5 == 0, F.concat(F.lit("firm-"), (k % 300).cast("string")))
    return A.table(spark, sf_dir, "customer").select(k.alias("row_no"), name.alias("name"), domain.alias("domain"), slug.alias("profile_url"))


@query()
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy and order-dependent, so without SQL; tests replay it in one sequence."""
    return RS.resolve(_candidates(spark, sf_dir)).drop("company_id")


@query()
def resolution_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that a resolution against existing companies adds; without SQL like `resolve_entities`."""
    rows = _candidates(spark, sf_dir)
    existing = rows.where("row_no % 7 = 0").withColumnRenamed("row_no", "company_id")
    aliases = existing.select("company_id", F.col("name").alias("alias"), F.lit("legal").alias("alias_type"))
    resolved = RS.resolve(rows.where("row_no % 7 > 0"), existing, aliases)
    links = existing.where("profile_url is not null").select("company_id")
    return RS.resolution_tables(rows, resolved, existing, aliases, links)["aliases"]


@query("""WITH o AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS nation FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.k IS NULL THEN o.nation ELSE n.nation END AS nation, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN o.nation <> n.nation THEN 'refreshed' ELSE 'unchanged' END AS action FROM o FULL JOIN n ON o.k = n.k""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    new = s.where("k % 5 <> 0").withColumn("nation", F.when(F.col("k") % 4 == 0, F.col("nation") + 100).otherwise(F.col("nation")))
    return TB.upsert(s.where("k % 3 <> 0"), new, ["k"])


@query(sql("SELECT reject_reason, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN NOT (value_min <= value_point AND value_point <= value_max) THEN 'interval' END, CASE WHEN NOT (kind <> 'exact' OR (value_min = value_point AND value_point = value_max)) THEN 'exact' END, CASE WHEN NOT value_point >= 0 THEN 'positive' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS reject_reason FROM (SELECT * REPLACE (value_point - 20 AS value_point, confidence + 0.2::DOUBLE AS confidence) FROM anchors0)) WHERE reject_reason <> '' GROUP BY ALL", 1))
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.anchors(spark, sf_dir).withColumn("value_point", F.col("value_point") - 20).withColumn("confidence", F.col("confidence") + 0.2)
    return TB.validated(rows, TB.ANCHOR_RULES)[1].groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(sql("SELECT s.company_id, s.month, round(s.value_point, 4) AS value_point, s.method, g.segment_no, g.segment_start, (SELECT count(*) FROM placed p WHERE p.company_id = s.company_id AND p.segment_no = g.segment_no) AS n_anchors, (SELECT count(*) FROM events v WHERE v.company_id = s.company_id AND v.event_month BETWEEN g.segment_start AND g.segment_end) AS n_events, (SELECT count(*) FROM growth w WHERE w.company_id = s.company_id AND w.month = s.month) AS n_growth FROM stored s JOIN segments g USING (company_id, segment_no)", 7, dates=("month", "segment_start")))
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = full(spark, sf_dir)
    series = TB.shuffled(TB.checkpointed(e.stored))
    wanted = series.select("company_id", "month")
    all_events = OV.with_events(A.events(spark, sf_dir), OV.decode(A.overrides(spark, sf_dir), now())["events"])
    tree = X.evidence(wanted, series, e.segments, e.placed, all_events, G.growth_series(series))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    rows = tree.select("company_id", "month", F.col("estimate.value_point").alias("value_point"), "estimate.method", F.col("segment.segment_no").cast("long").alias("segment_no"), "segment.segment_start", n("anchors").alias("n_anchors"), n("events").alias("n_events"), n("growth").alias("n_growth"))
    return rounded(rows, "value_point")


@query(sql("SELECT s.company_id, s.month, round(s.value_point, 4) AS value_point, s.method, g.segment_no, g.segment_start, (SELECT count(*) FROM placed p WHERE p.company_id = s.company_id AND p.segment_no = g.segment_no) AS n_anchors, (SELECT count(*) FROM events v WHERE v.company_id = s.company_id AND v.event_month BETWEEN g.segment_start AND g.segment_end) AS n_events, (SELECT count(*) FROM growth w WHERE w.company_id = s.company_id AND w.month = s.month) AS n_growth FROM stored s JOIN segments g USING (company_id, segment_no)", 7, dates=("month", "segment_start")))
def evidence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`evidence` for every stored company-month."""
    e = full(spark, sf_dir)
    series = TB.shuffled(TB.checkpointed(e.stored))
    wanted = series.select("company_id", "month")
    all_events = OV.with_events(A.events(spark, sf_dir), OV.decode(A.overrides(spark, sf_dir), now())["events"])
    tree = X.evidence(wanted, series, e.segments, e.placed, all_events, G.growth_series(series))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    rows = tree.select("company_id", "month", F.col("estimate.value_point").alias("value_point"), "estimate.method", F.col("segment.segment_no").cast("long").alias("segment_no"), "segment.segment_start", n("anchors").alias("n_anchors"), n("events").alias("n_events"), n("growth").alias("n_growth"))
    return rounded(rows, "value_point")


@query(sql("SELECT company_id, name, max(CASE WHEN horizon = '1y' THEN round(growth_point, 4) END) AS growth_1y, max(CASE WHEN horizon = '6m' THEN round(growth_point, 4) END) AS growth_6m FROM company LEFT JOIN latest USING (company_id) GROUP BY ALL", 7))
def company_growth_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = rounded(G.latest_growth(stored(spark, sf_dir)), "growth_point").groupBy("company_id").pivot("horizon", ["1y", "6m"]).agg(F.max("growth_point"))
    return A.companies(spark, sf_dir).select("company_id", "name").join(grown, "company_id", "left").select("company_id", "name", F.col("1y").alias("growth_1y"), F.col("6m").alias("growth_6m"))


@query(sql("SELECT company_id, source_name, count(*) AS n_anchors, count(DISTINCT anchor_month) AS n_months, round(max(confidence), 4) AS best_confidence FROM anchors0 GROUP BY ALL", 1))
def anchor_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = RD.anchor_yield(A.anchors(spark, sf_dir)).select("company_id", "source_name", "n_anchors", "n_months", "best_confidence")
    return rounded(rows, "best_confidence")


@query(sql("SELECT company_id, priority, severity, reason FROM (SELECT company_id, reason, round(severity, 4) AS severity, least(99, greatest(0, CASE reason WHEN 'low_confidence' THEN 50 WHEN 'anomaly' THEN 55 ELSE 30 END + round_even(least(1, greatest(0, severity)) * 15, 0) + CASE WHEN confidence IS NULL THEN 0 ELSE round_even(least(1, greatest(0, 1 - confidence)) * 15, 0) END))::INT AS priority FROM items) ORDER BY priority DESC, company_id, reason LIMIT 20", 6, _QUEUE))
def queue_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = full(spark, sf_dir)
    items = R.candidates(TB.checkpointed(e.scored), e.segments).withColumn("updated_at", now()).withColumn("version_id", F.lit(None).cast("string"))
    return rounded(R.queue_page(items, 20).select("company_id", "priority", "severity", "reason"), "severity")


@query(sql("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN provider = 'tertiary' THEN 'skipped_provider' WHEN value_min > value_point OR value_max < value_point THEN 'skipped_no_value' WHEN company_id % 10 = 0 THEN 'already_promoted' ELSE 'promoted' END AS outcome FROM (SELECT * REPLACE (CASE WHEN row_index % 7 = 0 THEN value_min + 100 ELSE value_min END AS value_min) FROM benchmark_rows) WHERE metric LIKE 'headcount%') GROUP BY ALL", 1))
def benchmark_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.benchmark(spark, sf_dir).withColumn("value_min", F.when(F.col("row_index") % 7 == 0, F.col("value_min") + 100).otherwise(F.col("value_min")))
    first = PR.promote_benchmarks(rows.where("company_id % 10 = 0"), A.anchors(spark, sf_dir).limit(0), ("tertiary",))["anchors"]
    return PR.promote_benchmarks(rows, first, ("tertiary",))["counts"]


@query(sql("SELECT company_id, anchor_month, months, round(value_point / (1 + pct / 100), 4) AS value_point FROM (SELECT company_id, (anchor_month - to_months(months))::DATE AS anchor_month, months, value_point, pct FROM (SELECT company_id, arg_max(anchor_month, (anchor_month, anchor_id)) AS anchor_month, arg_max(value_point, (anchor_month, anchor_id)) AS value_point FROM anchors0 WHERE anchor_type = 'current_headcount_anchor' GROUP BY ALL), (VALUES (6), (12)) AS h(months), LATERAL (SELECT CASE months WHEN 6 THEN (company_id % 50)::DOUBLE ELSE -((company_id % 30)::DOUBLE) END AS pct))", 1, dates=("anchor_month",)))
def trend_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("6 month growth "), (F.col("company_id") % 50).cast("string"), F.lit("% 1 year growth -"), (F.col("company_id") % 30).cast("string"), F.lit("%"))
    trends = A.companies(spark, sf_dir).select("company_id", T.growth_trends(text).alias("trends"))
    now_anchor = PR.latest_current_anchor(A.anchors(spark, sf_dir)).join(trends, "company_id")
    return rounded(T.back_computed(now_anchor).select("company_id", "anchor_month", F.col("months").cast("int").alias("months"), "value_point"), "value_point")
