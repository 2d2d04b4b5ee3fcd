"""Read side: pages of tables, series with a range, flattened reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators.evaluation import latest_version
from rosterlake.operators.growth import latest_growth
from rosterlake.sources.tables import export


def company_page(companies: DataFrame, tier: str | None, limit: int, offset: int = 0) -> DataFrame:
    """A page of companies by name; the limit is the feature."""
    rows = companies if tier is None else companies.where(F.col("tier") == tier)
    return rows.orderBy("name", "company_id").offset(offset).limit(limit)


def series_range(stored: DataFrame, ids: DataFrame | None, start: str | None, end: str | None) -> DataFrame:
    """Months of the wanted companies (company_id) between two months, both optional and inclusive."""
    rows = stored if ids is None else stored.join(ids.select("company_id").distinct(), "company_id", "left_semi")
    if start:
        rows = rows.where(F.col("month") >= F.lit(start).cast("date"))
    return rows.where(F.col("month") <= F.lit(end).cast("date")) if end else rows


def latest_series(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of each company's newest version."""
    return rows.join(latest_version(versions).select("company_id", "version_id"), ["company_id", "version_id"], "left_semi")


def newest(rows: DataFrame, at: str, limit: int) -> DataFrame:
    """The newest rows of a log (runs, audit, evaluations, overrides); the limit is the feature."""
    return rows.orderBy(F.desc(at), *(c for c in rows.columns if c != at)).limit(limit)


def runs(rows: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """The newest runs, of one kind if asked: run_id, kind, status, started_at, ...; the limit is the feature."""
    return newest(rows if kind is None else rows.where(F.col("kind") == kind), "started_at", limit)


def run_detail(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """Each run with its companies' stages: counts by (stage, status), and the failed companies with their errors, both as arrays."""
    counts = stage_counts(statuses).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("stage", "status", "companies"))).alias("stages"))
    failed = statuses.where("status = 'failed'").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("company_id", "stage", "error"))).alias("failures"))
    return rows.join(counts, "run_id", "left").join(failed, "run_id", "left")


def audit_log(rows: DataFrame, target_type: str | None = None, target_id: str | None = None, limit: int = 100) -> DataFrame:
    """The newest audit rows, of one type and one target if asked; the limit is the feature."""
    if target_type is not None:
        rows = rows.where(F.col("target_type") == target_type)
    return newest(rows if target_id is None else rows.where(F.col("target_id") == target_id), "created_at", limit)


def evaluation_history(evaluations: DataFrame, limit: int = 50) -> DataFrame:
    """The newest evaluations without their scoreboards; the limit is the feature."""
    return newest(evaluations.drop("scoreboard"), "evaluated_at", limit)


def evaluation_detail(evaluations: DataFrame, evaluation_id: str | None = None) -> DataFrame:
    """One evaluation with its scoreboard, by id or the newest; no row for an unknown id."""
    return newest(evaluations if evaluation_id is None else evaluations.where(F.col("evaluation_id") == evaluation_id), "evaluated_at", 1)


def flat_series(records: DataFrame) -> DataFrame:
    """Series held as arrays of months (company_id, months) -> a row a month."""
    return records.select("company_id", F.inline("months"))


def flat_comparison(compared: DataFrame) -> DataFrame:
    """Companies' comparisons (company_id, name, matches) -> a row a match; the id stands in for a missing name."""
    return compared.select("company_id", F.coalesce("name", F.col("company_id").cast("string")).alias("canonical_name"), F.inline("matches"))


def stage_counts(statuses: DataFrame) -> DataFrame:
    """run_id, stage, status, companies."""
    return statuses.groupBy("run_id", "stage", "status").agg(F.count_distinct("company_id").alias("companies"))


def flat_overrides(overrides: DataFrame, now: Column) -> DataFrame:
    """Overrides with their payload's values side by side and whether they are active."""
    p = F.from_json("payload", "anchor_month date, value_point double, start_month date, end_month date, event_month date, event_type string")
    live = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return overrides.withColumn("p", p).select("override_id", "company_id", "field_name", "reason", live.alias("active"), "p.*")


def anchor_yield(anchors: DataFrame, examples: int = 10) -> DataFrame:
    """Anchors of each company and source: n_anchors, n_months, best_confidence, and the newest `examples` of them as (month, value)."""
    newest = Window.partitionBy("company_id", "source_name").orderBy(F.desc("anchor_month"), "anchor_id")
    shown = anchors.withColumn("_n", F.row_number().over(newest))
    example = F.when(F.col("_n") <= examples, F.struct(F.col("_n").alias("n"), "anchor_month", "value_point"))
    return shown.groupBy("company_id", "source_name").agg(
        F.count("*").alias("n_anchors"), F.count_distinct("anchor_month").alias("n_months"), F.max("confidence").alias("best_confidence"), F.array_sort(F.collect_list(example)).alias("examples")
    )


def anchor_matrix(anchors: DataFrame, sources: list[str]) -> DataFrame:
    """Companies by sources: how many anchors each source gives."""
    return anchors.groupBy("company_id").pivot("source_name", sources).agg(F.count(F.lit(1))).na.fill(0)


#: Headings of the growth report's file.
GROWTH_HEADINGS = {"name": "Company Name", "headcount": "Headcount", "growth_1y": "Headcount % (365d)", "growth_6m": "Headcount % (180d)"}


def growth_report(companies: DataFrame, series: DataFrame) -> DataFrame:
    """One row a company that has a series: company_id, name, headcount of its newest month, growth_1y and growth_6m up to it."""
    now = series.groupBy("company_id").agg(F.max_by("value_point", "month").alias("headcount"))
    grown = latest_growth(series).groupBy("company_id").pivot("horizon", ["1y", "6m"]).agg(F.max("growth_point"))
    rows = companies.select("company_id", "name").join(now, "company_id").join(grown, "company_id", "left")
    return rows.select("company_id", "name", "headcount", F.col("1y").alias("growth_1y"), F.col("6m").alias("growth_6m"))


def write_growth_csv(report: DataFrame, path: str) -> None:
    """The report as CSV files under `path` in the order of names, headed GROWTH_HEADINGS; blank where a growth is missing."""
    headed = report.orderBy("name", "company_id").select(*(F.col(c).alias(h) for c, h in GROWTH_HEADINGS.items()))
    export(headed, path, "csv")
