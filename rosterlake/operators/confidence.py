"""Anomaly flags and confidence scores of a monthly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.config import ANCHOR_QUALITY, DEGRADED, INTERPOLATED, SCORE_WEIGHTS, SUPPRESSED, EstimateConfig, Window
from rosterlake.functions.expressions import age_months, coverage_at, half_life, lookup, ordinal, score_band
from rosterlake.operators.series import SEGMENT, date_lit


def break_months(segs: DataFrame) -> DataFrame:
    """company_id, breaks: starts of all segments but the first, as month ordinals."""
    return segs.groupBy("company_id").agg(F.array_sort(F.collect_list(F.when(F.col("segment_no") > 1, ordinal("segment_start")))).alias("breaks"))


def anomalies(series: DataFrame, breaks: DataFrame, config: EstimateConfig = EstimateConfig()) -> DataFrame:
    """Add interval_too_wide, sample_floor_violation, mom_jump, non_monotonic_interval, coverage_floor_hit and reasons.

    Jumps compare with the month before in the same segment, except at a break.
    """
    w = W.partitionBy(*SEGMENT).orderBy("month")
    out = series.join(breaks, "company_id", "left").withColumn("_prev", F.lag("value_point").over(w))
    width = F.greatest(F.lit(0.0), F.col("value_max") - F.col("value_min")) / F.col("value_point")
    change = F.abs(F.col("value_point") - F.col("_prev")) / F.col("_prev")
    at_break = F.coalesce(F.array_contains("breaks", ordinal("month")), F.lit(False))
    no = F.lit(False)
    flags = {
        "interval_too_wide": F.when(F.col("value_point") > 0, width > config.max_width).otherwise(no),
        "sample_floor_violation": F.coalesce(F.startswith("suppression_reason", F.lit("profiles_below_floor")), no),
        "mom_jump": F.when(F.col("_prev").isNotNull() & ~at_break & (F.col("_prev") > 0), change > config.max_jump).otherwise(no),
        "non_monotonic_interval": ~((F.col("value_min") <= F.col("value_point")) & (F.col("value_point") <= F.col("value_max"))),
        "coverage_floor_hit": F.col("coverage_factor") >= 1.0 / config.coverage.floor - 1e-9 if config.coverage.floor > 0 else no,
    }
    texts = {
        "interval_too_wide": F.format_string(f"width=%.2f>{config.max_width:.2f}", width),
        "sample_floor_violation": F.col("suppression_reason"),
        "mom_jump": F.format_string(f"mom_jump=%.2f>{config.max_jump:.2f}", change),
    }
    for name, c in flags.items():
        out = out.withColumn(name, c)
    reasons = F.array_compact(F.array(*(F.when(F.col(n), texts.get(n, F.lit(n))) for n in flags)))
    return out.withColumn("reasons", reasons).withColumn("flagged", F.size("reasons") > 0).drop("_prev", "breaks")


def segment_evidence(placed: DataFrame) -> DataFrame:
    """What the score needs of a segment's anchors: best quality, distinct months (bounded by the window), source classes."""
    quality = lookup(ANCHOR_QUALITY, "anchor_type", 0.25)
    return placed.groupBy(*SEGMENT).agg(
        F.max(quality).alias("quality"),
        F.collect_set(ordinal("anchor_month")).alias("months"),
        F.count_distinct(F.when(F.col("source_name") != "", F.col("source_name"))).alias("sources"),
    )


def nearest(months: Column | str, month: Column | str) -> Column:
    return F.array_min(F.transform(months, lambda m: F.abs(m - ordinal(month))))


def confidence(series: DataFrame, placed: DataFrame, breaks: DataFrame, window: Window, config: EstimateConfig = EstimateConfig(), weights: dict[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Add components (map), score, score_band and note: six weighted components, then limits by method."""
    rows = series.join(segment_evidence(placed), SEGMENT, "left").join(breaks, "company_id", "left")
    expected = F.greatest(F.lit(1.0), F.lit(float(config.sample_floor)) / coverage_at(age_months("month", date_lit(window.as_of)), config.coverage))
    spread = F.greatest(F.lit(0.0), F.col("value_max") - F.col("value_min")) / F.greatest(F.lit(1.0), F.col("value_point"))
    near_break = nearest("breaks", "month")
    parts = {
        "anchor_source_quality": F.coalesce("quality", F.lit(0.0)),
        "anchor_recency": F.when(F.col("months").isNull(), 0.0).otherwise(half_life(nearest("months", "month"), config.recency_half_life)),
        "anchor_agreement": F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(1.0), spread)),
        "sample_coverage": F.when(F.col("profiles") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("profiles") / expected)),
        "event_proximity": F.when(F.coalesce(F.size("breaks"), F.lit(0)) <= 0, 1.0).otherwise(F.lit(1.0) - F.exp(-near_break / F.lit(config.event_half_life))),
        "multi_source_corroboration": F.when(F.col("sources") >= 2, 1.0).when(F.col("sources") == 1, 0.4).otherwise(0.0),
    }
    for name, c in parts.items():
        rows = rows.withColumn(name, c.cast("double"))
    total = sum((F.col(n) * F.lit(float(weights.get(n, 0.0))) for n in parts), F.lit(0.0))
    rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    band = score_band("score", config.bands)
    limited = (
        F.when(F.col("method") == SUPPRESSED, "manual_review_required")
        .when((F.col("method") == DEGRADED) & band.isin("high", "medium"), "low")
        .when((F.col("method") == INTERPOLATED) & F.col("needs_review") & band.isin("high", "medium"), "low")
        .when((F.col("method") == INTERPOLATED) & (band == "high"), "medium")
        .otherwise(band)
    )
    note = F.when(F.col("method").isin(SUPPRESSED, DEGRADED, INTERPOLATED), F.col("method"))
    components = F.create_map(*(x for n in parts for x in (F.lit(n), F.col(n))))
    return rows.withColumn("score_band", limited).withColumn("note", note).withColumn("components", components).drop("quality", "months", "sources", "breaks", *parts)


def component_averages(scored: DataFrame) -> DataFrame:
    """company_id, component, average, n_months."""
    return scored.select("company_id", F.explode("components").alias("component", "value")).groupBy("company_id", "component").agg(F.avg("value").alias("average"), F.count("*").alias("n_months"))


def persisted(scored: DataFrame) -> DataFrame:
    """The stored form: flags merged into needs_review, reasons into an empty suppression_reason, the score's band."""
    reason = F.when(F.col("suppression_reason").isNull() & F.col("flagged"), F.substring(F.array_join("reasons", "; "), 1, 256)).otherwise(F.col("suppression_reason"))
    review = F.col("needs_review") | F.col("flagged") | (F.col("score_band") == "manual_review_required")
    return scored.withColumn("suppression_reason", reason).withColumn("needs_review", review).withColumn("band", F.col("score_band")).drop("score_band")
