"""Growth over fixed horizons, with interval propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.config import BANDS, HORIZON_LABEL
from rosterlake.functions.expressions import lookup, usable_endpoint

PRODUCT_HORIZONS = (6, 12, 24)


def _label(h: int) -> str:
    return HORIZON_LABEL.get(h, f"{h}m")


def growth_series(series: DataFrame, horizons: tuple[int, ...] = PRODUCT_HORIZONS) -> DataFrame:
    """company_id, month, prev_month, horizon, growth_min, growth_point, growth_max, delta for every usable pair of months.

    One equi-join on (company, month shifted by the horizon); the horizons are
    exploded on the start side, so the end side is shuffled once.
    """
    usable = series.where(usable_endpoint("method", "value_point")).select("company_id", "month", "value_min", "value_point", "value_max")
    shift = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(_label(h)).alias("horizon")) for h in horizons)))
    start = usable.withColumn("x", shift).select("company_id", F.col("month").alias("prev_month"), F.add_months("month", F.col("x.h")).alias("month"), F.col("x.horizon").alias("horizon"), *(F.col(f"value_{k}").alias(f"p_{k}") for k in ("min", "point", "max")))
    tiny = F.lit(1e-9)
    return usable.join(start, ["company_id", "month"]).select(
        "company_id", "month", "prev_month", "horizon",
        (F.col("value_min") / F.greatest("p_max", tiny) - 1).alias("growth_min"),
        (F.col("value_point") / F.col("p_point") - 1).alias("growth_point"),
        (F.col("value_max") / F.greatest("p_min", tiny) - 1).alias("growth_max"),
        (F.col("value_point") - F.col("p_point")).alias("delta"),
    )


def latest_growth(series: DataFrame, horizons: tuple[int, ...] = PRODUCT_HORIZONS) -> DataFrame:
    """The rows of growth_series that end at a company's latest month; undefined ones are left out."""
    last = series.groupBy("company_id").agg(F.max("month").alias("month"))
    return growth_series(series, horizons).join(last, ["company_id", "month"], "left_semi")


def weakest_band(a: Column | str, b: Column | str) -> Column:
    rank = {band: i for i, band in enumerate(BANDS)}
    worse = F.greatest(lookup(rank, a, len(BANDS)), lookup(rank, b, len(BANDS)))
    return F.element_at(F.array(*map(F.lit, BANDS)), worse + 1)


def growth_windows(series: DataFrame, horizons: tuple[int, ...] = PRODUCT_HORIZONS) -> DataFrame:
    """One row a company and horizon ending at its latest month; where it is undefined, the row says why.

    company_id, horizon, start_month, end_month, start_value, end_value,
    growth_min, growth_point, growth_max, band (the weaker end), suppressed_reason.
    """
    # one pass: every row is a possible end, and looks its starts up by shifted month
    w = W.partitionBy("company_id")
    last = series.withColumn("_last", F.max("month").over(w))
    shift = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(_label(h)).alias("horizon")) for h in horizons)))
    ends = last.where("month = _last").withColumn("x", shift).select("company_id", F.col("x.horizon").alias("horizon"), F.col("month").alias("end_month"), F.add_months("month", -F.col("x.h")).alias("start_month"), *(F.col(c).alias(f"e_{c}") for c in ("value_min", "value_point", "value_max", "method", "band")))
    starts = series.select("company_id", F.col("month").alias("start_month"), *(F.col(c).alias(f"s_{c}") for c in ("value_min", "value_point", "value_max", "method", "band")))
    rows = ends.join(starts, ["company_id", "start_month"], "left")
    reason = F.when(F.col("s_method").isNull(), "no_start_month").when(~usable_endpoint("e_method", "e_value_point"), "end_not_usable").when(~usable_endpoint("s_method", "s_value_point"), "start_not_usable")
    rows = rows.withColumn("suppressed_reason", reason)
    fine = F.col("suppressed_reason").isNull()
    ratio = lambda a, b: F.when(fine, F.col(a) / F.greatest(F.col(b), F.lit(1e-9)) - 1)
    return rows.select(
        "company_id", "horizon", "start_month", "end_month",
        F.when(fine, F.col("s_value_point")).alias("start_value"), F.when(fine, F.col("e_value_point")).alias("end_value"),
        ratio("e_value_min", "s_value_max").alias("growth_min"), ratio("e_value_point", "s_value_point").alias("growth_point"), ratio("e_value_max", "s_value_min").alias("growth_max"),
        F.when(fine, weakest_band("e_band", "s_band")).otherwise("manual_review_required").alias("band"), "suppressed_reason",
    )
