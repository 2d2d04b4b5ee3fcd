"""From intervals, anchors and events to a monthly series with bounds (all companies in one plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.config import ANCHOR_PRECEDENCE, BREAK_EVENTS, DEGRADED, INTERPOLATED, SCALED, SUPPRESSED, EstimateConfig, Window
from rosterlake.functions.expressions import age_months, clamp, coverage_at, distance_band, from_ordinal, half_life, lookup, month_diff, month_floor, ordinal, segment_centre, width_band

SEGMENT = ["company_id", "segment_no"]


def date_lit(iso: str) -> Column:
    return F.lit(iso).cast("date")


def calendar(frame: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every month from start to end for each row."""
    return frame.withColumn("month", F.explode(F.sequence(start, end, F.expr("interval 1 month"))))


def live_months(employment: DataFrame, window: Window) -> DataFrame:
    """Intervals as month ordinals (s, e), cut to the window and to as_of; those outside are dropped.

    An open interval runs to as_of if the role is current, else it lives one month.
    """
    last = F.least(date_lit(window.end), date_lit(window.as_of))
    start = month_floor("start_month")
    end = F.coalesce(month_floor("end_month"), F.when(F.col("is_current"), date_lit(window.as_of)).otherwise(start))
    cut = employment.select("company_id", "person_id", ordinal(F.greatest(start, date_lit(window.start))).alias("s"), ordinal(F.least(end, last)).alias("e"))
    return cut.where(F.col("s") <= F.col("e"))


def profile_counts(employment: DataFrame, companies: DataFrame, window: Window) -> DataFrame:
    """Live persons a company and month: company_id, month, profiles (0 where nobody is).

    A person counts once however many intervals overlap: intervals are merged
    into islands per (company, person), which also spreads a huge employer, and
    islands become +1 / -1 changes, so the cost follows intervals, not months.
    """
    person = W.partitionBy("company_id", "person_id").orderBy("s", "e")
    reach = F.max("e").over(person.rowsBetween(W.unboundedPreceding, -1))
    islands = live_months(employment, window).withColumn("fresh", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(person))
    merged = islands.groupBy("company_id", "person_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    changes = merged.select("company_id", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    deltas = changes.groupBy("company_id", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    spine = calendar(companies.select("company_id").distinct(), date_lit(window.start), date_lit(window.end))
    running = F.sum(F.coalesce("d", F.lit(0))).over(W.partitionBy("company_id").orderBy("month"))
    joined = spine.withColumn("at", ordinal("month")).join(deltas, ["company_id", "at"], "left")
    counted = joined.select("company_id", "month", running.cast("long").alias("n"))
    return counted.select("company_id", "month", F.when(F.col("month") > date_lit(window.as_of), 0).otherwise(F.col("n")).cast("long").alias("profiles"))


def segments(events: DataFrame, companies: DataFrame, window: Window) -> DataFrame:
    """Split the window of each company at its break months.

    company_id, segment_no (from 1), segment_start, segment_end, opening_types
    (distinct event types of the month that opens it, by load order or name).
    A break on the first month opens the first segment.
    """
    order = F.col("load_order") if "load_order" in events.columns else F.lit(0)
    month = month_floor("event_month")
    broken = events.where(F.col("event_type").isin(*BREAK_EVENTS)).select("company_id", "event_type", month.alias("segment_start"), order.alias("o"))
    broken = broken.where(F.col("segment_start").between(date_lit(window.start), date_lit(window.end)))
    typed = broken.groupBy("company_id", "segment_start", "event_type").agg(F.min("o").alias("o")).groupBy("company_id", "segment_start").agg(F.array_sort(F.collect_list(F.struct("o", "event_type"))).getField("event_type").alias("opening_types"))
    first = companies.select("company_id").distinct().withColumn("segment_start", date_lit(window.start))
    starts = first.join(typed, ["company_id", "segment_start"], "full").select("company_id", "segment_start", F.coalesce("opening_types", F.array().cast("array<string>")).alias("opening_types"))
    w = W.partitionBy("company_id").orderBy("segment_start")
    end = F.coalesce(F.add_months(F.lead("segment_start").over(w), -1), date_lit(window.end))
    return starts.select("company_id", F.row_number().over(w).alias("segment_no"), "segment_start", end.alias("segment_end"), "opening_types")


#: Months of a block by which ranges and months meet.
BLOCK_MONTHS = 12


def in_ranges(rows: DataFrame, month: str, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with every range of their company that holds their month; ranges: company_id, start, end and more columns.

    Both sides meet by company and block of months, so a company with very many
    rows or ranges is spread over its blocks; a range has a copy for each block
    that it touches, and the exact months decide.
    """
    block = lambda m: F.floor(ordinal(m) / BLOCK_MONTHS).cast("int")
    blocks = F.when(F.col(start) <= F.col(end), F.sequence(block(start), block(end)))
    spread = ranges.withColumn("_block", F.explode(blocks))
    return rows.withColumn("_block", block(month)).join(spread, ["company_id", "_block"]).where(F.col(month).between(F.col(start), F.col(end))).drop("_block")


def segment_of(segs: DataFrame, months: DataFrame) -> DataFrame:
    """Bounds of the segment that holds each (company_id, month)."""
    bounds = segs.select("company_id", "segment_no", "segment_start", "segment_end")
    return in_ranges(months, "month", bounds, "segment_start", "segment_end").select("company_id", "month", "segment_no", "segment_start", "segment_end")


def anchors_in_segments(anchors: DataFrame, segs: DataFrame) -> DataFrame:
    """Anchors with the segment that holds their month."""
    floored = anchors.withColumn("anchor_month", month_floor("anchor_month"))
    bounds = segs.select("company_id", "segment_no", "segment_start", "segment_end")
    return in_ranges(floored, "anchor_month", bounds, "segment_start", "segment_end").select(*floored.columns, "segment_no", "segment_start", "segment_end")


def _folded(value: Column) -> Column:
    """Sum in a fixed order, so that thresholds and roundings downstream do not depend on partitioning."""
    return F.aggregate(value, F.lit(0.0), lambda acc, x: acc + x)


def reconcile_anchors(placed: DataFrame, decay_half_life: float | None = None) -> DataFrame:
    """One anchor a segment out of all in it.

    Only the top precedence tier counts; buckets are left out of the point if
    the tier has anything more precise; the point and the month are means
    weighted by confidence and closeness to the segment's centre, the interval
    is the tier's envelope.  If all weights are zero, the latest anchor (then
    the most confident) stands alone.
    """
    by_segment = W.partitionBy(*SEGMENT)
    tiers = placed.withColumn("tier", lookup(ANCHOR_PRECEDENCE, "anchor_type", 0))
    top = tiers.withColumn("best", F.max("tier").over(by_segment)).where("tier = best")
    top = top.withColumn("precise", F.max((F.col("kind") != "bucket").cast("int")).over(by_segment) == 1)
    centre = segment_centre("segment_start", "segment_end")
    closeness = half_life(F.abs(month_diff("anchor_month", centre)), decay_half_life)
    pooled = ~F.col("precise") | (F.col("kind") != "bucket")
    weight = F.when(pooled, F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)) * closeness))
    row = F.struct("anchor_month", "anchor_id", F.col("value_point").alias("p"), weight.alias("w"), ordinal("anchor_month").alias("m"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
    grouped = top.groupBy(*SEGMENT, "segment_start", "segment_end", "precise").agg(
        F.min("value_min").alias("tier_min"),
        F.max("value_max").alias("tier_max"),
        F.count("*").alias("n_top"),
        F.count(F.when(pooled, 1)).alias("n_point"),
        F.array_sort(F.collect_list(F.when(pooled, row))).alias("pool"),
        F.array_sort(F.collect_set("anchor_type")).alias("tier_types"),
    )
    used = grouped.withColumn("used", F.filter("pool", lambda x: x.w > 0)).withColumn("total", _folded(F.transform("used", lambda x: x.w)))
    late = F.array_max(F.transform("pool", lambda x: F.struct(x.anchor_month, x.c, x.anchor_id, x.p)))
    used = used.withColumn("late", late)
    some = F.col("total") > 0
    mean = lambda f: _folded(F.transform("used", f)) / F.col("total")
    point = F.when(some, mean(lambda x: x.p * x.w)).otherwise(F.col("late.p"))
    month = F.when(some, clamp(from_ordinal(F.bround(mean(lambda x: x.m * x.w)).cast("int")), F.col("segment_start"), F.col("segment_end"))).otherwise(F.col("late.anchor_month"))
    ids = F.when(some, F.transform("used", lambda x: x.anchor_id)).otherwise(F.array("late.anchor_id"))
    shares = F.when(some, F.transform("used", lambda x: x.w / F.col("total"))).otherwise(F.array(F.lit(1.0)))
    out = used.withColumn("value_point", point)
    return out.select(
        *SEGMENT, month.alias("anchor_month"), F.least("tier_min", "value_point").alias("value_min"), "value_point", F.greatest("tier_max", "value_point").alias("value_max"),
        "n_top", "n_point", F.col("precise").alias("has_precise"), "tier_types", ids.alias("contributing_ids"), shares.alias("weights"),
    )


def best_anchor_a_month(placed: DataFrame) -> DataFrame:
    """The most confident anchor of each segment and month; ties by precedence, then load order."""
    order = [F.coalesce("confidence", F.lit(0.0)).desc(), lookup(ANCHOR_PRECEDENCE, "anchor_type", 0).desc(), F.col("load_order") if "load_order" in placed.columns else F.col("anchor_id")]
    w = W.partitionBy(*SEGMENT, "anchor_month").orderBy(*order)
    return placed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def interpolate(months: DataFrame, best: DataFrame) -> DataFrame:
    """Add left / right: the anchors on either side of each month of a segment, and what lies between.

    Adds i_min, i_point, i_max (linear between flanks, flat beyond them),
    i_distance to the nearest, i_anchor_month, i_ids and beyond (outside the
    anchors' range).  As-of lookup by window frames over the dense months.
    """
    mark = best.select(*SEGMENT, F.col("anchor_month").alias("month"), F.struct("anchor_month", "value_min", "value_point", "value_max", "anchor_id").alias("mark"))
    w = W.partitionBy(*SEGMENT).orderBy("month")
    joined = months.join(mark, [*SEGMENT, "month"], "left")
    back = F.last("mark", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first("mark", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    flanked = joined.withColumn("back", back).withColumn("ahead", ahead).drop("mark")
    # at or before the first anchor and at or after the last one, a single anchor counts
    whole = W.partitionBy(*SEGMENT)
    flanked = flanked.withColumn("first_month", F.min(F.col("back.anchor_month")).over(whole)).withColumn("last_month", F.max(F.col("back.anchor_month")).over(whole))
    single = (F.col("month") <= F.col("first_month")) | (F.col("month") >= F.col("last_month")) | F.col("ahead").isNull()
    flanked = flanked.withColumn("single", single).withColumn("lone", F.coalesce("back", "ahead"))
    to_back, to_ahead = month_diff("month", "back.anchor_month"), month_diff("ahead.anchor_month", "month")
    t = to_back / month_diff("ahead.anchor_month", "back.anchor_month")
    between = lambda c: F.col(f"back.{c}") + (F.col(f"ahead.{c}") - F.col(f"back.{c}")) * t
    at = lambda c: F.when(F.col("single"), F.col(f"lone.{c}")).otherwise(between(c))
    mixed = flanked.withColumn("i_point", at("value_point")).withColumn("_lo", at("value_min")).withColumn("_hi", at("value_max"))
    near = F.when(F.col("single"), F.abs(month_diff("month", "lone.anchor_month"))).otherwise(F.least(to_back, to_ahead))
    nearest = F.when(F.col("single") | (to_back <= to_ahead), F.col("lone.anchor_month")).otherwise(F.col("ahead.anchor_month"))
    ids = F.when(F.col("single"), F.array("lone.anchor_id")).otherwise(F.array("back.anchor_id", "ahead.anchor_id"))
    out = mixed.withColumn("i_min", F.when(F.col("single"), F.col("_lo")).otherwise(F.least("_lo", "i_point"))).withColumn("i_max", F.when(F.col("single"), F.col("_hi")).otherwise(F.greatest("_hi", "i_point")))
    out = out.withColumn("i_distance", near).withColumn("i_anchor_month", nearest).withColumn("i_ids", ids).withColumn("beyond", (F.col("month") < F.col("first_month")) | (F.col("month") > F.col("last_month")))
    return out.drop("back", "ahead", "lone", "single", "_lo", "_hi", "first_month", "last_month")


def monthly_series(segs: DataFrame, counts: DataFrame, placed: DataFrame, reconciled: DataFrame, window: Window, config: EstimateConfig = EstimateConfig()) -> DataFrame:
    """One estimate a company and month.

    Where a month of the segment reaches the sample floor, or there are not two
    anchor months, the reconciled anchor is scaled by the ratio of
    coverage-corrected counts (suppressed below the floor, flat where the
    anchor month has no profiles, zero without an anchor); else the segment's
    anchors are interpolated.
    """
    curve, floor = config.coverage, config.sample_floor
    as_of = date_lit(window.as_of)
    dense = calendar(segs.select(*SEGMENT, "segment_start", "segment_end"), F.col("segment_start"), F.col("segment_end")).select(*SEGMENT, "month")
    months = dense.join(counts, ["company_id", "month"], "left").withColumn("profiles", F.coalesce("profiles", F.lit(0)))
    at_anchor = reconciled.join(counts.select("company_id", F.col("month").alias("anchor_month"), F.col("profiles").alias("anchor_profiles")), ["company_id", "anchor_month"], "left")
    at_anchor = at_anchor.select(*SEGMENT, F.col("anchor_month").alias("r_month"), F.col("value_min").alias("r_min"), F.col("value_point").alias("r_point"), F.col("value_max").alias("r_max"), F.coalesce("anchor_profiles", F.lit(0)).alias("anchor_profiles"), F.col("contributing_ids").alias("r_ids"))
    spread = placed.groupBy(*SEGMENT).agg(F.count_distinct("anchor_month").alias("anchor_months"))
    full = interpolate(months, best_anchor_a_month(placed)).join(at_anchor, SEGMENT, "left").join(spread, SEGMENT, "left")
    signal = F.max("profiles").over(W.partitionBy(*SEGMENT)) >= floor
    full = full.withColumn("interpolated", ~signal & (F.coalesce("anchor_months", F.lit(0)) >= 2))
    cover, cover_then = coverage_at(age_months("month", as_of), curve), coverage_at(age_months("r_month", as_of), curve)
    corrected_then = F.col("anchor_profiles") / cover_then
    full = full.withColumn("factor", F.lit(1.0) / cover).withColumn("scale", F.when(F.col("anchor_profiles") > 0, F.col("profiles") * (F.lit(1.0) / cover) / corrected_then))
    case = F.when(F.col("interpolated"), "i").when(F.col("r_point").isNull(), "none").when(F.col("anchor_profiles") <= 0, "flat").when(F.col("profiles") < floor, "few").otherwise("scaled")
    full = full.withColumn("case", case)
    on = F.col("case")
    value = lambda c: F.when(on == "i", F.col(f"i_{c}")).when(on == "none", 0.0).when(on == "scaled", F.col(f"r_{c}") * F.col("scale")).otherwise(F.col(f"r_{c}"))
    out = full.withColumn("value_min", value("min")).withColumn("value_point", value("point")).withColumn("value_max", value("max"))
    i_band = distance_band("i_distance")
    none_ids = F.array().cast("array<string>")
    return out.select(
        *SEGMENT, "month", "value_min", "value_point", "value_max",
        F.when(on == "i", 0).otherwise(F.col("profiles")).cast("long").alias("profiles"),
        F.when(on == "i", F.col("i_point")).when(on == "none", 0.0).otherwise(F.col("r_point")).alias("anchor_value"),
        F.when(on == "i", INTERPOLATED).when(on == "flat", DEGRADED).when(on == "scaled", SCALED).otherwise(SUPPRESSED).alias("method"),
        F.when(on == "i", i_band).when(on == "flat", "low").when(on == "scaled", width_band("value_point", F.greatest(F.lit(0.0), F.col("value_max") - F.col("value_min")))).otherwise("manual_review_required").alias("band"),
        F.when(on == "i", F.col("beyond") | (i_band == "manual_review_required")).otherwise(on != "scaled").alias("needs_review"),
        F.when((on == "i") & F.col("beyond"), "extrapolated_beyond_anchor_range").when(on == "none", "no_anchor_in_segment").when(on == "flat", "anchor_month_has_no_profiles")
        .when(on == "few", F.concat(F.lit("profiles_below_floor("), F.col("profiles").cast("string"), F.lit(f"<{floor})"))).alias("suppression_reason"),
        F.when(on.isin("i", "none"), 1.0).otherwise(F.col("factor")).alias("coverage_factor"),
        F.when(on == "scaled", F.col("scale")).otherwise(1.0).alias("ratio"),
        F.when(on == "i", F.col("i_anchor_month")).otherwise(F.col("r_month")).alias("anchor_month"),
        F.when(on == "i", F.col("i_ids")).when(on == "none", none_ids).otherwise(F.col("r_ids")).alias("contributing_ids"),
    )


def suppress(series: DataFrame, windows: DataFrame) -> DataFrame:
    """Force months inside an analyst's window (company_id, start_month, end_month, reason, load_order) to review; the first window names the reason."""
    hit = in_ranges(series.select("company_id", "month"), "month", windows.select("company_id", "start_month", "end_month", "reason", "load_order"), "start_month", "end_month")
    first = hit.groupBy("company_id", "month").agg(F.min_by("reason", "load_order").alias("_reason"))
    out = series.join(first, ["company_id", "month"], "left")
    on = F.col("_reason").isNotNull()
    text = F.substring(F.concat(F.lit("manual_suppress("), F.col("_reason"), F.lit(")")), 1, 256)
    for c, v in (("method", F.lit(SUPPRESSED)), ("band", F.lit("manual_review_required")), ("needs_review", F.lit(True)), ("suppression_reason", text)):
        out = out.withColumn(c, F.when(on, v).otherwise(F.col(c)))
    return out.withColumn("suppressed_by", F.col("_reason")).drop("_reason").select(*series.columns, "suppressed_by")
