"""Accuracy against reference providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.config import BANDS, GROWTH_METRIC, METRIC_OFFSET, EvaluationConfig
from rosterlake.functions.expressions import declined, intervals_overlap, lookup, month_floor
from rosterlake.operators.growth import latest_growth
from rosterlake.sources.tables import checkpointed


def latest_version(versions: DataFrame) -> DataFrame:
    """company_id and its newest version (ties by id)."""
    return versions.groupBy("company_id").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("version_id"), F.max("created_at").alias("created_at"))


def disagreements(benchmarks: DataFrame, series: DataFrame, config: EvaluationConfig = EvaluationConfig(), as_of_is_shifted: bool = True) -> DataFrame:
    """Reference rows that differ from the estimate of their month by more than the gap, or whose interval misses it.

    as_of_month is the month that a row is about, as `sources.benchmarks` loads
    it; with as_of_is_shifted=False it is the sheet's month, from which
    headcount metrics look back by their offset.
    """
    offset = F.lit(0) if as_of_is_shifted else lookup(METRIC_OFFSET, "metric", 0)
    rows = benchmarks.where(F.col("metric").isin(*METRIC_OFFSET) & F.col("value_point").isNotNull() & F.col("company_id").isNotNull() & F.col("as_of_month").isNotNull())
    rows = rows.select("company_id", "benchmark_id", "provider", "metric", F.add_months(month_floor("as_of_month"), offset).alias("month"), F.col("value_min").alias("b_min"), F.col("value_point").alias("benchmark_point"), F.col("value_max").alias("b_max"))
    est = series.select("company_id", "month", "value_min", F.col("value_point").alias("estimate_point"), "value_max")
    gap = F.abs(F.col("benchmark_point") - F.col("estimate_point")) / F.greatest(F.lit(1.0), F.col("benchmark_point"))
    joined = rows.join(est, ["company_id", "month"]).withColumn("relative_gap", gap).withColumn("interval_overlap", intervals_overlap("b_min", "b_max", "value_min", "value_max"))
    return joined.where((F.col("relative_gap") > config.gap) | ~F.col("interval_overlap")).drop("b_min", "b_max", "value_min", "value_max")


def scored_rows(benchmarks: DataFrame, series: DataFrame, as_of: Column, config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """One row for each headcount reference row that meets an estimate month.

    company_id, benchmark_id, provider, metric, month, points, band, skipped
    (the estimator declined), overlap, error and error_pct (0 for credited
    overlaps, null where skipped), ratio.
    """
    rows = benchmarks.where(F.col("metric").isin(*METRIC_OFFSET) & F.col("value_point").isNotNull())
    current = F.col("metric") == "headcount_current"
    month = F.when(current & F.col("as_of_month").isNotNull(), month_floor("as_of_month")).otherwise(F.add_months(as_of, lookup(METRIC_OFFSET, "metric", 0)))
    rows = rows.select("company_id", "benchmark_id", "provider", "metric", "row_index", month.alias("month"), F.col("value_min").alias("b_min"), F.col("value_point").alias("benchmark_point"), F.col("value_max").alias("b_max"))
    est = series.select("company_id", "month", F.col("value_min").alias("e_min"), F.col("value_point").alias("estimate_point"), F.col("value_max").alias("e_max"), "method", "band")
    joined = rows.join(est, ["company_id", "month"]).withColumn("skipped", declined("method", "band", current)).withColumn("overlap", intervals_overlap("e_min", "e_max", "b_min", "b_max"))
    gap = F.abs(F.col("estimate_point") - F.col("benchmark_point"))
    credit = F.col("overlap") & F.lit(config.credit_overlap)
    error = F.when(~F.col("skipped"), F.when(credit, 0.0).otherwise(gap))
    pct = F.when(~F.col("skipped"), F.when(credit, 0.0).when(F.col("benchmark_point") != 0, gap / F.abs("benchmark_point")))
    ratio = F.when(~F.col("skipped"), gap / F.greatest(F.lit(1.0), F.abs("benchmark_point")))
    return joined.withColumn("error", error).withColumn("error_pct", pct).withColumn("ratio", ratio).drop("b_min", "b_max", "e_min", "e_max", "method")


def growth_rows(benchmarks: DataFrame, series: DataFrame) -> DataFrame:
    """One row for each growth reference row of an estimated company: provider, metric (6m, 1y, 2y), skipped, ratios, error."""
    rows = benchmarks.where(F.col("metric").isin(*GROWTH_METRIC) & F.col("value_point").isNotNull()).select("company_id", "benchmark_id", "provider", lookup(GROWTH_METRIC, "metric", None).alias("metric"), (F.col("value_point") / 100).alias("benchmark_ratio"))
    known = series.select("company_id").distinct()
    mine = latest_growth(series).select("company_id", F.col("horizon").alias("metric"), F.col("growth_point").alias("estimate_ratio"))
    joined = rows.join(known, "company_id", "left_semi").join(mine, ["company_id", "metric"], "left").withColumn("skipped", F.col("estimate_ratio").isNull())
    error = F.abs(F.col("estimate_ratio") - F.col("benchmark_ratio"))
    return joined.withColumn("error", error).withColumn("error_pct", F.when(F.col("benchmark_ratio") != 0, error / F.abs("benchmark_ratio")))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys come from the left."""
    other = right.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return left.join(other, same, how).drop(*(f"_{k}" for k in keys))


def value_places(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Where each distinct value of a key stands: keys, value, n (rows with it), before (rows below it), of (all rows of the key).

    A row counts once, or as often as its column `weight` says.  Counted values
    are dealt into ranges, so a key with any number of rows is spread over
    tasks; only one total a key and range is summed up in order.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    dealt = checkpointed(counts.repartitionByRange(*keys, value).withColumn("shard", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "shard").agg(F.sum("n").alias("total"))
    key = W.partitionBy(*keys)
    earlier = key.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_offset"), F.sum("total").over(key).alias("of"))
    below = W.partitionBy(*keys, "shard").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = dealt.withColumn("_below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    placed = null_safe_join(inside, offsets, [*keys, "shard"])
    return placed.select(*keys, value, "n", (F.col("_offset") + F.col("_below")).alias("before"), "of")


def exact_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the exact median of a value, without collecting a key's values."""
    places = value_places(rows, keys, value)
    holds = lambda rank: ((F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))).cast("int")
    weight = holds(F.floor((F.col("of") - 1) / 2)) + holds(F.floor(F.col("of") / 2))
    middle = places.withColumn("_weight", weight).where("_weight > 0")
    return middle.groupBy(*keys).agg((F.sum(F.col(value) * F.col("_weight")) / 2).alias(name))


def accuracy(rows: DataFrame) -> DataFrame:
    """provider, metric, n, mae, mape, median_abs_error, skipped_declined."""
    keys = ["provider", "metric"]
    rows = checkpointed(rows.select(*keys, "error", "error_pct", "skipped"))
    means = rows.groupBy(*keys).agg(
        F.count("error").alias("n"), F.avg("error").alias("mae"), F.avg("error_pct").alias("mape"), F.count(F.when(F.col("skipped"), 1)).alias("skipped_declined")
    )
    joined = null_safe_join(means, exact_median(rows, keys, "error", "median_abs_error"), keys, "left")
    return joined.select(*keys, "n", "mae", "mape", "median_abs_error", "skipped_declined")


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation for each key, with average ranks; null below three pairs or without variance.

    Equal pairs are counted once, and ranks come from `value_places`.
    """
    counted = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("m"))
    counted = checkpointed(counted)
    ranked = counted
    for value, rank in ((x, "rx"), (y, "ry")):
        places = value_places(counted, keys, value, "m").select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias(rank))
        ranked = null_safe_join(ranked, places, [*keys, value])
    total = lambda e: F.sum(e * F.col("m"))
    rx, ry = F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*keys).agg(F.sum("m").alias("n"), total(rx).alias("sx"), total(ry).alias("sy"), total(rx * rx).alias("sxx"), total(ry * ry).alias("syy"), total(rx * ry).alias("sxy"))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    rho = F.when((F.col("n") >= 3) & (vx > 1e-9) & (vy > 1e-9), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    return sums.select(*keys, "n", rho.alias("rho"))


def band_histogram(series: DataFrame) -> DataFrame:
    """band, months for every band, zeros too."""
    bands = series.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    return bands.join(series.groupBy("band").agg(F.count("*").alias("n")), "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("months"))


def top_disagreements(rows: DataFrame, config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """The widest material gaps; the limit is the report's feature."""
    return rows.where(F.col("ratio") > config.material_ratio).orderBy(F.desc("ratio"), "company_id", "provider", "metric", "benchmark_id").limit(config.top)


def scoreboard(companies: DataFrame, benchmarks: DataFrame, series: DataFrame, as_of: Column, config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """One row: scope, evaluated, declined, cohort and disagreement counts, coverage ratios."""
    rows = scored_rows(benchmarks, series, as_of, config)
    per = series.groupBy("company_id").agg(F.min(declined("method", "band", True).cast("int")).alias("all_declined"))
    refs = benchmarks.where(F.col("company_id").isNotNull()).groupBy("company_id").agg(F.max((F.col("provider") == config.primary_provider).cast("int")).alias("primary"))
    scope = companies.select("company_id").distinct().join(per, "company_id", "left").join(refs, "company_id", "left")
    has, ref, prim = F.col("all_declined").isNotNull(), F.col("primary").isNotNull(), F.col("primary") == 1
    count = lambda c: F.count(F.when(c, 1))
    totals = scope.agg(F.count("*").alias("companies_in_scope"), count(has).alias("companies_evaluated"), count(ref).alias("companies_with_benchmark"), count(F.col("all_declined") == 1).alias("companies_declined"), count(has & ref).alias("_both"), count(prim).alias("cohort_size"), count(prim & has).alias("cohort_evaluated"))
    strong = F.col("band").isin("high", "medium") & (F.col("ratio") > config.material_ratio) & (F.col("ratio") >= config.strong_ratio)
    mine = F.col("provider") == config.primary_provider
    bad = rows.agg(count(strong & mine).alias("high_confidence_disagreements"), count(strong & ~mine).alias("supporting_disagreements"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return totals.crossJoin(bad).withColumn("coverage_in_scope", share("companies_evaluated", "companies_in_scope")).withColumn("coverage_with_benchmark", share("_both", "companies_with_benchmark")).drop("_both")


def snapshot(board: DataFrame, evaluation_id: Column, evaluated_at: Column) -> DataFrame:
    """An immutable scoreboard row: id, time, and the board as JSON."""
    return board.select(evaluation_id.alias("evaluation_id"), evaluated_at.alias("evaluated_at"), F.to_json(F.struct(*board.columns)).alias("scoreboard"))


def comparison(benchmarks: DataFrame, series: DataFrame, config: EvaluationConfig = EvaluationConfig(), as_of_is_shifted: bool = True) -> DataFrame:
    """company_id, compared, disagreements, match_rate: reference rows with an estimate month, and those beyond the gap."""
    offset = F.lit(0) if as_of_is_shifted else lookup(METRIC_OFFSET, "metric", 0)
    rows = benchmarks.where(F.col("metric").isin(*METRIC_OFFSET) & F.col("value_point").isNotNull()).select("company_id", "benchmark_id", F.add_months(month_floor("as_of_month"), offset).alias("month"))
    compared = rows.join(series.select("company_id", "month"), ["company_id", "month"], "left_semi").groupBy("company_id").agg(F.count("*").alias("compared"))
    bad = disagreements(benchmarks, series, config, as_of_is_shifted).groupBy("company_id").agg(F.count("*").alias("disagreements"))
    out = compared.join(bad, "company_id", "left").withColumn("disagreements", F.coalesce("disagreements", F.lit(0)))
    return out.withColumn("match_rate", 1 - F.col("disagreements") / F.col("compared"))


def comparison_matches(benchmarks: DataFrame, series: DataFrame, companies: DataFrame, config: EvaluationConfig = EvaluationConfig(), as_of_is_shifted: bool = True) -> DataFrame:
    """company_id, name and matches: every reference row that meets an estimate month, by month and row, with the relative delta and whether it is a disagreement."""
    offset = F.lit(0) if as_of_is_shifted else lookup(METRIC_OFFSET, "metric", 0)
    rows = benchmarks.where(F.col("metric").isin(*METRIC_OFFSET) & F.col("value_point").isNotNull())
    rows = rows.select("company_id", "benchmark_id", "provider", F.add_months(month_floor("as_of_month"), offset).alias("month"), F.col("value_point").alias("benchmark_point"))
    est = series.select("company_id", "month", F.col("value_point").alias("estimate_point"), F.col("value_min").alias("estimate_min"), F.col("value_max").alias("estimate_max"))
    bad = disagreements(benchmarks, series, config, as_of_is_shifted).select("benchmark_id", F.lit(True).alias("_bad")).distinct()
    delta = (F.col("estimate_point") - F.col("benchmark_point")) / F.greatest(F.lit(1.0), F.col("benchmark_point"))
    met = rows.join(est, ["company_id", "month"]).join(bad, "benchmark_id", "left")
    met = met.withColumn("disagreement", F.coalesce("_bad", F.lit(False))).withColumn("relative_delta", delta)
    cells = ["month", "benchmark_id", "provider", "estimate_point", "estimate_min", "estimate_max", "benchmark_point", "disagreement", "relative_delta"]
    grouped = met.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(*cells))).alias("matches"))
    return grouped.join(companies.select("company_id", "name"), "company_id", "left").select("company_id", "name", "matches")


def comparison_totals(benchmarks: DataFrame, compared: DataFrame) -> DataFrame:
    """One row over a `comparison`: companies with reference rows, those compared, reference rows of any metric, compared, disagreements, match_rate (0 without any)."""
    refs = benchmarks.where(F.col("company_id").isNotNull()).agg(F.count_distinct("company_id").alias("companies_with_benchmarks"), F.count("*").alias("benchmarks_total"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    mine = compared.agg(F.count("*").alias("companies_compared"), total("compared").alias("benchmarks_matched"), total("disagreements").alias("disagreements_total"))
    rate = F.when(F.col("benchmarks_matched") > 0, 1 - F.col("disagreements_total") / F.col("benchmarks_matched")).otherwise(0.0)
    return refs.crossJoin(mine).withColumn("match_rate", rate)


def headline(levels: DataFrame, growths: DataFrame, ranks: DataFrame, config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """The key figures in one row: mape_current, growth_mae_* and spearman_* of 6m, 1y and 2y.

    levels and growths are `accuracy`, ranks is `spearman` by provider and
    metric.  They are the primary provider's; its growth error gives way to the
    fallback provider's where it has none, and at 2y the fallback's alone counts.
    """
    at = lambda provider, metric, c: F.max(F.when((F.col("provider") == provider) & (F.col("metric") == metric), F.col(c)))
    first, other = config.primary_provider, config.fallback_provider
    size = levels.agg(at(first, "headcount_current", "mape").alias("mape_current"))
    errors = {h: at(other, h, "mae") if h == "2y" else F.coalesce(at(first, h, "mae"), at(other, h, "mae")) for h in ("6m", "1y", "2y")}
    growth = growths.agg(*(e.alias(f"growth_mae_{h}") for h, e in errors.items()))
    order = ranks.agg(*(at(first, h, "rho").alias(f"spearman_{h}") for h in errors))
    return size.crossJoin(growth).crossJoin(order)


def side_by_side(benchmarks: DataFrame, series: DataFrame, as_of: Column) -> DataFrame:
    """company_id, provider, and for t, t-6m, t-1y, t-2y the mean reference and the estimate, with growth in percent."""
    back = {0: "now", 6: "6m", 12: "1y", 24: "2y"}
    ref = benchmarks.where(F.col("metric").isin(*METRIC_OFFSET)).withColumn("back", -lookup(METRIC_OFFSET, "metric", 0))
    target = ref.groupBy("company_id", "provider").pivot("back", list(back)).agg(F.avg("value_point"))
    spread = series.withColumn("back", F.months_between(as_of, "month").cast("int")).where(F.col("back").isin(*back)).groupBy("company_id").pivot("back", list(back)).agg(F.max("value_point"))
    named = lambda df, p: df.select(*(F.col(c) if c in ("company_id", "provider") else F.col(c).alias(f"{p}_{back[int(c)]}") for c in df.columns))
    out = named(target, "target").join(named(spread, "estimate"), "company_id", "left")
    for h in ("6m", "1y", "2y"):
        for p in ("target", "estimate"):
            out = out.withColumn(f"{p}_growth_{h}", F.when(F.col(f"{p}_{h}") > 0, (F.col(f"{p}_now") / F.col(f"{p}_{h}") - 1) * 100))
    return out


def expectation_diff(expected: DataFrame, series: DataFrame) -> DataFrame:
    """Expected samples (company_id, month, value_point, tolerance) against a series: ok, missing or off.

    A sample may differ by its relative tolerance or by one person.
    """
    joined = expected.join(series.select("company_id", "month", F.col("value_point").alias("estimate_point")), ["company_id", "month"], "left")
    room = F.greatest(F.lit(1.0), F.abs(F.col("value_point")) * F.col("tolerance"))
    verdict = F.when(F.col("estimate_point").isNull(), "missing").when(F.abs(F.col("estimate_point") - F.col("value_point")) > room, "off").otherwise("ok")
    return joined.withColumn("verdict", verdict)


def error_summary(rows: DataFrame) -> DataFrame:
    """One row over targets (company_id, target, estimate): scored, declined (estimate not above 0), unmatched (no company), and the mean absolute error in percent of the target."""
    known, given = F.col("company_id").isNotNull(), F.col("estimate").isNotNull()
    scored = known & given & (F.col("estimate") > 0)
    error = F.when(scored & (F.col("target") != 0), F.abs(F.col("estimate") - F.col("target")) / F.abs("target") * 100)
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(count(scored).alias("scored"), count(known & given & (F.col("estimate") <= 0)).alias("declined"), count(~known).alias("unmatched"), F.avg(error).alias("mape_pct"))


def golden_diff(samples: DataFrame, growths: DataFrame, bands: DataFrame, series: DataFrame) -> DataFrame:
    """What a series misses of its expectations: company_id, kind, item, expected, actual, expected_band, actual_band.

    samples: see `expectation_diff`.  growths: company_id, horizon, pct,
    tolerance (points of percent) against the newest growth.  bands: company_id,
    band of the newest month.
    """
    none = F.lit(None).cast("string")
    values = lambda kind, item, expected, actual: (kind.alias("kind"), item.alias("item"), expected.cast("double").alias("expected"), actual.cast("double").alias("actual"), none.alias("expected_band"), none.alias("actual_band"))
    judged = expectation_diff(samples, series).where("verdict <> 'ok'")
    kind = F.when(F.col("verdict") == "missing", "missing_monthly_estimate").otherwise("monthly_estimate_out_of_tolerance")
    level = judged.select("company_id", *values(kind, F.date_format("month", "yyyy-MM-dd"), F.col("value_point"), F.col("estimate_point")))
    mine = latest_growth(series).select("company_id", "horizon", (F.col("growth_point") * 100).alias("_pct"))
    grown = growths.join(mine, ["company_id", "horizon"], "left").where(F.col("_pct").isNull() | (F.abs(F.col("_pct") - F.col("pct")) > F.col("tolerance")))
    kind = F.when(F.col("_pct").isNull(), "missing_growth_window").otherwise("growth_out_of_tolerance")
    growth = grown.select("company_id", *values(kind, F.col("horizon"), F.col("pct"), F.col("_pct")))
    last = series.groupBy("company_id").agg(F.max_by("band", "month").alias("_band"))
    off = bands.join(last, "company_id", "left").where(F.col("_band").isNull() | (F.col("_band") != F.col("band")))
    kind = F.when(F.col("_band").isNull(), "no_estimates").otherwise("confidence_band_drift")
    number = F.lit(None).cast("double")
    band = off.select("company_id", kind.alias("kind"), F.lit("latest").alias("item"), number.alias("expected"), number.alias("actual"), F.col("band").alias("expected_band"), F.col("_band").alias("actual_band"))
    return level.unionByName(growth).unionByName(band)
