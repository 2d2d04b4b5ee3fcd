"""Evidence that becomes anchors: reference rows, analyst entries, growth trends; and the repair of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.config import METRIC_OFFSET, PROVIDER_FLOOR, PROVIDER_FLOOR_ELSE
from rosterlake.functions.expressions import lookup, month_floor, natural_id
from rosterlake.functions.text import back_computed
from rosterlake.operators.resolution import keyed, lookup_first

TREND_CONFIDENCE = 0.40
MANUAL_CONFIDENCE = 0.95


def promote_benchmarks(benchmarks: DataFrame, existing: DataFrame, skip_providers: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Headcount reference rows -> anchors that are not there yet, and counts by outcome.

    Outcomes: skipped_provider, skipped_no_company, skipped_no_value (no point,
    no month, or an interval that misses the point), already_promoted, promoted.
    A missing bound is the point; the provider sets the confidence.
    """
    rows = benchmarks.where(F.col("metric").isin(*METRIC_OFFSET))
    low, high = F.coalesce("value_min", "value_point"), F.coalesce("value_max", "value_point")
    bad = F.col("value_point").isNull() | F.col("as_of_month").isNull() | (low > F.col("value_point")) | (high < F.col("value_point"))
    kind = F.col("kind") if "kind" in benchmarks.columns else F.lit(None).cast("string")
    shaped = rows.select(
        "company_id", natural_id("provider", "metric", "benchmark_id").alias("anchor_id"), month_floor("as_of_month").alias("anchor_month"), low.alias("value_min"), "value_point", high.alias("value_max"), F.coalesce(kind, F.lit("exact")).alias("kind"),
        F.when(F.col("metric") == "headcount_current", "current_headcount_anchor").otherwise("historical_statement").alias("anchor_type"), lookup(PROVIDER_FLOOR, "provider", PROVIDER_FLOOR_ELSE).alias("confidence"), F.lit("benchmark").alias("source_name"),
        F.when(F.col("provider").isin(*skip_providers), "skipped_provider").when(F.col("company_id").isNull(), "skipped_no_company").when(bad, "skipped_no_value").alias("problem"),
    )
    there = existing.select("company_id", "anchor_id").distinct().withColumn("_there", F.lit(True))
    judged = shaped.join(there, ["company_id", "anchor_id"], "left").withColumn("outcome", F.coalesce("problem", F.when(F.col("_there"), "already_promoted"), F.lit("promoted"))).drop("problem", "_there")
    return {"anchors": judged.where("outcome = 'promoted'").drop("outcome").dropDuplicates(["company_id", "anchor_id"]), "counts": judged.groupBy("outcome").agg(F.count("*").alias("n"))}


def manual_entries(entries: DataFrame, companies: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Analyst anchors (entry_id, name, domain, profile_url, anchor_month, value_*, kind, confidence, note) matched by domain, slug, name or alias.

    An entry without a note is rejected; without a confidence it has 0.95.
    """
    noted = F.coalesce(F.trim("note") != "", F.lit(False))
    good = entries.where(noted)
    names = companies.join(aliases.groupBy("company_id").agg(F.collect_set("alias").alias("more")), "company_id", "left")
    names = names.withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    mine, theirs = keyed(good, "entry_id", "domain", "profile_url", "name"), keyed(names, "company_id", "domain", "profile_url", "name", "more")
    hit = lookup_first(mine, theirs, "entry_id", "company_id")
    found = good.join(hit.drop("rank"), "entry_id")
    anchors = found.select("company_id", natural_id("entry_id", "company_id").alias("anchor_id"), month_floor("anchor_month").alias("anchor_month"), "value_min", "value_point", "value_max", "kind", F.lit("manual_anchor").alias("anchor_type"), F.coalesce("confidence", F.lit(MANUAL_CONFIDENCE)).alias("confidence"), F.lit("manual").alias("source_name"))
    rejected = entries.where(~noted).select("entry_id", F.lit("note_required").alias("reject_reason")).unionByName(good.join(hit, "entry_id", "left_anti").select("entry_id", F.lit("no_company").alias("reject_reason")))
    return {"anchors": anchors, "rejected": rejected}


def latest_current_anchor(anchors: DataFrame) -> DataFrame:
    """The newest current anchor of each company."""
    best = anchors.where("anchor_type = 'current_headcount_anchor'").groupBy("company_id").agg(F.max(F.struct("anchor_month", "anchor_id", "value_min", "value_point", "value_max")).alias("a"))
    return best.select("company_id", "a.*")


def missing_current(companies: DataFrame, anchors: DataFrame) -> DataFrame:
    """Companies whose current anchor is missing or not above zero."""
    return companies.join(latest_current_anchor(anchors).where("value_point > 0").select("company_id"), "company_id", "left_anti")


def trend_anchors(anchors: DataFrame, trends: DataFrame) -> DataFrame:
    """Past anchors back-computed from a company's current one and its growth statements (company_id, trends)."""
    now = latest_current_anchor(anchors).join(trends, "company_id")
    past = back_computed(now)
    return past.select("company_id", natural_id("company_id", "anchor_month", "months").alias("anchor_id"), "anchor_month", F.col("value_point").alias("value_min"), "value_point", F.col("value_point").alias("value_max"), F.lit("exact").alias("kind"), F.lit("historical_statement").alias("anchor_type"), F.lit(TREND_CONFIDENCE).alias("confidence"), F.lit("growth_trend").alias("source_name"))


def backfill_company(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fill a missing company_id from the candidate that a row came from."""
    known = candidates.select("candidate_id", F.col("company_id").alias("_c"))
    return rows.join(known, "candidate_id", "left").withColumn("company_id", F.coalesce("company_id", "_c")).drop("_c")


def fill_profile_urls(companies: DataFrame, resolved: DataFrame) -> DataFrame:
    """Blank profile URLs from the resolved ones (company_id, resolved_url)."""
    return companies.join(resolved, "company_id", "left").withColumn("profile_url", F.coalesce(F.nullif(F.trim("profile_url"), F.lit("")), "resolved_url")).drop("resolved_url")


def purge_sources(observations: DataFrame, anchors: DataFrame, banned: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(observations, anchors) without those of banned sources."""
    gone = observations.where(F.col("source_name").isin(*banned)).select("observation_id")
    return observations.where(~F.col("source_name").isin(*banned)), anchors.join(gone, "observation_id", "left_anti")


def consolidate(observations: DataFrame, anchors: DataFrame, theirs: DataFrame, ours: DataFrame, aliases: DataFrame, stored: DataFrame, allowed: tuple[str, ...]) -> dict[str, DataFrame]:
    """Observations of another snapshot, with their anchors, that ours takes over under our company ids.

    observations: observation_id (their order), source_name, content_hash;
    anchors: anchor_id, observation_id, company_id (of an observation's anchors
    the one with the largest anchor_id counts); theirs and ours: company_id,
    name, domain; aliases: company_id, alias; stored: source_name, content_hash
    of ours.  Companies match by name and domain, else by name (one of ours
    without a domain first), else by alias, all trimmed and lower-cased.

    judged: observation_id, company_id, outcome: skipped_source, skipped_dup (of
    ours, or of an earlier merged one), no_anchor, skipped_unmapped, merged.
    """
    fold = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    own = ours.select(fold("name").alias("_n"), fold("domain").alias("_d"), "company_id").where("_n <> ''")
    pair = own.groupBy("_n", "_d").agg(F.min("company_id").alias("_pair"))
    alone = own.select("_n", F.when(F.col("_d") == "", 0).otherwise(1).alias("_rank"), "company_id")
    called = alone.unionByName(aliases.select(fold("alias").alias("_n"), F.lit(2).alias("_rank"), "company_id").where("_n <> ''"))
    alone = called.groupBy("_n").agg(F.min(F.struct("_rank", "company_id"))["company_id"].alias("_alone"))
    named = theirs.select(F.col("company_id").alias("_their"), fold("name").alias("_n"), fold("domain").alias("_d"))
    mapped = named.join(pair, ["_n", "_d"], "left").join(alone, "_n", "left").select("_their", F.coalesce("_pair", "_alone").alias("_our"))
    one = anchors.groupBy("observation_id").agg(F.max(F.struct("anchor_id", "company_id")).alias("_a"))
    there = stored.select("source_name", "content_hash").distinct().withColumn("_there", F.lit(True))
    rows = observations.select("observation_id", "source_name", "content_hash").join(one, "observation_id", "left")
    rows = rows.join(mapped, F.col("_a.company_id") == F.col("_their"), "left").join(there, ["source_name", "content_hash"], "left")
    problem = (
        F.when(~F.coalesce(F.col("source_name").isin(*allowed), F.lit(False)), "skipped_source").when(F.col("_there"), "skipped_dup")
        .when(F.col("_a").isNull(), "no_anchor").when(F.col("_our").isNull(), "skipped_unmapped")
    )
    rows = rows.withColumn("_problem", problem)
    first = rows.where("_problem is null").groupBy("source_name", "content_hash").agg(F.min("observation_id").alias("_first"))
    rows = rows.join(first, ["source_name", "content_hash"], "left")
    late = (F.col("observation_id") > F.col("_first")) & ~F.coalesce(F.col("_problem") == "skipped_source", F.lit(False))
    outcome = F.when(late, "skipped_dup").otherwise(F.coalesce("_problem", F.lit("merged")))
    judged = rows.withColumn("outcome", outcome).select("observation_id", F.when(F.col("outcome") == "merged", F.col("_our")).alias("company_id"), "outcome", F.col("_a.anchor_id").alias("anchor_id"))
    taken = judged.where("outcome = 'merged'").select("observation_id", "anchor_id", "company_id")
    return {
        "observations": observations.join(taken.select("observation_id"), "observation_id", "left_semi"),
        "anchors": anchors.drop("company_id").join(taken, ["observation_id", "anchor_id"]).select(anchors.columns),
        "judged": judged.drop("anchor_id"),
    }
