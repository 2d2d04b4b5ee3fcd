"""Whole jobs over the stored tables: re-extraction of the page archive, and the employment stage before an estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.operators import evidence as X
from rosterlake.operators import promotion as PR
from rosterlake.operators import resolution as RS
from rosterlake.sources import tables as TB

SIGNAL_COLUMNS = ("company_id", "source_name", "url", "snapshot_month", "statement", "value_min", "value_point", "value_max", "kind", "confidence", "text")


def reextract(archive: DataFrame, companies: DataFrame, stored: DataFrame) -> DataFrame:
    """Signals of archived pages (page_id, url, status, body) that are not among the stored ones yet.

    Pages of web archives (.../web/<stamp>/<origin>) count for the company of
    their origin and the month of their stamp, with the archive's confidences;
    other pages for the company of their host.  Pages that were refused, and
    pages of no known company, give nothing.
    """
    at = X.archive_url("url")
    pages = archive.where("status < 400").withColumn("at", at)
    pages = pages.select("page_id", F.coalesce("at.origin", "url").alias("url"), "at.snapshot_month", F.col("body").alias("html"))
    owner = RS.host_to_company(pages, companies)
    found = X.page_signals(pages, keep=("url", "snapshot_month")).join(owner, "page_id")
    archived = F.col("snapshot_month").isNotNull()
    of_page = F.when(F.col("method") == "json_ld", "json_ld").when(F.col("kind") == "exact", "exact").otherwise("range")
    statement = F.when(archived, F.when(F.col("method") == "json_ld", "json_ld").otherwise("text")).otherwise(of_page)
    rows = found.drop("confidence").withColumn("source", F.when(archived, "archive").otherwise("company_page")).withColumn("statement", statement)
    text = F.concat_ws("|", "method", "kind", "value_min", "value_point", "value_max", "snapshot_month")
    priced = X.with_confidence(rows).withColumn("source_name", F.col("source")).withColumn("text", text)
    return TB.new_signals(priced.select(*SIGNAL_COLUMNS), stored)


def employment_stage(
    benchmarks: DataFrame, anchors: DataFrame, profiles: DataFrame, employment: DataFrame, companies: DataFrame, trends: DataFrame, skip_providers: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """Promote reference rows, load profile rows, and back-compute anchors from growth statements, in this order.

    anchors: the anchors to add (promoted ones, then those back-computed from
    the newest current anchor, old or promoted); employment: the rows to add;
    counts (stage, outcome, n).
    """
    promoted = PR.promote_benchmarks(benchmarks, anchors, skip_providers)
    loaded = TB.load_employment(profiles, companies, employment)
    columns = [c for c in promoted["anchors"].columns if c in anchors.columns]
    known = anchors.select(*columns).unionByName(promoted["anchors"].select(*columns))
    past = PR.trend_anchors(known, trends).select(*columns).join(known.select("company_id", "anchor_id"), ["company_id", "anchor_id"], "left_anti")
    counts = promoted["counts"].select(F.lit("benchmarks").alias("stage"), "outcome", "n")
    counts = counts.unionByName(loaded["counts"].select(F.lit("profiles").alias("stage"), F.col("reason").alias("outcome"), F.col("count").alias("n")))
    counts = counts.unionByName(past.agg(F.lit("trends").alias("stage"), F.lit("added").alias("outcome"), F.count("*").alias("n")))
    return {"anchors": promoted["anchors"].select(*columns).unionByName(past), "employment": loaded["rows"], "counts": counts}
