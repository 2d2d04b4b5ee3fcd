"""Corporate events: merging duplicates, promoting hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.config import EVENT_PRECEDENCE, HINT_EVENT
from rosterlake.functions.expressions import lookup, month_floor, natural_id

GROUP = ["company_id", "event_type", "event_month"]


def merge_events(events: DataFrame) -> DataFrame:
    """One survivor a (company, type, month): best class, confidence, earliest, smallest id.

    It takes the group's highest confidence (1 at most) and, if it has no
    description, the first one of the others by class and id.  Adds merged, the
    number of rows of the group.
    """
    rank = lookup(EVENT_PRECEDENCE, "source_class", 0)
    best = W.partitionBy(*GROUP).orderBy(rank.desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("created_at").asc_nulls_last(), "event_id")
    whole = W.partitionBy(*GROUP)
    text = F.when(F.trim("description") != "", F.col("description"))
    # first described row by class, then id, as a minimum: no second sort
    other = F.min(F.when(text.isNotNull(), F.struct((-rank).alias("r"), "event_id", text.alias("t")))).over(whole)["t"]
    out = events.withColumn("_n", F.row_number().over(best)).withColumn("_c", F.max(F.coalesce("confidence", F.lit(0.0))).over(whole)).withColumn("_d", other).withColumn("merged", F.count("*").over(whole))
    kept = out.where("_n = 1")
    return kept.withColumn("confidence", F.when(F.col("merged") > 1, F.least(F.lit(1.0), F.col("_c"))).otherwise(F.col("confidence"))).withColumn("description", F.coalesce(text, F.when(F.col("merged") > 1, F.col("_d")), F.col("description"))).drop("_n", "_c", "_d")


def merge_counts(events: DataFrame) -> DataFrame:
    """groups_considered, groups_collapsed, rows_deleted."""
    sizes = events.groupBy(*GROUP).count()
    return sizes.agg(F.count("*").alias("groups_considered"), F.count(F.when(F.col("count") > 1, 1)).alias("groups_collapsed"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows_deleted"))


def promote_hints(hints: DataFrame, existing: DataFrame, default_confidence: float = 0.5) -> dict[str, DataFrame]:
    """Pending hints (hint_id, company_id, hint_type, event_month, description, status) become events.

    events: those that are not there yet, one a (company, type, month);
    status: hint_id and its new status (promoted, duplicate, no_company,
    no_month, unmapped).
    """
    kind = lookup(HINT_EVENT, "hint_type", None)
    rows = hints.where(F.col("status") == "pending").withColumn("event_type", kind).withColumn("event_month", month_floor("event_month"))
    problem = F.when(F.col("event_type").isNull(), "unmapped").when(F.col("company_id").isNull(), "no_company").when(F.col("event_month").isNull(), "no_month")
    rows = rows.withColumn("problem", problem)
    there = existing.select(*GROUP).distinct().withColumn("_there", F.lit(True))
    order = W.partitionBy(*GROUP).orderBy("hint_id")
    fine = rows.where("problem is null").join(there, GROUP, "left").withColumn("_n", F.row_number().over(order))
    new = fine.where("_there is null and _n = 1")
    events = new.select(natural_id(*GROUP).alias("event_id"), *GROUP, F.lit("benchmark").alias("source_class"), F.lit(default_confidence).alias("confidence"), "description")
    status = rows.where("problem is not null").select("hint_id", F.col("problem").alias("status")).unionByName(fine.select("hint_id", F.when(F.col("_there").isNull() & (F.col("_n") == 1), "promoted").otherwise("duplicate").alias("status")))
    return {"events": events, "status": status}
