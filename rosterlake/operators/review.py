"""Review queue: candidates from a scored series, upsert, transitions, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.expressions import queue_priority

KEY = ["company_id", "reason", "version_id"]


def candidates(scored: DataFrame, segments: DataFrame) -> DataFrame:
    """At most one candidate a company and reason (low_confidence, anomaly, manual).

    company_id, reason, months, severity, confidence, first_months (the first
    six), labels (anomaly label:count, most frequent first), priority.
    """
    day = F.date_format("month", "yyyy-MM-dd")
    low = scored.where(F.col("score_band").isin("low", "manual_review_required")).groupBy("company_id").agg(F.count("*").alias("months"), F.min("score").alias("confidence"), F.slice(F.array_sort(F.collect_list(day)), 1, 6).alias("first_months"))
    low = low.select("company_id", F.lit("low_confidence").alias("reason"), "months", (1 - F.col("confidence")).alias("severity"), "confidence", F.array_join("first_months", ",").alias("first_months"), F.lit(None).cast("string").alias("labels"))
    flagged = scored.where("flagged")
    label = F.explode(F.transform("reasons", lambda r: F.split_part(r, F.lit("="), F.lit(1))))
    counts = flagged.select("company_id", label.alias("label")).groupBy("company_id", "label").count()
    labels = counts.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "label"))).alias("l")).select("company_id", F.array_join(F.transform("l", lambda x: F.concat(x.label, F.lit(":"), (-x.k).cast("string"))), ", ").alias("labels"))
    n_seg = segments.groupBy("company_id").agg(F.count("*").alias("n_segments"))
    odd = flagged.groupBy("company_id").agg(F.count("*").alias("months")).join(labels, "company_id").join(n_seg, "company_id")
    odd = odd.select("company_id", F.lit("anomaly").alias("reason"), "months", F.least(F.lit(1.0), F.col("months") / F.greatest(F.lit(1), F.col("n_segments") * 6)).alias("severity"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("first_months"), "labels")
    hits = scored.where(F.col("suppressed_by").isNotNull()).groupBy("company_id").agg(F.count("*").alias("months"), F.array_join(F.slice(F.array_sort(F.collect_list(day)), 1, 6), ",").alias("first_months"))
    hits = hits.select("company_id", F.lit("manual").alias("reason"), "months", F.lit(0.3).alias("severity"), F.lit(None).cast("double").alias("confidence"), "first_months", F.lit(None).cast("string").alias("labels"))
    return low.unionByName(odd).unionByName(hits).withColumn("priority", queue_priority("reason", "severity", "confidence"))


def upsert(queue: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The queue after candidates (KEY, priority, detail): inserted, refreshed where changed, closed items left alone.

    A new snapshot with an action for each row (inserted, refreshed, skipped,
    kept); plain Parquet has no MERGE.
    """
    cand = new.groupBy(*KEY).agg(F.max(F.struct("priority", "detail")).alias("c")).select(*KEY, F.col("c.priority").alias("c_priority"), F.substring("c.detail", 1, 2048).alias("c_detail"))
    on = None
    for k in KEY:
        on = (F.col(f"q.{k}").eqNullSafe(F.col(f"c.{k}"))) if on is None else on & F.col(f"q.{k}").eqNullSafe(F.col(f"c.{k}"))
    both = queue.withColumn("_old", F.lit(True)).alias("q").join(cand.withColumn("_new", F.lit(True)).alias("c"), on, "full")
    closed = F.col("q.status").isin("resolved", "dismissed")
    changed = ~F.col("q.priority").eqNullSafe(F.col("c_priority")) | ~F.col("q.detail").eqNullSafe(F.col("c_detail"))
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(closed, "skipped").when(changed, "refreshed").otherwise("skipped")
    take = F.col("action").isin("inserted", "refreshed")
    out = both.withColumn("action", action)
    keys = [F.coalesce(F.col(f"q.{k}"), F.col(f"c.{k}")).alias(k) for k in KEY]
    return out.select(*keys, F.when(take, F.col("c_priority")).otherwise(F.col("q.priority")).alias("priority"), F.coalesce("q.status", F.lit("open")).alias("status"), F.when(take, F.col("c_detail")).otherwise(F.col("q.detail")).alias("detail"), F.col("q.assignee").alias("assignee"), F.when(take, now).otherwise(F.col("q.updated_at")).alias("updated_at"), "action")


def apply_transitions(queue: DataFrame, requests: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Status requests (item key, to_status, assignee, actor) against the queue.

    assigned needs an assignee; open clears it; unknown items and states are
    rejected.  queue: the new snapshot, audit: a row a request with its outcome.
    """
    known = F.col("to_status").isin("open", "assigned", "resolved", "dismissed")
    joined = requests.join(queue.select(*KEY, F.col("status").alias("from_status")), KEY, "left")
    outcome = F.when(F.col("from_status").isNull(), "no_such_item").when(~known, "unknown_status").when((F.col("to_status") == "assigned") & F.coalesce(F.trim("assignee") == "", F.lit(True)), "assignee_required").otherwise("applied")
    audit = joined.withColumn("outcome", outcome).withColumn("at", now)
    good = audit.where("outcome = 'applied'").groupBy(*KEY).agg(F.max(F.struct("request_no", "to_status", "assignee")).alias("r"))
    after = queue.join(good, KEY, "left")
    moved = F.col("r").isNotNull()
    new_queue = after.withColumn("status", F.when(moved, F.col("r.to_status")).otherwise(F.col("status"))).withColumn("assignee", F.when(moved, F.when(F.col("r.to_status") == "open", F.lit(None).cast("string")).otherwise(F.coalesce("r.assignee", "assignee"))).otherwise(F.col("assignee"))).withColumn("updated_at", F.when(moved, now).otherwise(F.col("updated_at"))).drop("r")
    return {"queue": new_queue.select(queue.columns), "audit": audit}


def enqueue_once(items: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose keys are not there yet, one for each key."""
    return items.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def queue_page(queue: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the queue, most urgent first; the limit is the feature."""
    return queue.orderBy(F.desc("priority"), F.desc("updated_at"), *KEY).offset(offset).limit(limit)


def status_counts(queue: DataFrame, statuses: tuple[str, ...] = ("open", "assigned", "resolved", "dismissed")) -> DataFrame:
    every = queue.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(queue.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("items"))
