"""Analyst overrides: pins, suppress windows, synthetic events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.config import EVENT_TYPES
from rosterlake.functions.expressions import natural_id

# The fields that an override may set.
FIELDS = ("canonical_company", "current_anchor", "event_segment", "estimate_suppress_window", "company_relation", "person_identity_merge")
PIN = "anchor_month date, value_min double, value_point double, value_max double, confidence double"
SPAN = "start_month date, end_month date"
EVENT = "event_month date, event_type string"


def active(overrides: DataFrame, now: Column) -> DataFrame:
    """Overrides without an end, or with one after `now`."""
    return overrides.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def _field(overrides: DataFrame, name: str, schema: str, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = overrides.where(F.col("field_name") == name).withColumn("p", F.from_json("payload", schema))
    missing = [F.when(F.col(f"p.{c}").isNull(), F.lit(c)) for c in needed]
    rows = rows.withColumn("missing", F.array_compact(F.array(*missing)))
    bad = rows.where(F.size("missing") > 0).select("override_id", F.concat(F.lit("missing:"), F.array_join("missing", ",")).alias("reject_reason"))
    return rows.where(F.size("missing") == 0), bad


def decode(overrides: DataFrame, now: Column) -> dict[str, DataFrame]:
    """pins, windows, events and rejected (override_id, reject_reason) of the active overrides.

    overrides: override_id, company_id, field_name, payload (JSON), reason,
    expires_at, created_at.  An unknown event type counts as an acquisition.
    """
    live = active(overrides, now)
    pins, bad_pins = _field(live, "current_anchor", PIN, ["anchor_month", "value_min", "value_point", "value_max"])
    spans, bad_spans = _field(live, "estimate_suppress_window", SPAN, ["start_month", "end_month"])
    events, bad_events = _field(live, "event_segment", EVENT, ["event_month"])
    kind = F.coalesce("p.event_type", F.lit("acquisition"))
    return {
        "pins": pins.select("company_id", F.col("override_id").alias("anchor_id"), "p.anchor_month", "p.value_min", "p.value_point", "p.value_max", F.lit("exact").alias("kind"), F.lit("manual_anchor").alias("anchor_type"), F.coalesce("p.confidence", F.lit(1.0)).alias("confidence"), F.lit("manual_override").alias("source_name")),
        "windows": spans.select("company_id", "p.start_month", "p.end_month", F.coalesce("reason", F.lit("manual_suppress")).alias("reason"), F.struct("created_at", "override_id").alias("load_order")),
        "events": events.select("company_id", "p.event_month", F.when(kind.isin(*EVENT_TYPES), kind).otherwise("acquisition").alias("event_type"), F.lit("manual").alias("source_class"), F.lit(1.0).alias("confidence"), F.concat(F.lit("synthetic: "), F.coalesce("reason", F.lit("manual_event_segment"))).alias("description")),
        "rejected": bad_pins.unionByName(bad_spans).unionByName(bad_events),
    }


def create(requests: DataFrame, companies: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Requests for overrides -> overrides to append, an audit row for each, and the outcome of every request.

    requests: request_no (unique), company_id, field_name, payload (JSON),
    reason, entered_by, expires_at.  Outcomes: created, unknown_field,
    company_not_found.  An override's id follows from its request, so a repeated
    run gives the same rows.
    """
    known = companies.select("company_id").distinct().withColumn("_known", F.lit(True))
    bad_field = ~F.coalesce(F.col("field_name").isin(*FIELDS), F.lit(False))
    outcome = F.when(bad_field, "unknown_field").when(F.col("_known").isNull(), "company_not_found").otherwise("created")
    judged = requests.join(known, "company_id", "left").withColumn("outcome", outcome)
    made = judged.where("outcome = 'created'").withColumn("override_id", natural_id("company_id", "field_name", "request_no"))
    said = F.struct("company_id", F.col("field_name").alias("field"), "reason", "expires_at", "payload")
    audit = made.select(
        F.lit("api").alias("actor_type"), F.col("entered_by").alias("actor_id"), F.lit("override_created").alias("action"), F.lit("manual_override").alias("target_type"),
        F.col("override_id").alias("target_id"), F.to_json(said).alias("payload"), now.alias("at"),
    )
    return {
        "overrides": made.select("override_id", "company_id", "field_name", "payload", "reason", "entered_by", "expires_at", now.alias("created_at")),
        "audit": audit,
        "outcomes": judged.select("request_no", "company_id", "outcome"),
    }


def with_pins(anchors: DataFrame, pins: DataFrame) -> DataFrame:
    """Anchors with the pins appended (manual anchors win by precedence; the others stay visible)."""
    return anchors.unionByName(pins, allowMissingColumns=True)


def with_events(events: DataFrame, synthetic: DataFrame) -> DataFrame:
    return events.unionByName(synthetic, allowMissingColumns=True)
