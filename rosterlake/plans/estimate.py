"""The whole estimate for all companies: one plan from evidence to scored series."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.config import EstimateConfig, Window
from rosterlake.operators import confidence as C
from rosterlake.operators import overrides as O
from rosterlake.operators import series as S
from rosterlake.sources.tables import checkpointed, shuffled


class Estimate:
    """Every step over all companies at once, planned when it is first asked for; bad override rows end in `rejected`.

    Several steps read segments, counts and placed; as tables these are computed
    once and survive lost executors, and what no result needs is never computed.
    They compress well, so joins never broadcast them by the size of their files.
    """

    def __init__(self, companies: DataFrame, employment: DataFrame, anchors: DataFrame, events: DataFrame, overrides: DataFrame, window: Window, now: Column, config: EstimateConfig) -> None:
        self.companies, self.employment, self.anchors, self.events = companies, employment, anchors, events
        self.overrides, self.window, self.now, self.config = overrides, window, now, config

    @cached_property
    def decoded(self) -> dict[str, DataFrame]:
        return O.decode(self.overrides, self.now)

    @cached_property
    def segments(self) -> DataFrame:
        return shuffled(checkpointed(S.segments(O.with_events(self.events, self.decoded["events"]), self.companies, self.window)))

    @cached_property
    def counts(self) -> DataFrame:
        return shuffled(checkpointed(S.profile_counts(self.employment, self.companies, self.window)))

    @cached_property
    def placed(self) -> DataFrame:
        return shuffled(checkpointed(S.anchors_in_segments(O.with_pins(self.anchors, self.decoded["pins"]), self.segments)))

    @cached_property
    def reconciled(self) -> DataFrame:
        return S.reconcile_anchors(self.placed, self.config.decay_half_life)

    @cached_property
    def raw(self) -> DataFrame:
        return S.monthly_series(self.segments, self.counts, self.placed, self.reconciled, self.window, self.config)

    @cached_property
    def series(self) -> DataFrame:
        return S.suppress(self.raw, self.decoded["windows"])

    @cached_property
    def scored(self) -> DataFrame:
        breaks = C.break_months(self.segments)
        return C.confidence(C.anomalies(self.series, breaks, self.config), self.placed, breaks, self.window, self.config)

    @property
    def rejected(self) -> DataFrame:
        return self.decoded["rejected"]

    @property
    def stored(self) -> DataFrame:
        return C.persisted(self.scored)


def estimate(
    companies: DataFrame, employment: DataFrame, anchors: DataFrame, events: DataFrame, overrides: DataFrame, window: Window, now: Column, config: EstimateConfig = EstimateConfig()
) -> Estimate:
    return Estimate(companies, employment, anchors, events, overrides, window, now, config)


def outcome(scored: DataFrame, companies: DataFrame) -> DataFrame:
    """attempted, failed (no months), degraded (months to review) and the status of the run."""
    per = companies.select("company_id").distinct().join(scored.groupBy("company_id").agg(F.count("*").alias("months"), F.max(F.col("needs_review").cast("int")).alias("review")), "company_id", "left")
    totals = per.agg(F.count("*").alias("attempted"), F.count(F.when(F.col("months").isNull(), 1)).alias("failed"), F.count(F.when(F.col("review") == 1, 1)).alias("degraded"))
    status = F.when(F.col("attempted") == 0, "succeeded").when(F.col("failed") == F.col("attempted"), "failed").when((F.col("failed") > 0) | (F.col("degraded") > 0), "partial").otherwise("succeeded")
    return totals.withColumn("status", status)
