"""Column expressions: months, curves, bands, intervals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.config import QUEUE_BASE, CoverageCurve


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_floor(c: Column | str) -> Column:
    return F.trunc(col(c), "month")


def ordinal(c: Column | str) -> Column:
    """Months since year 0, first of month."""
    return (F.year(col(c)) * 12 + F.month(col(c)) - 1).cast("int")


def from_ordinal(c: Column | str) -> Column:
    n = col(c).cast("int")
    return F.make_date(F.floor(n / 12).cast("int"), F.pmod(n, F.lit(12)) + 1, F.lit(1))


def month_diff(later: Column | str, earlier: Column | str) -> Column:
    return ordinal(later) - ordinal(earlier)


def age_months(month: Column | str, as_of: Column | str) -> Column:
    return F.greatest(F.lit(0), month_diff(as_of, month))


def clamp(c: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(c, lo), hi)


def segment_centre(start: Column | str, end: Column | str) -> Column:
    return from_ordinal(ordinal(start) + F.floor(month_diff(end, start) / 2).cast("int"))


def coverage_at(age: Column | str, curve: CoverageCurve = CoverageCurve()) -> Column:
    """Piecewise linear: recent at age 0, plateau from plateau_start to plateau_end, old from old_age on."""
    a = F.greatest(F.lit(0), col(age).cast("int"))
    a1 = max(1, curve.plateau_start)
    a2 = max(a1 + 1, curve.plateau_end)
    a3 = max(a2 + 1, curve.old_age)
    lit = F.lit
    value = (
        F.when(a <= 0, lit(curve.recent))
        .when(a < a1, lit(curve.recent) + lit(curve.plateau - curve.recent) * (a / lit(a1)))
        .when(a <= a2, lit(curve.plateau))
        .when(a < a3, lit(curve.plateau) + lit(curve.old - curve.plateau) * ((a - lit(a2)) / lit(a3 - a2)))
        .otherwise(lit(curve.old))
    )
    return F.greatest(lit(curve.floor), F.least(lit(1.0), value))


def coverage_correction(age: Column | str, curve: CoverageCurve = CoverageCurve()) -> Column:
    return F.lit(1.0) / coverage_at(age, curve)


def half_life(distance: Column | str, months: float | None) -> Column:
    return F.lit(1.0) if not months or months <= 0 else F.pow(F.lit(0.5), col(distance) / F.lit(float(months)))


def width_band(point: Column | str, span: Column | str) -> Column:
    rel = col(span) / F.greatest(F.lit(1.0), col(point))
    return F.when(col(point) <= 0, "manual_review_required").when(rel < 0.15, "high").when(rel < 0.35, "medium").when(rel < 0.75, "low").otherwise("manual_review_required")


def distance_band(distance: Column | str) -> Column:
    return F.when(col(distance) <= 1, "medium").when(col(distance) <= 6, "low").otherwise("manual_review_required")


def score_band(score: Column | str, bands: tuple[float, float, float] = (0.80, 0.55, 0.30)) -> Column:
    high, medium, low = bands
    return F.when(col(score) >= high, "high").when(col(score) >= medium, "medium").when(col(score) >= low, "low").otherwise("manual_review_required")


def lookup(values: Mapping[str, object], key: Column | str, otherwise: object) -> Column:
    """A small literal map."""
    out = F.lit(otherwise)
    for k, v in reversed(list(values.items())):
        out = F.when(col(key) == k, F.lit(v)).otherwise(out)
    return out


def intervals_overlap(a_min: Column | str, a_max: Column | str, b_min: Column | str, b_max: Column | str) -> Column:
    """False where an end is missing."""
    a0, a1, b0, b1 = map(col, (a_min, a_max, b_min, b_max))
    return F.coalesce(~((a1 < b0) | (b1 < a0)), F.lit(False))


def queue_priority(reason: Column | str, severity: Column | str, confidence: Column | str) -> Column:
    """Base of the reason, up to 15 for severity and up to 15 for missing confidence (half-even), within 0 and 99."""
    one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    base = lookup(QUEUE_BASE, reason, 30)
    extra = F.when(col(confidence).isNotNull(), F.bround(one(F.lit(1.0) - col(confidence)) * 15)).otherwise(0.0)
    return F.least(F.greatest(base + F.bround(one(col(severity)) * 15).cast("int") + extra.cast("int"), F.lit(0)), F.lit(99))


def usable_endpoint(method: Column | str, point: Column | str) -> Column:
    """Whether a month may start or end a growth window."""
    return ~col(method).isin("suppressed_low_sample", "degraded_current_only") & (col(point) > 0)


def declined(method: Column | str, band: Column | str, current: Column | bool) -> Column:
    """Whether the estimator declined a month, for a current or a historical question."""
    now = current if isinstance(current, Column) else F.lit(current)
    return F.when(col(method) == "suppressed_low_sample", True).when(col(method) == "degraded_current_only", ~now).otherwise(col(band) == "manual_review_required")


def natural_id(*parts: Column | str) -> Column:
    """Deterministic id of a natural key (nulls are spelled out, so they do not shift fields)."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(col(p).cast("string"), F.lit("\u0002")) for p in parts)), 256)
