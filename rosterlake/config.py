"""Parameters and fixed values of the estimation operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Vocabularies and policy numbers that results depend on.
BREAK_EVENTS = ("acquisition", "merger", "spinout", "layoff", "parent_sub_reassignment")
EVENT_TYPES = (*BREAK_EVENTS, "rebrand")
ANCHOR_PRECEDENCE = {"manual_anchor": 5, "historical_statement": 3, "current_headcount_anchor": 2, "reconciled_anchor": 1}
ANCHOR_QUALITY = {"manual_anchor": 1.0, "historical_statement": 0.75, "current_headcount_anchor": 0.5, "reconciled_anchor": 0.5}
EVENT_PRECEDENCE = {"manual": 5, "first_party": 4, "press": 3, "benchmark": 2, "manual_hint": 1}
METRIC_OFFSET = {"headcount_current": 0, "headcount_6m_ago": -6, "headcount_1y_ago": -12, "headcount_2y_ago": -24}
GROWTH_METRIC = {"growth_6m_pct": "6m", "growth_1y_pct": "1y", "growth_2y_pct": "2y"}
HORIZON_LABEL = {3: "3m", 6: "6m", 12: "1y", 24: "2y"}
BANDS = ("high", "medium", "low", "manual_review_required")
QUEUE_BASE = {"benchmark_disagreement": 70, "anchor_disagreement": 65, "anomaly": 55, "low_confidence": 50, "degraded_run": 45, "linkedin_gated": 40, "resolution_ambiguity": 35, "manual": 30}
PROVIDER_FLOOR = {"primary": 0.70, "secondary": 0.55, "tertiary": 0.45}
PROVIDER_FLOOR_ELSE = 0.50
SCORE_WEIGHTS = {"anchor_source_quality": 0.25, "anchor_recency": 0.20, "anchor_agreement": 0.20, "sample_coverage": 0.15, "event_proximity": 0.10, "multi_source_corroboration": 0.10}
HINT_EVENT = {"acquisition": "acquisition", "rebrand": "rebrand", "merger": "merger"}

SCALED, SUPPRESSED, DEGRADED, INTERPOLATED = "scaled_ratio_coverage_corrected", "suppressed_low_sample", "degraded_current_only", "interpolated_multi_anchor"


@dataclass(frozen=True)
class CoverageCurve:
    """Share of a workforce with a public profile, by age of the month."""

    recent: float = 0.55
    plateau_start: int = 6
    plateau: float = 0.85
    plateau_end: int = 36
    old_age: int = 96
    old: float = 0.35
    floor: float = 0.15


@dataclass(frozen=True)
class Window:
    """Months of a series (first of month, ISO), and the month it is seen from."""

    start: str
    end: str
    as_of: str


@dataclass(frozen=True)
class EstimateConfig:
    coverage: CoverageCurve = field(default_factory=CoverageCurve)
    sample_floor: int = 5
    decay_half_life: float | None = None
    max_width: float = 0.75
    max_jump: float = 0.30
    recency_half_life: float = 18.0
    event_half_life: float = 6.0
    bands: tuple[float, float, float] = (0.80, 0.55, 0.30)


@dataclass(frozen=True)
class EvaluationConfig:
    top: int = 25
    strong_ratio: float = 1.0
    material_ratio: float = 0.1
    gap: float = 0.25
    credit_overlap: bool = True
    primary_provider: str = "primary"
    fallback_provider: str = "secondary"
