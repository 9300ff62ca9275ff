"""Findings and the safety policy: who may act on what."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum, IntEnum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.frames import ROW


class Severity(IntEnum):
    INFO = 0
    NOTICE = 1
    WARNING = 2
    HIGH_WARNING = 3
    CRITICAL_REVIEW = 4
    BLOCKING = 5


class RepairClass(IntEnum):
    """Who decides, by growing autonomy."""

    DO_NOT_TOUCH = 0
    AMBIGUOUS = 1
    DOMAIN_RULE_REQUIRED = 2
    USER_CONFIRMATION_REQUIRED = 3
    REVIEW_RECOMMENDED = 4
    AUTO_FIX_WITH_LOG = 5
    SAFE_AUTO_FIX = 6

    @property
    def is_autonomous(self) -> bool:
        return self >= RepairClass.AUTO_FIX_WITH_LOG


class Completion(str, Enum):
    CLEAN = "CLEAN"
    CLEAN_WITH_NOTES = "CLEAN_WITH_NOTES"
    CLEAN_WITH_WARNINGS = "CLEAN_WITH_WARNINGS"
    PARTIALLY_RESOLVED = "PARTIALLY_RESOLVED"
    GUIDED_REVIEW_RECOMMENDED = "GUIDED_REVIEW_RECOMMENDED"
    GUIDED_REVIEW_REQUIRED = "GUIDED_REVIEW_REQUIRED"
    DOMAIN_REVIEW_REQUIRED = "DOMAIN_REVIEW_REQUIRED"
    BLOCKED = "BLOCKED"


# What a finding can be about, and which health dimension it counts against.
DIMENSIONS = {
    "completeness": ("missingness", "suspicious_missingness"),
    "validity": ("invalid_date", "range_violation", "sentinel_candidate", "mixed_physical_type"),
    "consistency": ("state_contradiction", "formula_violation", "geographic_conflict", "accounting_implausibility", "identifier_metadata_mismatch"),
    "uniqueness": ("exact_duplicate", "conflicting_duplicate"),
    "semantic_quality": ("category_variant", "unicode_confusable", "ambiguous_date", "currency_context", "unknown_entity"),
}
CATEGORIES = (*(c for cs in DIMENSIONS.values() for c in cs), "structural_missingness", "unusual_pattern")
SEVERITY_WEIGHT = {Severity.INFO: 0.0, Severity.NOTICE: 2.0, Severity.WARNING: 6.0, Severity.HIGH_WARNING: 12.0, Severity.CRITICAL_REVIEW: 20.0, Severity.BLOCKING: 30.0}
#: Two best treatments closer than this disagree.
CONFLICT = 0.10


@dataclass(frozen=True)
class Ladder:
    """Least repair confidence of each autonomous or reviewed band, strictly descending."""

    safe: float = 0.98
    logged: float = 0.90
    review: float = 0.75
    confirm: float = 0.60

    def __post_init__(self) -> None:
        if not self.safe > self.logged > self.review > self.confirm:
            raise ValueError("the ladder's thresholds must descend strictly")


@dataclass(frozen=True)
class Risk:
    severity: Severity = Severity.NOTICE
    irreversible: bool = False
    loss_high: bool = False
    domain_rule: bool = False
    material: bool = False
    has_treatment: bool = True
    conflict: bool = False


def band(confidence: float, ladder: Ladder = Ladder()) -> RepairClass:  # noqa: B008
    if not 0 <= confidence <= 1:
        raise ValueError(f"confidence {confidence} is not in [0, 1]")
    steps = ((ladder.safe, RepairClass.SAFE_AUTO_FIX), (ladder.logged, RepairClass.AUTO_FIX_WITH_LOG), (ladder.review, RepairClass.REVIEW_RECOMMENDED), (ladder.confirm, RepairClass.USER_CONFIRMATION_REQUIRED))
    return next((c for least, c in steps if confidence >= least), RepairClass.AMBIGUOUS)


def classify(confidence: float, risk: Risk, ladder: Ladder = Ladder()) -> tuple[RepairClass, list[str]]:  # noqa: B008
    """(class, reasons). Routing comes first: blocking, no treatment, domain rule. Then the ladder, which risks can only lower."""
    if risk.severity is Severity.BLOCKING:
        return RepairClass.DO_NOT_TOUCH, ["blocking: a repair could destroy valid data"]
    if not risk.has_treatment:
        return RepairClass.AMBIGUOUS, ["no treatment follows from the data"]
    if risk.domain_rule:
        return RepairClass.DOMAIN_RULE_REQUIRED, ["a business rule outside the data decides"]
    found = band(confidence, ladder)
    reasons = [] if found.is_autonomous else [f"repair confidence {confidence:.0%} is below {ladder.logged:.0%}"]
    ceilings = (
        (risk.irreversible, RepairClass.USER_CONFIRMATION_REQUIRED, "it cannot be undone"),
        (risk.loss_high, RepairClass.USER_CONFIRMATION_REQUIRED, "it may lose information"),
        (risk.conflict, RepairClass.USER_CONFIRMATION_REQUIRED, "the treatments disagree"),
        (risk.material, RepairClass.REVIEW_RECOMMENDED, "it changes the distribution materially"),
    )
    for applies, ceiling, why in ceilings:
        if applies and found > ceiling:
            found = ceiling
            reasons.append(why)
    return found, reasons


@dataclass(frozen=True)
class Treatment:
    name: str
    confidence: float
    irreversible: bool = False
    loss_high: bool = False
    domain_rule: bool = False
    material: bool = False
    parameters: dict[str, Any] = field(default_factory=dict)


@dataclass
class Issue:
    """One finding. ``rows`` gives the predicate of the affected rows, or their ids, when asked."""

    id: str
    category: str
    severity: Severity
    columns: tuple[str, ...]
    detection: float
    affected: int
    treatments: tuple[Treatment, ...] = ()
    recommended: str | None = None
    details: dict[str, Any] = field(default_factory=dict)
    rows: Callable[[DataFrame], Column | DataFrame] | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.detection <= 1 or any(not 0 <= t.confidence <= 1 for t in self.treatments):
            raise ValueError("confidences lie in [0, 1]")
        if self.recommended and self.recommended not in {t.name for t in self.treatments}:
            raise ValueError(f"{self.recommended!r} is no candidate of {self.id}")
        if self.category not in CATEGORIES:
            raise ValueError(f"unknown category {self.category!r}")

    @property
    def treatment(self) -> Treatment | None:
        return next((t for t in self.treatments if t.name == self.recommended), self.treatments[0] if self.treatments else None)

    @property
    def risk(self) -> Risk:
        best = sorted((t.confidence for t in self.treatments), reverse=True)
        t = self.treatment
        conflict = len(best) > 1 and best[0] - best[1] < CONFLICT
        return Risk(self.severity, bool(t and t.irreversible), bool(t and t.loss_high), bool(t and t.domain_rule), bool(t and t.material), t is not None, conflict)

    def decide(self, ladder: Ladder = Ladder()) -> tuple[RepairClass, list[str]]:  # noqa: B008
        return classify(self.treatment.confidence if self.treatment else 0.0, self.risk, ladder)

    @property
    def repair_class(self) -> RepairClass:
        return self.decide()[0]

    def row_ids(self, df: DataFrame, key: str = ROW) -> DataFrame:
        """(finding_id, row_id) of the affected rows."""
        if self.rows is None:
            return df.select(F.lit(self.id).alias("finding_id"), F.col(key).alias("row_id")).limit(0)
        found = self.rows(df)
        picked = df.filter(F.coalesce(found, F.lit(False))) if isinstance(found, Column) else df.join(found, key, "left_semi")
        return picked.select(F.lit(self.id).alias("finding_id"), F.col(key).alias("row_id"))

    def to_dict(self) -> dict[str, Any]:
        found, reasons = self.decide()
        return {"id": self.id, "category": self.category, "severity": self.severity.name, "columns": list(self.columns), "detection_confidence": self.detection, "affected_rows": self.affected, "repair_class": found.name, "reasons": reasons, "treatments": [t.name for t in self.treatments], "recommended": self.treatment.name if self.treatment else None, "details": self.details}


@dataclass(frozen=True)
class Health:
    dimensions: dict[str, float]

    @property
    def overall(self) -> float:
        return sum(self.dimensions.values()) / len(self.dimensions) if self.dimensions else 100.0

    def delta(self, other: Health) -> dict[str, float]:
        return {k: round(v - other.dimensions[k], 1) for k, v in self.dimensions.items() if k in other.dimensions}


def health(issues: list[Issue], rows: int) -> Health:
    """Score of each dimension: 100 less the capped cost of its findings, which grows with the share of rows that they touch."""
    scores = {}
    for name, categories in DIMENSIONS.items():
        cost = sum(SEVERITY_WEIGHT[i.severity] * (0.35 + 0.65 * (min(1.0, i.affected / rows) if rows else 0.0)) for i in issues if i.category in categories)
        scores[name] = 100.0 - min(cost, 100.0)
    return Health(scores)
