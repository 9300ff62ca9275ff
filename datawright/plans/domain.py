"""Findings from standalone diagnoses: anomalies, linkage, mechanism, time series, panel. They repair nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly, linkage
from ..operators.mechanism import Mechanism
from ..operators.panel import PanelReport
from ..operators.timeseries import TimeSeriesReport
from ..sources.frames import ROW
from .model import Issue, Severity, Treatment

REVIEW = (Treatment("review", 0.0, domain_rule=True),)
#: A share of missing periods under an irregular cadence is less certain.
REGULAR = 0.75


def anomaly_issues(df: DataFrame, columns: list[str] | None = None, by: str | None = None, value: str | None = None, threshold: float = anomaly.THRESHOLD, key: str = ROW) -> list[Issue]:
    """Joint outliers of ``columns``, and contextual ones of ``value`` within ``by``; give both of these or neither."""
    if (by is None) != (value is None):
        raise ValueError("give both by and value, or neither")
    found = []
    if columns and len(columns) > 1:
        rows = anomaly.joint(df, columns, key)
        if n := rows.count():
            found.append(Issue(f"ANOMALY-JOINT-{'-'.join(columns)}", "unusual_pattern", Severity.WARNING, tuple(columns), 0.75, n, REVIEW, rows=lambda d: anomaly.joint(d, columns, key).select(key)))
    if by and value:
        rows = anomaly.contextual(df, value, by, key, threshold)
        if n := rows.count():
            found.append(Issue(f"ANOMALY-CONTEXTUAL-{value}-{by}", "unusual_pattern", Severity.WARNING, (value, by), 0.75, n, REVIEW, rows=lambda d: anomaly.contextual(d, value, by, key, threshold).select(key)))
    return found


def link_issues(df: DataFrame, fields: list[str], key: str = ROW, **options) -> list[Issue]:  # noqa: ANN003
    """One finding per candidate pair: merge, keep both, or map one to the other."""
    choices = tuple(Treatment(t, 0.0, domain_rule=True) for t in ("merge", "keep", "map"))
    pairs = linkage.link(df, fields, key=key, **options).collect()
    return [Issue(f"LINK-{p['left']}-{p['right']}", "conflicting_duplicate", Severity.WARNING, tuple(fields), min(1.0, p["score"]), 2, choices, rows=lambda d, p=p: F.col(key).isin(p["left"], p["right"])) for p in pairs]


def mechanism_issues(found: list[Mechanism]) -> list[Issue]:
    made = []
    for m in found:
        if m.verdict == "not_mcar":
            predictors = [t.predictor for t in m.tests if t.is_significant]
            made.append(Issue(f"MECHANISM-NOT-MCAR-{m.column}", "suspicious_missingness", Severity.HIGH_WARNING, (m.column, *predictors), 0.9, m.missing, REVIEW, details={"depends_on": predictors, "monotone_with": m.monotone_with}))
    return made


def timeseries_issues(r: TimeSeriesReport, time: str) -> list[Issue]:
    made = []
    if r.duplicates:
        made.append(Issue(f"TS-DUPLICATE-{time}", "exact_duplicate", Severity.HIGH_WARNING, (time,), 1.0, r.duplicates, REVIEW))
    if r.missing:
        made.append(Issue(f"TS-GAP-{time}", "missingness", Severity.WARNING, (time,), 0.95 if (r.agreement or 0) >= REGULAR else 0.6, r.missing, REVIEW, details={"cadence": r.cadence}))
    if r.out_of_order:
        made.append(Issue(f"TS-ORDER-{time}", "unusual_pattern", Severity.WARNING, (time,), 1.0, r.out_of_order, (Treatment("sort_chronologically", 0.97),)))
    if r.mixed_timezones:
        made.append(Issue(f"TS-TIMEZONE-{time}", "mixed_physical_type", Severity.BLOCKING, (time,), 1.0, r.rows))
    made += [Issue(f"TS-STALE-{c}", "unusual_pattern", Severity.WARNING, (c,), 0.7, n) for c, n in r.stale.items() if n]
    return made


def panel_issues(r: PanelReport, entity: str, time: str) -> list[Issue]:
    made, f = [], r.facts
    if f["duplicates"]:
        made.append(Issue(f"PANEL-DUPLICATE-{entity}", "exact_duplicate", Severity.BLOCKING, (entity, time), 1.0, f["duplicates"], REVIEW))
    if not f["balanced"]:
        made.append(Issue(f"PANEL-UNBALANCED-{entity}", "missingness", Severity.NOTICE, (entity, time), 1.0, 0, REVIEW, details={"completeness": f["completeness"]}))
    for v in r.variations:
        if v.constant_within:
            made.append(Issue(f"PANEL-CONSTANT-WITHIN-{v.column}", "unusual_pattern", Severity.HIGH_WARNING, (v.column,), 1.0, 0))
        elif v.weak_within:
            made.append(Issue(f"PANEL-WEAK-WITHIN-{v.column}", "unusual_pattern", Severity.WARNING, (v.column,), 0.9, 0, details={"within_share": v.within_share}))
    return made
