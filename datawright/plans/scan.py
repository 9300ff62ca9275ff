"""Scans: all applicable detectors, their aggregates in one job."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.frames import ROW, with_row_id
from .detectors import REGISTRY, Context, Progress
from .model import Health, Issue, RepairClass, Severity, health

#: Aggregates of one job; a wider request is split so that generated code stays small.
BATCH = 400


@dataclass(frozen=True)
class Check:
    detector: str
    status: str
    note: str = ""


@dataclass
class ScanResult:
    issues: list[Issue]
    checks: list[Check]
    rows: int
    data: DataFrame = field(repr=False)
    context: Context = field(repr=False, default_factory=Context)

    @property
    def coverage(self) -> float:
        """Share of the applicable checks that ran to their end; says nothing about the data's health."""
        done, failed = (sum(c.status == s for c in self.checks) for s in ("completed", "failed"))
        return done / (done + failed) if done + failed else 1.0

    @property
    def health(self) -> Health:
        return health(self.issues, self.rows)

    def find(self, category: str | None = None, column: str | None = None, min_severity: Severity | None = None, repair_class: RepairClass | None = None) -> list[Issue]:
        return [
            i
            for i in self.issues
            if (category is None or i.category == category) and (column is None or column in i.columns) and (min_severity is None or i.severity >= min_severity) and (repair_class is None or i.repair_class is repair_class)
        ]

    def _grouped(self, key) -> dict:  # noqa: ANN001
        found: dict[Any, list[Issue]] = {}
        for i in self.issues:
            found.setdefault(key(i), []).append(i)
        return found

    def by_severity(self) -> dict[Severity, list[Issue]]:
        return dict(sorted(self._grouped(lambda i: i.severity).items(), reverse=True))

    def by_category(self) -> dict[str, list[Issue]]:
        return self._grouped(lambda i: i.category)

    def by_repair_class(self) -> dict[RepairClass, list[Issue]]:
        return self._grouped(lambda i: i.repair_class)

    def finding_rows(self) -> DataFrame:
        """(finding_id, row_id) of all findings; stays distributed."""
        found = [i.row_ids(self.data) for i in self.issues if i.rows is not None]
        empty = self.data.select(F.lit("").alias("finding_id"), F.col(ROW).alias("row_id")).limit(0)
        for f in found:
            empty = empty.unionByName(f)
        return empty

    def to_dict(self) -> dict[str, Any]:
        return {"schema_version": 1, "rows": self.rows, "coverage": self.coverage, "health": {"overall": round(self.health.overall, 1), **self.health.dimensions}, "issues": [i.to_dict() for i in self.issues], "checks": [vars(c) for c in self.checks]}


def applicable(name: str, df: DataFrame, context: Context) -> str | None:
    """Why a detector does not apply, by the schema alone; None if it does."""
    missing = [c for c in REGISTRY[name].needs(context) if c not in df.columns]
    return f"needs {', '.join(c or 'a column that was not named' for c in missing)}" if missing else None


def scan(df: DataFrame, *, strict: bool = False, progress: Progress | None = None, only: list[str] | None = None, **context: Any) -> ScanResult:
    """Runs every applicable detector; a failing one is recorded, or raises if ``strict``. The table gets row numbers if it has none."""
    ctx, df = Context(**context), with_row_id(df)
    names = [n for n in REGISTRY if only is None or n in only]
    checks, wanted = [], {}
    for n in names:
        if why := applicable(n, df, ctx):
            checks.append(Check(n, "not_applicable", why))
            continue
        try:
            wanted[n] = REGISTRY[n].requests(df, ctx)
        except Exception as e:
            if strict:
                raise
            checks.append(Check(n, "failed", str(e)[:300]))
    flat = [("", "rows", F.count(F.lit(1))), *((n, k, e) for n, es in wanted.items() for k, e in es.items())]
    values: dict[str, dict[str, Any]] = {n: {} for n in ("", *wanted)}
    for a in range(0, len(flat), BATCH):
        part = flat[a : a + BATCH]
        row = df.agg(*[e.alias(f"a{k}") for k, (_, _, e) in enumerate(part)]).first()
        for k, (n, key, _) in enumerate(part):
            values[n][key] = row[k]
    issues: list[Issue] = []
    for k, n in enumerate(wanted):
        if progress:
            progress(n, k + 1, len(wanted))
        try:
            issues += REGISTRY[n].findings(df, ctx, values[n])
            checks.append(Check(n, "completed"))
        except Exception as e:
            if strict:
                raise
            checks.append(Check(n, "failed", str(e)[:300]))
    return ScanResult(issues, checks, values[""]["rows"], df, ctx)
