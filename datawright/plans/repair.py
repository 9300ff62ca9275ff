"""Repairs: treatments as DataFrame transforms, applied in order of scope, audited, and reversible by version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import MIXED, date_readings, mixed, number, text, unconfused
from ..sources.frames import ROW, Versions, checkpoint_dir
from .detectors import DateIntegrity, _string, dominant_layout
from .model import Issue, Treatment

SCOPES = ("representation", "text", "value", "structural", "no_op")
# Which detectors a scope's changes make stale.
INVALIDATES = {
    "representation": {"mixed_physical_type", "range_violation", "sentinel_candidate", "formula_invariant", "date_integrity", "state_consistency", "accounting_plausibility", "missingness"},
    "text": {"category_variant", "unicode_confusable", "geographic_consistency", "currency_context", "duplicate_identifier", "state_consistency"},
    "value": {"range_violation", "sentinel_candidate", "formula_invariant", "accounting_plausibility", "missingness", "state_consistency"},
    "structural": {"*"},
    "no_op": set(),
}


@dataclass(frozen=True)
class Operation:
    name: str
    issue: str
    column: str
    scope: str
    apply: Callable[[DataFrame], DataFrame] = field(repr=False)
    parameters: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class AuditRecord:
    issue: str
    column: str
    operation: str
    applied: bool
    source: str
    reason: str = ""
    cells_changed: int = 0
    version: int | None = None


@dataclass
class AuditLog:
    records: list[AuditRecord] = field(default_factory=list)

    def append(self, record: AuditRecord) -> None:
        self.records.append(record)

    @property
    def applied(self) -> list[AuditRecord]:
        return [r for r in self.records if r.applied]

    @property
    def refused(self) -> list[AuditRecord]:
        return [r for r in self.records if not r.applied]

    def for_issue(self, issue: str) -> list[AuditRecord]:
        return [r for r in self.records if r.issue == issue]

    def for_column(self, column: str) -> list[AuditRecord]:
        return [r for r in self.records if r.column == column]

    @property
    def cells_changed(self) -> int:
        return sum(r.cells_changed for r in self.records)


ACTIONS: dict[str, Callable[[Issue, Treatment, str], Operation]] = {}


def action(name: str, scope: str) -> Callable:
    """Registers how a treatment changes one column: a function (df, column, parameters) -> DataFrame."""

    def keep(transform: Callable[[DataFrame, str, dict[str, Any]], DataFrame]) -> Callable:
        ACTIONS[name] = lambda issue, t, column: Operation(name, issue.id, column, scope, lambda d: transform(d, column, dict(t.parameters)), dict(t.parameters))
        return transform

    return keep


def _put_string(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Replaces the text of text cells."""
    if df.schema[column].dataType != MIXED:
        return df.withColumn(column, value)
    s = _string(df, column)
    return df.withColumn(column, F.when(s.isNotNull(), mixed(F.col(column)["form"], value)).otherwise(F.col(column)))


@action("parse_numeric", "representation")
def parse_numeric(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    """Every number as double; refused if a present cell is none."""
    x = number(df, column)
    if not df.filter(x.isNull() & text(df, column).isNotNull()).isEmpty():
        raise ValueError(f"{column} has cells that are no numbers")
    return df.withColumn(column, x)


def _parsed(df: DataFrame, column: str, layout: str | None, states: tuple[str, ...]) -> DataFrame:
    s = _string(df, column)
    layout = layout or dominant_layout(df, column)
    fine = F.coalesce(DateIntegrity.status(df, column, layout).isin(*states), F.lit(False))
    day = date_readings(s)[0]["value"].cast("timestamp")
    kept = mixed(F.lit("datetime"), t=day)
    other = F.col(column) if df.schema[column].dataType == MIXED else mixed(F.when(s.isNotNull(), "string"), s)
    return df.withColumn(column, F.when(fine, kept).otherwise(other))


@action("parse_datetime_unambiguous", "representation")
def parse_datetime_unambiguous(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    """Texts with one reading become times; the others stay."""
    return _parsed(df, column, p.get("layout"), ("ok", "format_conflict"))


@action("accept_unambiguous_parse", "representation")
def accept_unambiguous_parse(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    return _parsed(df, column, p.get("layout"), ("format_conflict",))


@action("canonicalise_mechanical", "text")
def canonicalise_mechanical(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    """At most ``MAX_LEVELS`` texts are replaced, so the mapping is a literal."""
    s, m = _string(df, column), p["mapping"]
    return _put_string(df, column, F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[s], s))


@action("merge_semantic_variants", "text")
def merge_semantic_variants(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    return canonicalise_mechanical(df, column, p)


@action("fold_confusables", "text")
def fold_confusables(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    return _put_string(df, column, unconfused(_string(df, column)))


@action("leave_unchanged", "no_op")
def leave_unchanged(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    return df


@action("record_only", "no_op")
def record_only(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    return df


@action("treat_as_missing", "value")
def treat_as_missing(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    codes = [float(c) for c in p["codes"]]
    return df.withColumn(column, F.when(number(df, column).isin(*codes), None).otherwise(F.col(column)))


@action("keep_first", "structural")
def keep_first(df: DataFrame, column: str, p: dict[str, Any]) -> DataFrame:
    """Of rows that agree in all columns, the first stays."""
    names = [c for c in df.columns if c != ROW]
    whole = F.xxhash64(*[F.coalesce(text(df, c), F.lit("\0")) for c in names])
    firsts = df.groupBy(F.col(column).alias("__k"), whole.alias("__w")).agg(F.min(ROW).alias("__first"))
    return df.join(firsts, F.col(ROW) == F.col("__first"), "left_semi")


def build(issue: Issue, treatment: Treatment) -> Operation | None:
    made = ACTIONS.get(treatment.name)
    return made(issue, treatment, issue.columns[0]) if made else None


@dataclass
class RepairPlan:
    operations: list[Operation] = field(default_factory=list)

    def ordered(self) -> list[Operation]:
        return sorted(self.operations, key=lambda o: (SCOPES.index(o.scope), o.name))

    def invalidated(self) -> set[str]:
        """Detectors whose findings may change."""
        return set().union(*(INVALIDATES[o.scope] for o in self.operations)) if self.operations else set()


def cells_changed(before: DataFrame, after: DataFrame, column: str, key: str = ROW) -> int:
    """Cells of a column that differ as texts; missing equals missing. One column each travels."""
    a, b = before.select(F.col(key).alias("k"), text(before, column).alias("x")), after.select(F.col(key).alias("k"), text(after, column).alias("y"))
    return a.join(b, "k").filter(~F.col("x").eqNullSafe(F.col("y"))).count()


@dataclass
class Executed:
    data: DataFrame
    versions: Versions
    audit: AuditLog


def run(df: DataFrame, plan: RepairPlan, audit: AuditLog | None = None, source: str = "auto") -> Executed:
    """Applies operations in order. One that fails leaves the version before it in place and is recorded as refused.

    Each changed version is checkpointed: an error shows at once, and plans do not grow with the number of repairs.
    """
    checkpoint_dir(df.sparkSession)
    audit, versions = audit or AuditLog(), Versions()
    versions.add(df, "raw")
    for o in plan.ordered():
        try:
            after = o.apply(df) if o.scope == "no_op" else o.apply(df).checkpoint()
            changed = 0 if o.scope == "no_op" else cells_changed(df, after, o.column) if o.scope != "structural" else df.count() - after.count()
        except Exception as e:
            audit.append(AuditRecord(o.issue, o.column, o.name, False, source, f"rolled back: {str(e)[:200]}"))
            continue
        df = after
        audit.append(AuditRecord(o.issue, o.column, o.name, True, source, "", changed, versions.add(df, o.name)))
    return Executed(df, versions, audit)


@dataclass(frozen=True)
class Preview:
    treatment: str
    rows_changed: int
    deltas: dict[str, tuple[float | None, float | None]]
    examples: list[tuple[int, str | None, str | None]]


def preview(df: DataFrame, issue: Issue, treatment: Treatment | str, examples: int = 5) -> Preview:
    """What one candidate would do: before/after of the column's figures, and the first changed cells. Nothing is kept."""
    t = treatment if isinstance(treatment, Treatment) else next(x for x in issue.treatments if x.name == treatment)
    if t.name == "treat_as_missing" and "codes" not in t.parameters:
        t = Treatment(t.name, t.confidence, parameters={"codes": list(issue.details["codes"])})
    o = build(issue, t)
    if o is None:
        raise ValueError(f"{t.name!r} has no action")
    after, c = o.apply(df), o.column

    def figures(d: DataFrame) -> dict[str, float | None]:
        x = number(d, c)
        return d.agg(F.count_if(text(d, c).isNull()).alias("missing"), F.count(text(d, c)).alias("present"), F.countDistinct(text(d, c)).alias("distinct"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).first().asDict()

    a, b = figures(df), figures(after)
    pairs = df.select(F.col(ROW), text(df, c).alias("x")).join(after.select(F.col(ROW), text(after, c).alias("y")), ROW).filter(~F.col("x").eqNullSafe(F.col("y")))
    first = [(r[0], r["x"], r["y"]) for r in pairs.orderBy(ROW).limit(examples).collect()]
    return Preview(t.name, pairs.count(), {k: (a[k], b[k]) for k in a}, first)


def preview_candidates(df: DataFrame, issue: Issue) -> list[Preview]:
    return [preview(df, issue, t) for t in sorted(issue.treatments, key=lambda t: -t.confidence) if t.name in ACTIONS]
