"""Automatic preparation, guided review and the workflow of stages: three ways into the same plan and executor."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..sources.frames import Versions
from .model import Completion, Issue, RepairClass, Severity
from .repair import AuditLog, AuditRecord, RepairPlan, build, run
from .scan import ScanResult, scan


def completion(remaining: list[Issue], refused_actionable: int) -> Completion:
    """What is left to do, the gravest first."""
    classes = {i.repair_class for i in remaining}
    steps = (
        (RepairClass.DO_NOT_TOUCH, Completion.BLOCKED), (RepairClass.DOMAIN_RULE_REQUIRED, Completion.DOMAIN_REVIEW_REQUIRED), (RepairClass.USER_CONFIRMATION_REQUIRED, Completion.GUIDED_REVIEW_REQUIRED),
        (RepairClass.AMBIGUOUS, Completion.GUIDED_REVIEW_RECOMMENDED), (RepairClass.REVIEW_RECOMMENDED, Completion.GUIDED_REVIEW_RECOMMENDED),
    )
    for c, state in steps:
        if c in classes:
            return state
    if refused_actionable:
        return Completion.PARTIALLY_RESOLVED
    if any(i.severity >= Severity.WARNING for i in remaining):
        return Completion.CLEAN_WITH_WARNINGS
    return Completion.CLEAN_WITH_NOTES if remaining else Completion.CLEAN


class Unfinished(RuntimeError):
    """Findings are open that were neither treated nor waived."""


@dataclass
class PreparationResult:
    before: ScanResult
    after: ScanResult
    audit: AuditLog
    versions: Versions = field(repr=False)
    waived: dict[str, str] = field(default_factory=dict)
    finalized: bool = False

    @property
    def raw_df(self) -> DataFrame:
        return self.versions.restore(0)

    @property
    def clean_df(self) -> DataFrame:
        return self.versions.handles[-1]

    @property
    def verified_df(self) -> DataFrame:
        if not self.finalized:
            raise Unfinished("finalize first")
        return self.clean_df

    @property
    def status(self) -> Completion:
        open_ = [i for i in self.after.issues if i.id not in self.waived]
        return completion(open_, sum("rolled back" in r.reason for r in self.audit.refused))

    def review_queue(self) -> list[Issue]:
        return sorted((i for i in self.after.issues if not i.repair_class.is_autonomous and i.id not in self.waived), key=lambda i: (-i.severity, -i.affected, i.id))

    def waive(self, issue: str, reason: str) -> None:
        if not reason.strip():
            raise ValueError("a waiver needs a reason")
        self.waived[issue] = reason
        self.audit.append(AuditRecord(issue, "", "waive", False, "user", reason))

    def finalize(self, require_no_blocking: bool = True) -> DataFrame:
        open_ = [i.id for i in self.review_queue() if not require_no_blocking or i.severity >= Severity.WARNING or i.repair_class is RepairClass.DO_NOT_TOUCH]
        if open_ and require_no_blocking:
            raise Unfinished(f"open findings: {', '.join(open_)}")
        self.finalized = True
        return self.clean_df

    def rollback(self, version: int = 0) -> DataFrame:
        return self.versions.restore(version)

    def to_dict(self) -> dict[str, Any]:
        return {
            "status": self.status.value, "health_before": self.before.health.overall, "health_after": self.after.health.overall, "health_change": self.after.health.delta(self.before.health), "applied": [vars(r) for r in self.audit.applied], "not_done": [vars(r) for r in self.audit.refused],
            "open": [i.id for i in self.after.issues], "waived": self.waived,
        }


def plan_of(found: ScanResult, audit: AuditLog) -> RepairPlan:
    """Autonomous findings with an action; every other finding is recorded as left alone, with its reasons."""
    plan = RepairPlan()
    for i in found.issues:
        cls, reasons = i.decide()
        made = build(i, i.treatment) if i.treatment and cls.is_autonomous else None
        if made:
            plan.operations.append(made)
        else:
            audit.append(AuditRecord(i.id, i.columns[0], i.treatment.name if i.treatment else "none", False, "policy", "; ".join(reasons) or "no action exists"))
    return plan


def auto_prepare(df: DataFrame, **context: Any) -> PreparationResult:
    """Scan, apply what the policy allows, scan again. The input is not changed."""
    first, audit = scan(df, **context), AuditLog()
    done = run(first.data, plan_of(first, audit), audit)
    return PreparationResult(first, scan(done.data, **context), done.audit, done.versions)


def clean(df: DataFrame, detailed: bool = False, **context: Any) -> DataFrame | PreparationResult:
    found = auto_prepare(df, **context)
    return found if detailed else found.clean_df


# Guided review ------------------------------------------------------------------------------------------

ANSWERS = ("use_recommendation", "choose_alternative", "skip", "waive", "leave_unresolved")
LEVELS = {"minimal": Severity.CRITICAL_REVIEW, "standard": Severity.WARNING, "thorough": Severity.INFO}


@dataclass
class GuidedSession:
    data: DataFrame = field(repr=False)
    found: ScanResult
    context: dict[str, Any]
    level: str = "standard"
    decisions: dict[str, dict[str, str]] = field(default_factory=dict)

    def queue(self) -> list[Issue]:
        """Findings that need a person, at least as severe as the level asks, undecided, gravest first."""
        least = LEVELS[self.level]
        return sorted((i for i in self.found.issues if not i.repair_class.is_autonomous and i.severity >= least and i.id not in self.decisions), key=lambda i: (-i.severity, -i.affected, i.id))

    def answer(self, issue: str, answer: str = "use_recommendation", treatment: str | None = None, reason: str = "") -> None:
        i = next((x for x in self.found.issues if x.id == issue), None)
        if i is None:
            raise KeyError(f"no finding {issue!r}")
        if answer not in ANSWERS:
            raise ValueError(f"{answer!r} is none of {', '.join(ANSWERS)}")
        if answer == "choose_alternative" and treatment not in {t.name for t in i.treatments}:
            raise ValueError(f"{treatment!r} is no candidate of {issue}")
        if answer == "use_recommendation" and (i.treatment is None or i.repair_class is RepairClass.DO_NOT_TOUCH):
            raise ValueError(f"{issue} has no treatment that may be used")
        if answer == "waive" and not reason.strip():
            raise ValueError("a waiver needs a reason")
        self.decisions[issue] = {"answer": answer, "treatment": treatment or "", "reason": reason}

    def export_decisions(self) -> str:
        return json.dumps({"version": 1, "decisions": self.decisions}, sort_keys=True)

    def load_decisions(self, saved: str | dict[str, Any]) -> list[str]:
        """Replays saved answers; ids that are no longer found are returned and ignored."""
        d = json.loads(saved) if isinstance(saved, str) else saved
        known = {i.id for i in self.found.issues}
        for k, v in d["decisions"].items():
            if k in known:
                self.answer(k, v["answer"], v.get("treatment") or None, v.get("reason", ""))
        return sorted(set(d["decisions"]) - known)

    def finish(self) -> PreparationResult:
        audit = AuditLog()
        plan = plan_of(self.found, audit)
        waived = {}
        for i in self.found.issues:
            d = self.decisions.get(i.id)
            if d and d["answer"] == "waive":
                waived[i.id] = d["reason"]
            if not d or d["answer"] not in ("use_recommendation", "choose_alternative"):
                continue
            t = next((t for t in i.treatments if t.name == d["treatment"]), i.treatment)
            if t.name == "treat_as_missing":
                t = type(t)(t.name, t.confidence, parameters={"codes": list(i.details["codes"])})
            made = build(i, t)
            if made:
                plan.operations.append(made)
            else:
                audit.append(AuditRecord(i.id, i.columns[0], t.name, False, "user", "no action exists"))
        done = run(self.found.data, plan, audit, "guided")
        return PreparationResult(self.found, scan(done.data, **self.context), done.audit, done.versions, waived)


def guided_prepare(df: DataFrame, level: str = "standard", decisions: str | dict[str, Any] | None = None, **context: Any) -> GuidedSession:
    found = scan(df, **context)
    session = GuidedSession(found.data, found, context, level)
    if decisions:
        session.load_decisions(decisions)
    return session


# Workflow -----------------------------------------------------------------------------------------------

STAGES = ("load", "scan", "types", "missing", "categories", "duplicates", "outliers", "validate", "report")
# Which findings each repairing stage owns.
OWNS = {
    "types": ("mixed_physical_type", "invalid_date", "ambiguous_date", "currency_context"),
    "missing": ("missingness", "suspicious_missingness", "structural_missingness", "sentinel_candidate"),
    "categories": ("category_variant", "unicode_confusable", "geographic_conflict", "unknown_entity"),
    "duplicates": ("exact_duplicate", "conflicting_duplicate", "identifier_metadata_mismatch"),
    "outliers": ("range_violation", "formula_violation", "state_contradiction", "accounting_implausibility", "unusual_pattern"),
}


class WorkflowError(ValueError):
    """The stages cannot run in this arrangement."""


def stage_for(category: str) -> str | None:
    return next((s for s, cs in OWNS.items() if category in cs), None)


@dataclass
class Node:
    stage: str
    enabled: bool = True
    after: tuple[str, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class NodeOutcome:
    stage: str
    ran: bool
    operations: int = 0
    cells_changed: int = 0
    health: float | None = None
    note: str = ""


@dataclass
class WorkflowRun:
    outcomes: list[NodeOutcome]
    data: DataFrame = field(repr=False)
    audit: AuditLog = field(default_factory=AuditLog)

    @property
    def cells_changed(self) -> int:
        return sum(o.cells_changed for o in self.outcomes)


@dataclass
class Workflow:
    nodes: list[Node] = field(default_factory=list)

    def get(self, stage: str) -> Node:
        found = next((n for n in self.nodes if n.stage == stage), None)
        if found is None:
            raise WorkflowError(f"no stage {stage!r}")
        return found

    def add(self, node: Node) -> Workflow:
        if node.stage not in STAGES or any(n.stage == node.stage for n in self.nodes):
            raise WorkflowError(f"{node.stage!r} is unknown or there already")
        self.nodes.append(node)
        return self

    def remove(self, stage: str) -> Workflow:
        self.nodes.remove(self.get(stage))
        return self

    def enable(self, stage: str, on: bool = True) -> Workflow:
        self.get(stage).enabled = on
        return self

    def configure(self, stage: str, **options: Any) -> Workflow:
        self.get(stage).options |= options
        return self

    def connect(self, stage: str, after: str) -> Workflow:
        if STAGES.index(after) >= STAGES.index(stage):
            raise WorkflowError(f"{stage} cannot wait for {after}")
        n = self.get(stage)
        n.after = (*n.after, after)
        return self

    def validate(self) -> list[str]:
        problems = []
        places = [STAGES.index(n.stage) for n in self.nodes]
        if places != sorted(places):
            problems.append("stages are out of order")
        on = {n.stage for n in self.nodes if n.enabled}
        problems += [f"{n.stage} waits for {a}, which does not run" for n in self.nodes if n.enabled for a in n.after if a not in on]
        if on & set(OWNS) and "scan" not in on:
            problems.append("repairs need a scan")
        return problems

    def run(self, df: DataFrame, **context: Any) -> WorkflowRun:
        """Each repairing stage runs its share of one plan through the executor."""
        if problems := self.validate():
            raise WorkflowError("; ".join(problems))
        audit, found, plan, outcomes, current = AuditLog(), None, RepairPlan(), [], df
        for n in self.nodes:
            if not n.enabled:
                outcomes.append(NodeOutcome(n.stage, False, note="disabled"))
                continue
            if n.stage == "scan":
                found = scan(current, **context)
                current, plan = found.data, plan_of(found, audit)
                homeless = [o.issue for o in plan.operations if stage_for(next(i.category for i in found.issues if i.id == o.issue)) is None]
                if homeless:
                    raise WorkflowError(f"no stage owns {', '.join(homeless)}")
                outcomes.append(NodeOutcome("scan", True, health=found.health.overall))
            elif n.stage in OWNS:
                own = {i.id for i in found.issues if i.category in OWNS[n.stage]}
                share = RepairPlan([o for o in plan.operations if o.issue in own])
                before = audit.cells_changed
                current = run(current, share, audit, n.stage).data
                outcomes.append(NodeOutcome(n.stage, True, len(share.operations), audit.cells_changed - before))
            elif n.stage == "validate" and "plan" in n.options:
                result = n.options["plan"].run(current)
                outcomes.append(NodeOutcome("validate", True, note=result.outcome.name))
            elif n.stage == "report":
                outcomes.append(NodeOutcome("report", True, health=scan(current, **context).health.overall))
            else:
                outcomes.append(NodeOutcome(n.stage, True))
        return WorkflowRun(outcomes, current, audit)

    def to_json(self) -> str:
        return json.dumps({"version": 1, "nodes": [{"stage": n.stage, "enabled": n.enabled, "after": list(n.after)} for n in self.nodes]})

    @staticmethod
    def from_json(saved: str) -> Workflow:
        return Workflow([Node(d["stage"], d["enabled"], tuple(d["after"])) for d in json.loads(saved)["nodes"]])

    def to_python(self) -> str:
        lines = ["from datawright.plans.prepare import Node, Workflow", "", "flow = Workflow()"]
        lines += [f"flow.add(Node({n.stage!r}, {n.enabled!r}, {n.after!r}))" for n in self.nodes]
        return "\n".join([*lines, "result = flow.run(df)"]) + "\n"


def default_workflow() -> Workflow:
    return Workflow([Node(s) for s in STAGES])
