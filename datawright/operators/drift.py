"""Drift between a reference and a current table: numeric, categorical, missing cells, findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_missing, number, text
from ..sources.frames import ROW
from .ordering import cumulative, place, quantiles

# From which PSI or KS a drift has which severity; the same for JSD.
PSI_STEPS, KS_STEPS, JSD_STEPS = (0.05, 0.1, 0.25, 0.5), (0.1, 0.15, 0.25, 0.4), (0.01, 0.05, 0.1)
#: Levels that a report names; all are counted.
SHOWN = 50
LEVELS = ("none", "minor", "moderate", "severe", "extreme")


def _sides(reference: DataFrame, current: DataFrame, column: str, read: Callable[[DataFrame, str], Column]) -> DataFrame:
    a, b = (d.select(read(d, column).alias("x"), F.lit(s).alias("side")) for d, s in ((reference, "r"), (current, "c")))
    return a.unionByName(b).filter("x is not null")


def bin_edges(reference: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Inner edges: the distinct quantiles of the reference between its extremes; one value alone has none."""
    found = quantiles(reference, {"x": number(reference, column)}, [k / bins for k in range(bins + 1)])["x"]
    return sorted(set(found))[1:-1] if found else []


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """(psi): population stability index over the reference's quantile bins."""
    counted = _sides(reference, current, column, number).groupBy(place("x", bin_edges(reference, column, bins)).alias("bin")).agg(F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c"))
    totals = counted.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    share = lambda k: F.greatest(F.col(k) / F.col(f"n{k}"), F.lit(floor))
    return counted.crossJoin(F.broadcast(totals)).agg(F.sum((share("c") - share("r")) * F.log(share("c") / share("r"))).alias("psi"))  # totals: one row


def ks(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(ks): largest gap between the two distribution functions."""
    counted = _sides(reference, current, column, number).groupBy("x").agg(F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c"))
    totals = counted.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    return cumulative(counted, "x", ["r", "c"]).crossJoin(F.broadcast(totals)).agg(F.max(F.abs(F.col("cum_r") / F.col("nr") - F.col("cum_c") / F.col("nc"))).alias("ks"))  # one row


def jensen_shannon(reference: DataFrame, current: DataFrame, column: str, smooth: float = 1e-12) -> DataFrame:
    """(jsd): Jensen-Shannon divergence of the level shares, natural logarithm."""
    counted = _sides(reference, current, column, text).groupBy("x").agg(F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c"))
    totals = counted.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    p, q = F.col("r") / F.col("nr") + smooth, F.col("c") / F.col("nc") + smooth
    m = (p + q) / 2
    return counted.crossJoin(F.broadcast(totals)).agg((F.sum(p * F.log(p / m) + q * F.log(q / m)) / 2).alias("jsd"))  # one row


def new_levels(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(level) found only in the current table. Swap the tables for lost levels."""
    levels = lambda d: d.select(text(d, column).alias("level")).filter("level is not null").distinct()
    return levels(current).join(levels(reference), "level", "left_anti")


def missing_drift(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(reference_rate, current_rate, change)."""
    rate = lambda d, n: d.agg(F.coalesce(F.avg(is_missing(d, column).cast("double")), F.lit(0.0)).alias(n))
    return rate(reference, "reference_rate").crossJoin(rate(current, "current_rate")).select("*", (F.col("current_rate") - F.col("reference_rate")).alias("change"))  # one row each


def step_of(value: float, steps: tuple[float, ...]) -> int:
    return sum(value >= s for s in steps)


@dataclass(frozen=True)
class Drift:
    column: str
    kind: str
    severity: str
    measures: dict[str, float]
    new: tuple[str, ...] = ()
    lost: tuple[str, ...] = ()


@dataclass
class DriftReport:
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    found: list[Drift] = field(default_factory=list)

    @property
    def drifted(self) -> list[Drift]:
        return [d for d in self.found if d.severity != "none"]

    def contributors(self) -> dict[str, float]:
        """Share of each drifted column in the sum of its PSI or divergence."""
        weights = {d.column: max(d.measures.get("psi", 0.0), d.measures.get("jsd", 0.0)) for d in self.drifted if d.kind != "missing"}
        total = sum(weights.values())
        return {c: w / total for c, w in sorted(weights.items(), key=lambda x: -x[1])} if total else {}


def compare(reference: DataFrame, current: DataFrame) -> DriftReport:
    """All columns that both tables have; a column is numeric if over 90 % of its cells are numbers on both sides, and over 5."""
    report = DriftReport(sorted({*current.columns} - {*reference.columns}), sorted({*reference.columns} - {*current.columns}))
    both = [c for c in reference.columns if c in current.columns and c != ROW]
    shares = [d.agg(*[F.struct(F.count(number(d, c)).alias("n"), F.count_if(~is_missing(d, c)).alias("present")).alias(f"c{k}") for k, c in enumerate(both)]).first() for d in (reference, current)]
    for k, c in enumerate(both):
        numeric = all(s[f"c{k}"]["n"] > 5 and s[f"c{k}"]["n"] > 0.9 * s[f"c{k}"]["present"] for s in shares)
        present = all(s[f"c{k}"]["present"] for s in shares)
        if numeric:
            p, d = psi(reference, current, c).first()[0], ks(reference, current, c).first()[0]
            means = [x.agg(F.avg(number(x, c))).first()[0] for x in (reference, current)]
            severity = LEVELS[max(step_of(p, PSI_STEPS), step_of(d, KS_STEPS))]
            report.found.append(Drift(c, "numeric", severity, {"psi": p, "ks": d, "mean_shift": abs(means[1] - means[0]) / (abs(means[0]) or 1.0)}))
        elif present:
            j = jensen_shannon(reference, current, c).first()[0]
            # All are counted; the report shows the first ones.
            new, lost = new_levels(reference, current, c), new_levels(current, reference, c)
            many = [x.count() for x in (new, lost)]
            shown = [tuple(r[0] for r in x.orderBy("level").limit(SHOWN).collect()) for x in (new, lost)]
            report.found.append(Drift(c, "categorical", "severe" if many[0] else LEVELS[step_of(j, JSD_STEPS)], {"jsd": j, "new": float(many[0]), "lost": float(many[1])}, *shown))
        m = missing_drift(reference, current, c).first()
        if abs(m["change"]) >= 0.05:
            report.found.append(Drift(c, "missing", "severe" if abs(m["change"]) > 0.25 else "moderate" if abs(m["change"]) > 0.1 else "minor", {"change": m["change"]}))
    return report


def cleaning_drift(reference: dict[str, int], current: dict[str, int]) -> dict[str, object]:
    """Findings by id with their row counts: which appeared, were resolved or worsened (over 1.5 times), and how stable the set is."""
    before, after = set(reference), set(current)
    worse = sorted(i for i in before & after if current[i] > 1.5 * reference[i])
    appeared, resolved = sorted(after - before), sorted(before - after)
    stability = len(before & after) / len(before | after) if before | after else 1.0
    verdict = "stable" if not appeared and not worse else "worsened" if len(appeared) + len(worse) > len(resolved) else "changed"
    return {"appeared": appeared, "resolved": resolved, "worsened": worse, "stability": stability, "verdict": verdict}

