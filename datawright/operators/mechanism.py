"""Missingness mechanism: does the absence of a column depend on other columns?"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_missing, number, text
from ..sources.frames import ROW
from .ordering import cumulative
from .statistics import chi2_tail, holm, mann_whitney

ALPHA, LEAST, MAX_PREDICTORS = 0.05, 8, 25


def mwu(df: DataFrame, target: str, predictor: str) -> DataFrame:
    """(u, n_absent, n_present, ties) of a numeric predictor between rows where the target is missing and where not.

    From value counts: below-counts come from cumulative sums, so nothing is ranked row by row.
    """
    base = df.select(number(df, predictor).alias("x"), is_missing(df, target).alias("gap")).filter("x is not null")
    counted = base.groupBy("x").agg(F.count_if("gap").alias("a"), F.count_if(~F.col("gap")).alias("p"))
    run = cumulative(counted, "x", ["p"])
    t = (F.col("a") + F.col("p")).cast("double")
    u = F.sum(F.col("a") * (F.col("cum_p") - F.col("p") + F.col("p") / 2.0))
    return run.agg(F.coalesce(u, F.lit(0.0)).alias("u"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_absent"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_present"), F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties"))


def chi2(df: DataFrame, target: str, predictor: str) -> DataFrame:
    """(chi2, levels, least): statistic of absence by level, over levels with 8 rows; ``least`` is the smallest cell. Two levels get Yates' correction."""
    base = df.select(text(df, predictor).alias("g"), is_missing(df, target).alias("gap")).filter("g is not null")
    levels = base.groupBy("g").agg(F.count_if("gap").cast("double").alias("a"), F.count_if(~F.col("gap")).cast("double").alias("p")).filter(F.col("a") + F.col("p") >= LEAST)
    totals = levels.agg(F.sum("a").alias("na"), F.sum("p").alias("np"), F.count(F.lit(1)).alias("levels"))
    n = F.col("na") + F.col("np")
    size = F.col("a") + F.col("p")

    def part(seen: str, total: str):  # noqa: ANN202
        expected = size * F.col(total) / n
        off = F.abs(F.col(seen) - expected)
        off = F.when(F.col("levels") == 2, F.greatest(F.lit(0.0), off - 0.5)).otherwise(off)
        return F.try_divide(off * off, expected)

    return levels.crossJoin(F.broadcast(totals)).agg(F.sum(part("a", "na") + part("p", "np")).alias("chi2"), F.max("levels").alias("levels"), F.min(F.least("a", "p")).alias("least"))  # totals: one row


@dataclass
class Dependence:
    predictor: str
    test: str
    statistic: float
    p: float
    adjusted: float = 1.0

    @property
    def is_significant(self) -> bool:
        return self.adjusted < ALPHA


@dataclass
class Mechanism:
    column: str
    verdict: str
    missing: int
    tests: list[Dependence] = field(default_factory=list)
    monotone_with: list[str] = field(default_factory=list)


def mechanism(df: DataFrame, columns: list[str] | None = None, max_predictors: int = MAX_PREDICTORS) -> list[Mechanism]:
    """Verdict for each column with missing cells: ``not_mcar``, ``mcar_not_rejected``, or ``undetermined`` with under 8 rows on a side or no usable predictor."""
    names = [c for c in df.columns if c != ROW]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count_if(is_missing(df, c)).alias("missing"), F.count(number(df, c)).alias("parsed"), F.approx_count_distinct(text(df, c)).alias("distinct")).alias(f"c{k}") for k, c in enumerate(names)]).first()
    one = {c: counts[f"c{k}"] for k, c in enumerate(names)}
    found = []
    for target in columns or [c for c in names if one[c]["missing"]]:
        gaps = one[target]["missing"]
        made = Mechanism(target, "undetermined", gaps)
        found.append(made)
        if gaps < LEAST or counts["n"] - gaps < LEAST:
            continue
        others = [c for c in names if c != target and one[c]["missing"] < counts["n"]][:max_predictors]
        same = [c for c in others if one[c]["missing"] == gaps]
        if same:
            together = df.agg(*[F.count_if(is_missing(df, target) & is_missing(df, c)) for c in same]).first()
            made.monotone_with = [c for c, k in zip(same, together, strict=True) if k == gaps]
        for c in others:
            present = counts["n"] - one[c]["missing"]
            if one[c]["parsed"] >= 0.9 * present and one[c]["distinct"] > 2:
                r = mwu(df, target, c).first()
                if min(r["n_absent"], r["n_present"]) >= LEAST:
                    made.tests.append(Dependence(c, "mann_whitney", r["u"], mann_whitney(r["u"], r["n_absent"], r["n_present"], r["ties"])))
            elif one[c]["distinct"] <= 50:
                r = chi2(df, target, c).first()
                if r["levels"] and r["levels"] > 1 and r["least"] >= 1:
                    made.tests.append(Dependence(c, "chi2", r["chi2"], chi2_tail(r["chi2"], r["levels"] - 1)))
        for t, p in zip(made.tests, holm([t.p for t in made.tests]), strict=True):
            t.adjusted = p
        if made.tests:
            made.verdict = "not_mcar" if any(t.is_significant for t in made.tests) else "mcar_not_rejected"
    return found
