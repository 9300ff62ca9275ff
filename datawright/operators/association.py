"""Associations between columns and patterns of missing cells."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_missing, number, text
from ..sources.frames import ROW
from .ordering import average_ranks
from .profile import DatasetProfile, profile

MAX_COLUMNS = 40
#: Most distinct pairs for Kendall's tau, which compares each with each.
MAX_KENDALL = 3_000


def _pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(number(df, a).alias("x"), number(df, b).alias("y")).filter("x is not null and y is not null")


def correlation(df: DataFrame, a: str, b: str, method: str = "spearman") -> DataFrame:
    """(value, n) over rows complete in both; null with fewer than 3 rows or a constant side.

    Spearman is Pearson on mean ranks, which are computed from value counts and joined back by value.
    """
    pair = _pair(df, a, b)
    if method == "kendall":
        return _kendall(pair)
    if method == "spearman":
        pair = pair.join(average_ranks(pair, "x", "rx"), "x").join(average_ranks(pair, "y", "ry"), "y").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    fine = (F.count(F.lit(1)) >= 3) & (F.min("x") != F.max("x")) & (F.min("y") != F.max("y"))
    return pair.agg(F.when(fine, F.corr("x", "y")).alias("value"), F.count(F.lit(1)).alias("n"))


def _kendall(pair: DataFrame) -> DataFrame:
    """Tau-b from the distinct pairs and their counts; refused above ``MAX_KENDALL`` distinct pairs."""
    counted = pair.groupBy("x", "y").count().limit(MAX_KENDALL + 1).collect()
    if len(counted) > MAX_KENDALL:
        raise ValueError(f"kendall compares each pair with each; over {MAX_KENDALL} distinct pairs are refused")
    n, score = sum(r["count"] for r in counted), 0
    for p, q in itertools.combinations(counted, 2):
        score += p["count"] * q["count"] * ((p.x > q.x) - (p.x < q.x)) * ((p.y > q.y) - (p.y < q.y))
    ties = lambda k: sum(t * (t - 1) // 2 for t in _sums(counted, k).values())
    pairs = n * (n - 1) // 2
    below = math.sqrt(max(0, (pairs - ties("x")) * (pairs - ties("y"))))
    return pair.sparkSession.createDataFrame([(score / below if below and n >= 3 else None, n)], "value double, n long")


def _sums(rows: list, key: str) -> dict:
    found: dict = {}
    for r in rows:
        found[r[key]] = found.get(r[key], 0) + r["count"]
    return found


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of rows present in both, as texts."""
    return df.select(text(df, a).alias("a"), text(df, b).alias("b")).filter("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(value, n): bias-corrected association of two categorical columns; 0 where it is degenerate."""
    cells = crosstab(df, a, b)
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    # Empty cells add their expected counts; sum(o^2/e) - n covers them.
    ratio = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("ratio"), F.sum("n").alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"))
    n, r, c = F.col("n").cast("double"), F.col("r"), F.col("c")
    phi = F.greatest(F.lit(0.0), (F.col("ratio") - 1.0) - (r - 1) * (c - 1) / (n - 1))
    side = lambda k: k - (k - 1) * (k - 1) / (n - 1)
    low = F.least(side(r), side(c)) - 1
    return ratio.select(F.when((n > 1) & (r > 1) & (c > 1) & (low > 0), F.sqrt(phi / low)).otherwise(F.lit(0.0)).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """(value, n): square root of the share of variance between categories."""
    pair = df.select(text(df, category).alias("g"), number(df, value).alias("x")).filter("g is not null and x is not null")
    groups = pair.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    one = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("inside"))
    between = F.greatest(F.lit(0.0), F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    total = between + F.col("inside")
    return one.select(F.when(total > 0, F.sqrt(between / total)).otherwise(F.lit(0.0)).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Association:
    left: str
    right: str
    method: str
    value: float | None
    n: int


@dataclass
class AssociationMatrix:
    pairs: list[Association]

    def strongest(self, n: int = 10, minimum: float = 0.0) -> list[Association]:
        kept = [p for p in self.pairs if p.value is not None and abs(p.value) >= minimum]
        return sorted(kept, key=lambda p: (-abs(p.value), p.left, p.right))[:n]

    def as_grid(self) -> dict[str, dict[str, float | None]]:
        names = sorted({x for p in self.pairs for x in (p.left, p.right)})
        grid: dict[str, dict[str, float | None]] = {a: {b: 1.0 if a == b else None for b in names} for a in names}
        for p in self.pairs:
            grid[p.left][p.right] = grid[p.right][p.left] = p.value
        return grid


def associations(df: DataFrame, made: DatasetProfile | None = None, method: str = "spearman", max_columns: int = MAX_COLUMNS) -> AssociationMatrix:
    """Every pair of usable columns by the measure that fits their kinds; constants and identifiers are left out."""
    made = made or profile(df)
    usable = [c for c in made.columns.values() if c.kind in ("numeric", "boolean", "categorical", "ordinal") and not (c.is_identifier_like and c.kind != "numeric")][:max_columns]
    found = []
    for a, b in itertools.combinations(usable, 2):
        if a.kind == b.kind == "numeric":
            how, one = method, correlation(df, a.name, b.name, method)
        elif "numeric" in (a.kind, b.kind):
            g, x = (b, a) if a.kind == "numeric" else (a, b)
            how, one = "correlation_ratio", correlation_ratio(df, g.name, x.name)
        else:
            how, one = "cramers_v", cramers_v(df, a.name, b.name)
        r = one.first()
        found.append(Association(a.name, b.name, how, r["value"], r["n"]))
    return AssociationMatrix(found)


# Missing cells ------------------------------------------------------------------------------------------


def missing_by_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing, rate)."""
    names = columns or [c for c in df.columns if c != ROW]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(df, c)).alias(f"m{k}") for k, c in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{k}").alias("missing")) for k, c in enumerate(names)]))
    return one.select("n", each.alias("r")).select("r.column", "r.missing", F.coalesce(F.try_divide("r.missing", "n"), F.lit(0.0)).alias("rate"))


def missing_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, complete, any_missing."""
    names = columns or [c for c in df.columns if c != ROW]
    gap = F.lit(False)
    for c in names:
        gap = gap | is_missing(df, c)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~gap).alias("complete"), F.count_if(gap).alias("any_missing"))


def co_missing(df: DataFrame, columns: list[str] | None = None, minimum: float = 0.3) -> DataFrame:
    """(left, right, both, jaccard) of column pairs whose missing rows overlap by more than ``minimum``."""
    names = columns or [c for c in df.columns if c != ROW]
    pairs = list(itertools.combinations(names, 2))
    one = df.agg(*[F.struct(F.count_if(is_missing(df, a) & is_missing(df, b)).alias("both"), F.count_if(is_missing(df, a) | is_missing(df, b)).alias("either")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"p{k}.both").alias("both"), F.col(f"p{k}.either").alias("either")) for k, (a, b) in enumerate(pairs)]))
    rows = one.select(each.alias("r")).select("r.left", "r.right", "r.both", F.try_divide("r.both", "r.either").alias("jaccard"))
    return rows.filter(F.col("jaccard") > minimum)


def missing_patterns(df: DataFrame, columns: list[str] | None = None, top: int = 12) -> DataFrame:
    """(pattern, n): the most frequent strings of 0 and 1 (missing) over the columns."""
    names = columns or [c for c in df.columns if c != ROW]
    bits = F.concat(*[F.when(is_missing(df, c), "1").otherwise("0") for c in names])
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(top)
