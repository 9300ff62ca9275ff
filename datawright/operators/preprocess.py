"""Fit/transform preprocessing and advice.

What is fitted is one aggregate a step; it is applied as expressions, or as a join for learned levels. Maps of levels stay
DataFrames; only those that become columns (one-hot) are collected, with a checked bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.cells import is_missing, number, text
from ..sources.frames import ROW
from .ordering import cumulative, quantiles
from .profile import levels_of, skewness

SMOOTHING, FOLDS, MAX_ONE_HOT = 10.0, 5, 1_000
GRID = [round(-2.0 + 0.1 * k, 10) for k in range(51)]


class NotFitted(RuntimeError):
    """Transforming before fitting."""


def replaced(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, value)


# Imputation ---------------------------------------------------------------------------------------------


def fill_value(df: DataFrame, column: str, method: str, value: Any = 0) -> Any:
    """What ``mean``, ``median``, ``mode`` (the smallest of the most frequent) or ``constant`` fills in."""
    if method == "constant":
        return value
    if method == "mode":
        first = df.filter(~is_missing(df, column)).groupBy(column).count().orderBy(F.desc("count"), column).first()
        return first[0] if first else None
    if method == "median":
        return _median(df, column)
    if method != "mean":
        raise ValueError(f"unknown imputation {method!r}")
    return df.agg(F.avg(number(df, column))).first()[0]


def _median(df: DataFrame, column: str) -> float | None:
    found = quantiles(df, {"x": number(df, column)}, [0.5])["x"]
    return found[0] if found else None


def impute(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.withColumn(column, F.when(is_missing(df, column), F.lit(value)).otherwise(F.col(column)))


def group_medians(df: DataFrame, column: str, by: str) -> DataFrame:
    """(__level, __median) by the level's text."""
    return df.groupBy(text(df, by).alias("__level")).agg(F.median(number(df, column)).alias("__median"))


def impute_by_group(df: DataFrame, column: str, by: str, medians: DataFrame, fallback: float | None) -> DataFrame:
    joined = df.withColumn("__by", text(df, by)).join(medians, F.col("__by") == F.col("__level"), "left")
    return joined.withColumn(column, F.when(is_missing(df, column), F.coalesce("__median", F.lit(fallback))).otherwise(F.col(column))).select(*df.columns)


def fill_forward(df: DataFrame, column: str, order: str = ROW, by: list[str] | None = None, backward: bool = False) -> DataFrame:
    """Last present value before (or first after) in the order, within ``by``. A table without ``by`` is one series."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    x = F.when(~is_missing(df, column), F.col(column))
    filled = F.first(x, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)) if backward else F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(column, filled)


def interpolate(df: DataFrame, column: str, order: str = ROW, by: list[str] | None = None) -> DataFrame:
    """Linear by row between present values; leading gaps stay, trailing ones carry the last value."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    back, on = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    x = number(df, column)
    place = F.row_number().over(w)
    marked = df.withColumn("__x", x).withColumn("__at", place).withColumn("__k", F.when(F.col("__x").isNotNull(), F.col("__at")))
    a, b, i, j = F.last("__x", ignorenulls=True).over(back), F.first("__x", ignorenulls=True).over(on), F.last("__k", ignorenulls=True).over(back), F.first("__k", ignorenulls=True).over(on)
    filled = F.when(b.isNull(), a).when(i == j, a).otherwise(a + (b - a) * (F.col("__at") - i) / (j - i))
    return marked.withColumn(column, filled).drop("__x", "__at", "__k")


# Encoding -----------------------------------------------------------------------------------------------


def sorted_levels(df: DataFrame, column: str, most: int = MAX_ONE_HOT) -> list[str]:
    """Present texts in order; refused above ``most``."""
    found = [r[0] for r in df.select(text(df, column).alias("v")).filter("v is not null").distinct().orderBy("v").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has over {most} levels; encode it by frequency, count or target")
    return found


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    t = text(df, column)
    return df.select("*", *[F.coalesce((t == level).cast("int"), F.lit(0)).alias(f"{column}__{level}") for level in levels]).drop(column)


def ordinal_codes(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    t, code = text(df, column), F.lit(-1)
    place = F.array_position(F.array(*[F.lit(v) for v in levels]).cast("array<string>"), t) - 1
    return df.withColumn(column, F.coalesce(place.cast("int"), code))


def level_table(df: DataFrame, column: str) -> DataFrame:
    """(__level, __n, __share); a missing cell is a level of its own, written ``None``."""
    total = df.count()
    return df.groupBy(F.coalesce(text(df, column), F.lit("None")).alias("__level")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__share", F.col("__n") / F.lit(max(total, 1)))


def by_level(df: DataFrame, column: str, learned: DataFrame, value: str, default: Any) -> DataFrame:
    """The learned ``value`` of each row's level; unknown levels get the default."""
    joined = df.withColumn("__of", F.coalesce(text(df, column), F.lit("None"))).join(learned.select("__level", value), F.col("__of") == F.col("__level"), "left")
    return joined.withColumn(column, F.coalesce(value, F.lit(default))).select(*df.columns)


def target_means(df: DataFrame, column: str, target: str, smoothing: float = SMOOTHING) -> tuple[DataFrame, float]:
    """((__level, __mean), prior): means of the target pulled to the overall mean as by ``smoothing`` rows of it."""
    prior = df.agg(F.avg(number(df, target))).first()[0]
    y = number(df, target)
    sums = df.groupBy(F.coalesce(text(df, column), F.lit("None")).alias("__level")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    return sums.select("__level", ((F.coalesce("s", F.lit(0.0)) + prior * smoothing) / (F.col("n") + smoothing)).alias("__mean")), prior


def target_out_of_fold(df: DataFrame, column: str, target: str, order: str = ROW, folds: int = FOLDS, smoothing: float = SMOOTHING) -> DataFrame:
    """Each row's level mean over the rows of other folds (row number modulo ``folds``): level totals less fold totals, no pass per fold."""
    y, fold = number(df, target), F.pmod(F.col(order), F.lit(folds))
    base = df.withColumn("__of", F.coalesce(text(df, column), F.lit("None"))).withColumn("__fold", fold)
    per = base.groupBy("__of", "__fold").agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("fs"), F.count(y).alias("fn"))
    whole = per.groupBy("__of").agg(F.sum("fs").alias("s"), F.sum("fn").alias("n"))
    per_fold = per.groupBy("__fold").agg(F.sum("fs").alias("ps"), F.sum("fn").alias("pn"))
    everything = per_fold.agg(F.sum("ps").alias("as"), F.sum("pn").alias("an"))
    priors = per_fold.crossJoin(F.broadcast(everything)).select("__fold", F.try_divide(F.col("as") - F.col("ps"), F.col("an") - F.col("pn")).alias("prior"))  # one row
    learned = per.join(whole, "__of").join(F.broadcast(priors), "__fold")
    value = F.when(F.col("n") - F.col("fn") > 0, (F.col("s") - F.col("fs") + F.col("prior") * smoothing) / (F.col("n") - F.col("fn") + smoothing)).otherwise(F.col("prior"))
    return base.join(learned.select("__of", "__fold", value.alias("__v")), ["__of", "__fold"], "left").withColumn(column, F.col("__v")).select(*df.columns)


# Scaling ------------------------------------------------------------------------------------------------


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < 1e-8 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-8 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def fit_yeo(df: DataFrame, column: str) -> float:
    """Power on the grid with the least absolute skew: all of the grid in one aggregate."""
    x = number(df, column)
    n = F.count(x).cast("double")
    tried = df.agg(*[F.struct(F.abs(skewness(n, F.skewness(yeo_johnson(x, p)))).alias("skew"), F.stddev_pop(yeo_johnson(x, p)).alias("sd")).alias(f"p{k}") for k, p in enumerate(GRID)]).first()
    fine = [(tried[f"p{k}"]["skew"], p) for k, p in enumerate(GRID) if tried[f"p{k}"]["sd"]]
    return min(fine)[1] if fine else 1.0


def fit_scale(df: DataFrame, column: str, method: str) -> dict[str, float]:
    x = number(df, column)
    one = lambda *a: df.agg(*a).first()
    if method == "standard":
        mean, sd = one(F.avg(x), F.stddev_pop(x))
        return {"mean": mean, "std": sd or 1.0}
    if method == "minmax":
        low, high = one(F.min(x), F.max(x))
        return {"min": low, "range": (high - low) or 1.0}
    if method == "robust":
        q = quantiles(df, {"x": x}, [0.25, 0.5, 0.75])["x"]
        return {"median": q[1], "iqr": (q[2] - q[0]) or 1.0}
    if method == "maxabs":
        return {"maxabs": one(F.max(F.abs(x)))[0] or 1.0}
    if method == "log1p":
        return {"shift": min(0.0, one(F.min(x))[0])}
    if method == "yeo_johnson":
        return {"lambda": fit_yeo(df, column)}
    if method == "quantile_rank":
        return {}
    raise ValueError(f"unknown scaler {method!r}")


def scaled(x: Column, method: str, p: dict[str, float]) -> Column:
    if method == "standard":
        return (x - p["mean"]) / p["std"]
    if method == "minmax":
        return (x - p["min"]) / p["range"]
    if method == "robust":
        return (x - p["median"]) / p["iqr"]
    if method == "maxabs":
        return x / p["maxabs"]
    if method == "log1p":
        return F.log1p(x - p["shift"])
    return yeo_johnson(x, p["lambda"])


def quantile_rank(df: DataFrame, column: str, fitted: DataFrame) -> DataFrame:
    """Share of fitted values below each value: both are counted by value and summed up in order; nulls stay."""
    x = number(df, column)
    seen = fitted.select(number(fitted, column).alias("v"), F.lit(1).alias("n")).unionByName(df.select(x.alias("v"), F.lit(0).alias("n"))).filter("v is not null").groupBy("v").agg(F.sum("n").alias("n"))
    total = fitted.agg(F.count(number(fitted, column))).first()[0]
    ranks = cumulative(seen, "v", ["n"]).select(F.col("v").alias("__v"), ((F.col("cum_n") - F.col("n")) / F.lit(max(total, 1))).alias("__rank"))
    return df.withColumn("__x", x).join(ranks, F.col("__x") == F.col("__v"), "left").withColumn(column, F.col("__rank")).select(*df.columns)


# The pipeline -------------------------------------------------------------------------------------------


@dataclass
class Step:
    kind: str
    method: str
    column: str
    options: dict[str, Any] = field(default_factory=dict)
    apply: Callable[[DataFrame], DataFrame] | None = field(default=None, repr=False)


@dataclass
class Preprocessor:
    """Ordered steps; each is fitted on the table as the steps before it leave it."""

    target: str | None = None
    steps: list[Step] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    fitted: bool = False

    def _add(self, kind: str, method: str, column: str, **options: Any) -> Preprocessor:
        self.steps.append(Step(kind, method, column, options))
        return self

    def indicator(self, column: str) -> Preprocessor:
        return self._add("indicator", "missing", column)

    def impute(self, column: str, method: str = "median", **options: Any) -> Preprocessor:
        return self._add("impute", method, column, **options)

    def encode(self, column: str, method: str = "one_hot", **options: Any) -> Preprocessor:
        if method in ("target", "smoothed_mean_target") and not self.target:
            raise ValueError(f"{method} encoding needs a target")
        return self._add("encode", method, column, **options)

    def scale(self, column: str, method: str = "standard") -> Preprocessor:
        return self._add("scale", method, column)

    def _fit(self, step: Step, df: DataFrame) -> Callable[[DataFrame], DataFrame]:
        c, m, o = step.column, step.method, step.options
        if step.kind == "indicator":
            return lambda d: d.withColumn(f"{c}__was_missing", is_missing(d, c).cast("int"))
        if step.kind == "impute":
            if m in ("ffill", "bfill"):
                return lambda d: fill_forward(d, c, o.get("order", ROW), o.get("by"), m == "bfill")
            if m == "interpolate":
                return lambda d: interpolate(d, c, o.get("order", ROW), o.get("by"))
            if m == "group_median":
                medians, fallback = group_medians(df, c, o["by"]), _median(df, c)
                return lambda d: impute_by_group(d, c, o["by"], medians, fallback)
            value = fill_value(df, c, m, o.get("value", 0))
            return lambda d: impute(d, c, value)
        if step.kind == "encode":
            if m == "one_hot":
                levels = sorted_levels(df, c)
                return lambda d: one_hot(d, c, levels)
            if m == "ordinal":
                levels = o.get("order") or levels_of(df, c) or sorted_levels(df, c)
                return lambda d: ordinal_codes(d, c, levels)
            if m in ("frequency", "count"):
                table, value, default = level_table(df, c), "__share" if m == "frequency" else "__n", 0.0 if m == "frequency" else 0
                return lambda d: by_level(d, c, table, value, default)
            if m in ("target", "smoothed_mean_target"):
                means, prior = target_means(df, c, self.target, o.get("smoothing", SMOOTHING))
                return lambda d: by_level(d, c, means, "__mean", prior)
            raise ValueError(f"unknown encoder {m!r}")
        if m == "quantile_rank":
            return lambda d: quantile_rank(d, c, df)
        params = fit_scale(df, c, m)
        return lambda d: d.withColumn(c, scaled(number(d, c), m, params))

    def check(self, df: DataFrame) -> list[str]:
        """Leakage: plain target means, fills that look across rows, and columns that all but equal the target."""
        found = []
        for s in self.steps:
            if s.column not in df.columns and not any(s.column.startswith(f"{t.column}__") for t in self.steps):
                raise KeyError(f"no column {s.column!r}")
            if s.method == "smoothed_mean_target":
                found.append(f"{s.column}: target means fitted on the rows that they encode")
            if s.method in ("ffill", "bfill", "interpolate"):
                found.append(f"{s.column}: {s.method} uses neighbouring rows; sort and split by time first")
        if self.target:
            usable = sorted({s.column for s in self.steps if s.column in df.columns and s.column != self.target})
            if usable:
                one = df.agg(*[F.corr(number(df, c), number(df, self.target)) for c in usable]).first()
                found += [f"{c}: correlates with the target at {v:.3f}" for c, v in zip(usable, one, strict=True) if v is not None and abs(v) > 0.98]
        return found

    def fit(self, df: DataFrame) -> Preprocessor:
        self.warnings = self.check(df)
        for s in self.steps:
            s.apply = self._fit(s, df)
            df = s.apply(df)
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise NotFitted("fit before transform")
        for s in self.steps:
            df = s.apply(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """As fit and transform, but target encoding gives out-of-fold means."""
        start = df
        self.warnings = self.check(df)
        for s in self.steps:
            s.apply = self._fit(s, df)
            if s.kind == "encode" and s.method == "target" and ROW in start.columns:
                df = target_out_of_fold(df, s.column, self.target, ROW, s.options.get("folds", FOLDS), s.options.get("smoothing", SMOOTHING))
            else:
                df = s.apply(df)
        self.fitted = True
        return df


# Advice -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Advice:
    column: str
    kind: str
    method: str
    reason: str
    #: How sure the advice is, from 0 to 1, and what else would do.
    confidence: float = 0.8
    alternatives: tuple[str, ...] = ()


#: Other methods that would do for one.
ALTERNATIVES = {
    "missing": (), "median": ("mean", "group_median"), "mode": ("constant",), "ffill": ("interpolate", "bfill"), "log1p": ("yeo_johnson", "quantile_rank"), "robust": ("quantile_rank", "standard"), "standard": ("minmax", "robust"),
    "ordinal": ("one_hot",), "one_hot": ("frequency", "target"), "target": ("frequency", "count"), "frequency": ("count", "target"),
}


def recommend(df: DataFrame, goal: str = "machine_learning", target: str | None = None, max_cardinality: int = 50) -> list[Advice]:
    """Indicator, imputation, encoding and scaling for each column, by goal."""
    found: list[Advice] = []

    def advise(column: str, kind: str, method: str, reason: str, confidence: float) -> None:
        found.append(Advice(column, kind, method, reason, round(confidence, 2), ALTERNATIVES[method]))

    names = [c for c in df.columns if c not in (ROW, target)]
    x = {c: number(df, c) for c in names}
    first = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(F.count_if(is_missing(df, c)).alias("missing"), F.count(v).alias("n"), F.countDistinct(text(df, c)).alias("distinct"), F.skewness(v).alias("g1"), F.min(v).alias("min")).alias(f"c{k}") for k, (c, v) in enumerate(x.items())],
    ).first()
    one = {c: first[f"c{k}"] for k, c in enumerate(names)}
    numeric = [c for c in names if one[c]["n"] and one[c]["n"] >= 0.9 * (first["rows"] - one[c]["missing"])]
    quarters = quantiles(df, {c: x[c] for c in numeric}, [0.25, 0.75]) if numeric else {}
    fences = {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) for c, q in quarters.items()}
    outside = df.agg(*[F.count_if((x[c] < fences[c][0]) | (x[c] > fences[c][1])) for c in numeric]).first() if numeric else ()
    beyond = dict(zip(numeric, outside, strict=True))
    for c in names:
        s, missing = one[c], one[c]["missing"] / max(1, first["rows"])
        is_number, n = c in numeric, s["n"]
        skew = abs(s["g1"] or 0.0) * ((n * (n - 1)) ** 0.5 / (n - 2) if n > 2 else 1.0)
        if missing > 0:
            if missing > 0.05:
                advise(c, "indicator", "missing", f"{missing:.1%} missing; absence may carry information", min(0.95, 0.7 + missing))
            how = "ffill" if goal == "time_series" else "mode" if not is_number else "median"
            advise(c, "impute", how, "skewed: the median resists the tail" if how == "median" and skew > 1 else "the middle of a symmetric column" if how == "median" else "follows the order of time" if how == "ffill" else "the most frequent level", 0.9 - missing / 2)
        if is_number:
            if n >= 3 and goal != "tree":
                how = "log1p" if skew > 2 and s["min"] >= 0 else "robust" if beyond[c] > 0.05 * n else "standard"
                advise(c, "scale", how, {"log1p": "long right tail without negatives", "robust": "many values outside the fences", "standard": "no strong tail"}[how], 0.9 if how != "standard" or skew < 1 else 0.7)
        elif s["distinct"] > 1 and isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType)):
            d = s["distinct"]
            if d > max_cardinality and first["rows"] and d > 0.95 * first["rows"]:
                continue
            how = "ordinal" if levels_of(df, c) or d <= 2 else "one_hot" if d <= 15 else "target" if target and goal in ("machine_learning", "tree") else "frequency"
            advise(c, "encode", how, {"ordinal": "declared order or two levels", "one_hot": "few levels", "target": "many levels and a target", "frequency": "many levels"}[how], 0.95 if levels_of(df, c) or d <= 10 else 0.75)
    return found


def to_preprocessor(advice: list[Advice], target: str | None = None) -> Preprocessor:
    made = Preprocessor(target)
    for kind in ("indicator", "impute", "encode", "scale"):
        for a in advice:
            if a.kind == kind:
                made._add(kind, a.method, a.column)
    return made
