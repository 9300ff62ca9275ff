"""Profiles: kinds of columns and their summaries.

``profile`` runs one job for counts, forms and distinct texts, then one for each group of kinds. The single summaries
are usable on their own and return DataFrames with one row per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.cells import MIXED, UNSUPPORTED, cell, number, text
from ..sources.frames import ROW
from .ordering import cumulative, place, quantiles

KINDS = ("empty", "unsupported", "constant", "ordinal", "boolean", "datetime", "numeric", "categorical", "text")
#: Which statistics and charts a kind supports, and why.
SUPPORT = {
    "empty": ((), (), "there is no value to describe"),
    "unsupported": ((), (), "nested values have no order or scale"),
    "constant": (("count",), (), "a single value carries no variation"),
    "ordinal": (("counts", "mode", "median level"), ("bar",), "levels are ordered but not spaced"),
    "boolean": (("counts", "rate of true"), ("bar",), "two states"),
    "datetime": (("range", "gaps", "frequency"), ("timeline",), "points on a time axis"),
    "numeric": (("moments", "quantiles", "outliers"), ("histogram", "box", "ecdf"), "a measure on a scale"),
    "categorical": (("counts", "entropy", "rare levels"), ("bar",), "few repeated levels"),
    "text": (("lengths",), ("length histogram",), "many distinct texts"),
}


def support_table() -> str:
    rows = [f"| {k} | {', '.join(s) or '-'} | {', '.join(c) or '-'} | {why} |" for k, (s, c, why) in SUPPORT.items()]
    return "\n".join(["| kind | statistics | charts | why |", "| --- | --- | --- | --- |", *rows])


def skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected from the population value; 0 for n <= 2 or no spread."""
    return F.when((n > 2) & g1.isNotNull() & ~F.isnan(g1), g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0)).otherwise(F.lit(0.0))


def kurtosis(n: Column, g2: Column) -> Column:
    return F.when((n > 3) & g2.isNotNull() & ~F.isnan(g2), (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0)).otherwise(F.lit(0.0))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, std (population), min, q1, median, q3, max, skew, kurtosis, zeros, negatives, infinities, outliers.

    Moments of all columns together, their exact quantiles, then outliers beyond 1.5 interquartile ranges (0 if that range is 0).
    """
    finite = {c: F.when(F.abs(number(df, c)) != float("inf"), number(df, c)) for c in columns}
    first = df.agg(
        *[
            F.struct(
                F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"),
                F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"), F.count_if(F.abs(number(df, c)) == float("inf")).alias("infinities"),
            ).alias(f"s{k}")
            for k, (c, x) in enumerate(finite.items())
        ]
    )
    made, cuts = first.first(), quantiles(df, finite, [0.25, 0.5, 0.75])
    fences = []
    for c, x in finite.items():
        q = cuts[c]
        iqr = q[2] - q[0] if q else 0
        fences.append(F.count_if((x < q[0] - 1.5 * iqr) | (x > q[2] + 1.5 * iqr)) if iqr > 0 else F.max(F.lit(0)))
    outliers = df.agg(*fences).first()
    rows = [(c, made[f"s{k}"], cuts[c], outliers[k] or 0) for k, c in enumerate(columns)]
    inner = first.schema["s0"].dataType.simpleString()
    n = F.col("s.n").cast("double")
    return df.sparkSession.createDataFrame(rows, f"column string, s {inner}, q array<double>, outliers long").select(
        "column", F.col("s.n").alias("count"), "s.mean", "s.std", "s.min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "s.max",
        skewness(n, F.col("s.g1")).alias("skew"), kurtosis(n, F.col("s.g2")).alias("kurtosis"), "s.zeros", "s.negatives", "s.infinities", "outliers",
    )


def histograms_of(df: DataFrame, columns: list[str], bins: int = 20) -> dict[str, list[tuple[float, float, int]]]:
    """(low, high, n) of equal-width bins of every column, the last one closed; at most half as many bins as values; a constant has one bin.

    Two jobs for all columns: their ends, then one grouped count of (column, bin).
    """
    finite = [F.when(F.abs(number(df, c)) != float("inf"), number(df, c)).alias(f"x{k}") for k, c in enumerate(columns)]
    picked = df.select(*finite)
    ends = picked.agg(*[F.struct(F.min(f"x{k}").alias("low"), F.max(f"x{k}").alias("high"), F.count(f"x{k}").alias("n")).alias(f"x{k}") for k in range(len(columns))]).first()
    edges: list[list[float]] = []
    for low, high, n in ends:
        many = 1 if low == high else min(bins, max(n // 2, 1))
        edges.append([low + (high - low) * j / many for j in range(many)] + [high] if n else [])
    placed = [F.when(F.col(f"x{k}").isNotNull(), F.struct(F.lit(k).alias("k"), place(f"x{k}", e[1:-1]).alias("bin"))) for k, e in enumerate(edges) if e]
    counts: dict[tuple[int, int], int] = {}
    if placed:
        each = picked.select(F.explode(F.array_compact(F.array(*placed))).alias("p")).groupBy("p.k", "p.bin").agg(F.count(F.lit(1)).alias("n"))
        counts = {(r["k"], r["bin"]): r["n"] for r in each.collect()}
    return {c: [(edges[k][j], edges[k][j + 1], counts.get((k, j), 0)) for j in range(len(edges[k]) - 1)] for k, c in enumerate(columns)}


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) of one column's ``histograms_of``."""
    rows = [(k, *r) for k, r in enumerate(histograms_of(df, [column], bins)[column])]
    return df.sparkSession.createDataFrame(rows, "bin int, low double, high double, n long")


def ecdf(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """(value, share): every ``max(1, n // points)``-th order statistic with its share of values up to it."""
    x = number(df, column)
    counted = df.select(x.alias("value")).filter(F.col("value").isNotNull() & (F.abs("value") != float("inf"))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    step = max(1, n // points)
    first = F.col("cum_n") - F.col("n")
    ranks = F.sequence(F.ceil(first / step), F.floor((F.col("cum_n") - 1) / step))
    picked = cumulative(counted, "value", ["n"]).filter(F.ceil(first / step) <= F.floor((F.col("cum_n") - 1) / step))
    return picked.select("value", F.explode(ranks).alias("k")).select("value", ((F.col("k") * step + 1) / F.lit(max(n, 1))).alias("share"))


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the present texts."""
    return df.select(text(df, column).alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top_levels(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The most frequent texts; equal counts in the order of the texts."""
    return level_counts(df, column).orderBy(F.desc("n"), "value").limit(top)


def _levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(k, value, n): the present texts of all columns, counted in one grouped job; k is the column's number."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), text(df, c).alias("value")) for k, c in enumerate(columns)])
    return df.select(F.explode(pairs).alias("p")).filter("p.value is not null").groupBy("p.k", "p.value").agg(F.count(F.lit(1)).alias("n"))


def categorical_summary(df: DataFrame, columns: list[str], rare: float = 0.01) -> DataFrame:
    """One row per column: count, distinct, rare (levels with a share under ``rare``), imbalance (largest share), entropy (base 2)."""
    counted = _levels(df, columns)
    totals = counted.groupBy("k").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "k int, column string")
    # ``totals`` and ``names`` have one row a column.
    one = counted.join(F.broadcast(totals), "k").groupBy("k").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("distinct"), F.count_if(p < rare).alias("rare"), F.max(p).alias("imbalance"), (-F.sum(p * F.log2(p))).alias("entropy"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    return names.join(one, "k", "left").select("column", zero("count", "long"), zero("distinct", "long"), zero("rare", "long"), "imbalance", zero("entropy", "double"))


def top_levels_of(df: DataFrame, columns: list[str], top: int = 20) -> dict[str, list[tuple[str, int]]]:
    """``top_levels`` of every column in one job."""
    first = _levels(df, columns).withColumn("at", F.row_number().over(W.partitionBy("k").orderBy(F.desc("n"), "value"))).filter(F.col("at") <= top)
    found: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in first.orderBy("k", "at").collect():
        found[columns[r["k"]]].append((r["value"], r["n"]))
    return found


# Names of steps up to so many seconds.
FREQUENCIES = ((1, "sub-second"), (60, "secondly"), (3600, "minutely"), (86_400, "hourly"), (7 * 86_400, "daily"), (28 * 86_400, "weekly"), (90 * 86_400, "monthly"), (365 * 86_400, "quarterly"))


def frequency(seconds: Column) -> Column:
    named = F.lit("yearly")
    for most, name in reversed(FREQUENCIES):
        named = F.when(seconds < most, name).otherwise(named)
    return F.when(seconds.isNotNull(), named)


def _gaps(df: DataFrame, column: str) -> DataFrame:
    """(gap): seconds between neighbouring distinct-or-equal times; lags run within days, and days are linked by their ends."""
    t = df.select(cell(df, column).time.alias("t")).filter("t is not null").select("t", F.to_date("t").alias("day"))
    within = t.select("t", "day", F.lag("t").over(W.partitionBy("day").orderBy("t")).alias("before"))
    ends = t.groupBy("day").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    links = ends.select(F.col("first").alias("t"), F.lag("last").over(W.orderBy("day")).alias("before"))
    inner = within.filter("before is not null").select("t", "before").unionByName(links.filter("before is not null"))
    return inner.select(((F.unix_micros("t") - F.unix_micros("before")) / 1e6).alias("gap"))


def datetime_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, min, max, span_days, median_gap (seconds), frequency, duplicates, gaps (over three median gaps)."""
    t = cell(df, column).time
    base = df.agg(F.count(t).alias("count"), F.min(t).alias("min"), F.max(t).alias("max"), (F.count(t) - F.countDistinct(t)).alias("duplicates"))
    gaps = _gaps(df, column)
    half = quantiles(gaps, {"gap": F.when(F.col("gap") > 0, F.col("gap"))}, [0.5])["gap"]
    middle = df.sparkSession.createDataFrame([(half[0] if half else None,)], "median_gap double")
    wide = gaps.crossJoin(F.broadcast(middle)).agg(F.count_if(F.col("gap") > 3 * F.col("median_gap")).alias("gaps"))  # one row
    days = (F.unix_micros("max") - F.unix_micros("min")) / 86_400e6
    return base.crossJoin(middle).crossJoin(wide).select(F.lit(column).alias("column"), "count", "min", "max", days.alias("span_days"), "median_gap", frequency(F.col("median_gap")).alias("frequency"), "duplicates", "gaps")


def period_counts(df: DataFrame, column: str, unit: str = "month", most: int = 60) -> DataFrame:
    """(period, n) of at most ``most`` first periods."""
    return df.select(F.date_trunc(unit, cell(df, column).time).alias("period")).filter("period is not null").groupBy("period").agg(F.count(F.lit(1)).alias("n")).orderBy("period").limit(most)


def text_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, min_length, max_length, mean_length, empty, blank (white space only), non_ascii."""
    each = []
    for c in columns:
        x = text(df, c)
        each.append(
            F.struct(
                F.lit(c).alias("column"), F.count(x).alias("count"), F.min(F.length(x)).alias("min_length"), F.max(F.length(x)).alias("max_length"), F.avg(F.length(x)).alias("mean_length"), F.count_if(x == "").alias("empty"),
                F.count_if((x != "") & (F.length(F.regexp_replace(x, r"\s+", "")) == 0)).alias("blank"), F.count_if(x.rlike("[^\\x00-\\x7F]")).alias("non_ascii"),
            )
        )
    return df.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def duplicate_rows(df: DataFrame) -> int:
    """Rows that repeat an earlier row in all columns that can be compared."""
    names = [f.name for f in df.schema if f.name != ROW and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.VariantType))]
    one = df.groupBy(*[F.col(f"`{c}`") for c in names]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()
    return one[0]


def levels_of(df: DataFrame, column: str) -> list[str]:
    """Declared order of an ordinal column, kept in its metadata."""
    return list(df.schema[column].metadata.get("levels", []))


def ordinal(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    return df.withMetadata(column, {**df.schema[column].metadata, "levels": list(levels)})


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct present values of every column, exactly, in one job: pairs of (column, value) are aggregated before they are shuffled.

    Values of up to eight bytes go by their 64-bit hash, which is one to one on them; others by their text.
    """
    short = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    pairs = []
    for k, c in enumerate(columns):
        x, kind = cell(df, c), df.schema[c].dataType
        if isinstance(kind, short):
            value = x.number if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(f"`{c}`")
            number_, text_ = F.xxhash64(value), F.lit(None).cast("string")
        else:
            number_, text_ = F.lit(None).cast("long"), x.text
        pairs.append(F.when(~x.missing, F.struct(F.lit(k).alias("k"), number_.alias("h"), text_.alias("s"))))
    each = df.select(F.explode(F.array(*pairs)).alias("p")).filter("p is not null").groupBy("p.k", "p.h", "p.s").agg(F.lit(1).alias("one"))
    # A present cell without a text (a nested null) is no value.
    counted = each.filter("h is not null or s is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = {columns[r["k"]]: r["n"] for r in counted.collect()}
    return {c: found.get(c, 0) for c in columns}


@dataclass
class ColumnProfile:
    name: str
    kind: str
    rows: int
    missing: int
    distinct: int
    forms: dict[str, int]
    summary: dict[str, Any] = field(default_factory=dict)
    top: list[tuple[str, int]] = field(default_factory=list)
    bins: list[tuple[float, float, int]] = field(default_factory=list)

    @property
    def present(self) -> int:
        return self.rows - self.missing

    @property
    def is_identifier_like(self) -> bool:
        return self.present > 10 and self.distinct / self.present > 0.95


@dataclass
class DatasetProfile:
    rows: int
    columns: dict[str, ColumnProfile]
    duplicates: int

    def to_dict(self) -> dict[str, Any]:
        return {"rows": self.rows, "duplicates": self.duplicates, "columns": {n: vars(c) | {"present": c.present, "identifier_like": c.is_identifier_like} for n, c in self.columns.items()}}


def classify(df: DataFrame, column: str, present: int, distinct: int, temporal: int, parsed: int, booleans: int) -> str:
    """Kind of a column from its counts, in a fixed order of decisions."""
    kind = df.schema[column].dataType
    if not present:
        return "empty"
    if isinstance(kind, UNSUPPORTED) and kind != MIXED:
        return "unsupported"
    if distinct <= 1:
        return "constant"
    if levels_of(df, column):
        return "ordinal"
    if booleans == present:
        return "boolean"
    if temporal >= 0.5 * present:
        return "datetime"
    if parsed >= 0.9 * present:
        return "numeric"
    return "categorical" if distinct <= max(20, 0.05 * present) else "text"


def profile(df: DataFrame, top: int = 20, histograms: bool = False) -> DatasetProfile:
    """Whole profile: three jobs for all columns, one more for each column with levels or a histogram.

    Distinct values are exact at every size; they are aggregated before they are shuffled.
    """
    rows = df.count()
    names = [c for c in df.columns if c != ROW]
    cells = {c: cell(df, c) for c in names}

    forms = ["int", "float", "numeric-string", "formatted-numeric-string", "bool", "datetime", "date", "string"]
    first = df.agg(
        *[F.struct(F.count_if(x.missing).alias("missing"), F.count(x.number).alias("parsed"), *[F.count_if(x.form == f).alias(f) for f in forms]).alias(f"c{k}") for k, (c, x) in enumerate(cells.items())],
    ).first()
    different = distinct_counts(df, names)
    found: dict[str, ColumnProfile] = {}
    for k, c in enumerate(names):
        one = first[f"c{k}"].asDict() | {"distinct": different[c]}
        present = rows - one["missing"]
        kind = classify(df, c, present, one["distinct"], one["datetime"] + one["date"], one["parsed"], one["bool"])
        found[c] = ColumnProfile(c, kind, rows, one["missing"], one["distinct"], {f: one[f] for f in forms if one[f]})
    of = lambda *kinds: [c for c in names if found[c].kind in kinds]
    if of("numeric"):
        for r in numeric_summary(df, of("numeric")).collect():
            found[r["column"]].summary = {k: v for k, v in r.asDict().items() if k != "column"}
    if of("text"):
        for r in text_summary(df, of("text")).collect():
            found[r["column"]].summary = {k: v for k, v in r.asDict().items() if k != "column"}
    if named := of("categorical", "ordinal", "boolean"):
        for r in categorical_summary(df, named).collect():
            found[r["column"]].summary = {k: v for k, v in r.asDict().items() if k != "column"}
        for c, levels in top_levels_of(df, named, top).items():
            found[c].top = levels
    for c in of("datetime"):
        found[c].summary = {k: v for k, v in datetime_summary(df, c).first().asDict().items() if k != "column"}
    for c in of("boolean"):
        found[c].summary["rate_true"] = dict(found[c].top).get("true", 0) / max(1, found[c].present)
    if histograms and of("numeric"):
        for c, made in histograms_of(df, of("numeric")).items():
            found[c].bins = made
    return DatasetProfile(rows, found, duplicate_rows(df))


@dataclass(frozen=True)
class Change:
    column: str
    metric: str
    before: float | None
    after: float | None

    @property
    def relative(self) -> float | None:
        return None if not self.before or self.after is None else (self.after - self.before) / abs(self.before)


def compare_profiles(before: DatasetProfile, after: DatasetProfile) -> tuple[list[Change], list[str]]:
    """(changes, red flags) of two profiles, columns matched by name."""
    changes, flags = [], []
    if before.rows and abs(after.rows - before.rows) / before.rows > 0.05:
        flags.append(f"rows changed from {before.rows} to {after.rows}")
    for name in sorted({*before.columns, *after.columns}):
        a, b = before.columns.get(name), after.columns.get(name)
        if a is None or b is None:
            flags.append(f"{name} {'appeared' if a is None else 'disappeared'}")
            continue
        changes += [Change(name, m, getattr(a, m), getattr(b, m)) for m in ("missing", "distinct") if getattr(a, m) != getattr(b, m)]
        if a.kind != b.kind:
            flags.append(f"{name} changed kind from {a.kind} to {b.kind}")
        if a.distinct and b.distinct <= a.distinct / 2:
            flags.append(f"{name} lost half of its distinct values")
        if a.kind == b.kind == "numeric":
            moved = {m: Change(name, m, a.summary[m], b.summary[m]) for m in ("mean", "std", "median", "min", "max", "skew")}
            changes += [c for c in moved.values() if c.before != c.after]
            if a.summary["std"] and b.summary["std"] is not None and (b.summary["std"] / a.summary["std"]) ** 2 < 0.9:
                flags.append(f"{name} lost over a tenth of its variance")
            if moved["mean"].relative is not None and abs(moved["mean"].relative) > 0.1:
                flags.append(f"{name} shifted its mean by over a tenth")
    return changes, flags
