"""Cumulative sums in the order of a value, without putting all rows into one task; exact quantiles.

Values are counted first; bounded split points cut them into ordered buckets, bucket sums are added up in a table of at most
``SPLITS + 1`` rows, and the running sums within buckets do the rest. Quantiles are narrowed down by sketches and read off exactly.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SPLITS = 64
#: Values of a sample, and about as many that are gathered to read order statistics off.
SAMPLED, GATHERED = 40_000, 50_000


def place(name: str, edges: list) -> Column:
    """How many of the ascending ``edges`` are at or below the column's value: a balanced tree of comparisons, as deep as their logarithm."""

    def literal(e) -> str:  # noqa: ANN001
        if isinstance(e, float):
            return f"{e!r}D" if math.isfinite(e) else f"CAST('{e}' AS DOUBLE)"
        return str(e) if isinstance(e, int) else f"CAST('{e}' AS TIMESTAMP)"

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        at = (lo + hi) // 2
        return f"CASE WHEN `{name}` < {literal(edges[at])} THEN {tree(lo, at)} ELSE {tree(at + 1, hi)} END"

    return F.expr(tree(0, len(edges)))


def cumulative(counted: DataFrame, key: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """``counted`` (one row for each ``by`` and ``key``) with ``cum_<s>``: the sums of all keys up to its own."""
    by = by or []
    splits = counted.agg(F.percentile_approx(key, [i / SPLITS for i in range(1, SPLITS)], 1000)).first()[0] or []
    cut = counted.withColumn("__bucket", place(key, sorted(set(splits))))
    ahead = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "__bucket").agg(*[F.sum(s).alias(s) for s in sums])
    starts = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__b"), *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(f"__start_{s}") for s in sums])
    upto = W.partitionBy(*by, "__bucket").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    on = (F.col("__bucket") == F.col("__b"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return cut.join(starts, on).select(*counted.columns, *[(F.col(f"__start_{s}") + F.sum(s).over(upto)).alias(f"cum_{s}") for s in sums])


def _interpolated(low: float, high: float, share: float) -> float:
    return low if low == high or not share else low + (high - low) * share


def quantiles(df: DataFrame, columns: Mapping[str, Column], probabilities: list[float]) -> dict[str, list[float] | None]:
    """Exact linearly interpolated quantiles of numeric expressions, nulls left out; None for one without values.

    A bounded random sample of all columns brackets each order statistic; each further pass samples inside the brackets, until about
    ``GATHERED`` values lie inside. A last grouped count has one row for each stretch between brackets and one for each distinct value inside: from these the order
    statistics are read off, so they are exact whatever the sample; if one lies outside its bracket, it is looked for anew. Up to 10^6 rows one sample is
    enough, whatever the number of columns; each further one divides the rows by about 20.
    """
    missed = dict.fromkeys(columns, probabilities)
    found: dict[str, dict[float, float] | None] = {c: {} for c in columns}
    while missed:
        for c, at in _bracketed(df, {c: columns[c] for c in missed}, probabilities).items():
            found[c] = None if at is None else found[c] | at
        missed = {c: probabilities for c in missed if found[c] is not None and any(p not in found[c] for p in probabilities)}
    return {c: None if at is None else [at[p] for p in probabilities] for c, at in found.items()}


def _bracketed(df: DataFrame, columns: Mapping[str, Column], probabilities: list[float]) -> dict[str, dict[float, float] | None]:
    """One attempt of ``quantiles``: those that lie inside their brackets."""
    names = list(columns)
    picked = df.select(*[columns[c].cast("double").alias(f"q{k}") for k, c in enumerate(names)])
    ends = picked.agg(*[F.struct(F.count(f"q{k}").alias("n"), F.min(f"q{k}").alias("lo"), F.max(f"q{k}").alias("hi")).alias(f"q{k}") for k in range(len(names))]).first()
    each = picked.select(F.posexplode(F.array(*picked.columns)).alias("k", "x")).filter("x is not null")
    # (column, probability): bracket, and about how many values lie inside.
    brackets = {(k, p): (ends[k]["lo"], ends[k]["hi"], ends[k]["n"]) for k in range(len(names)) for p in probabilities if ends[k]["n"]}
    inside = lambda k, a, b: F.when((F.col(f"q{k}") > a) & (F.col(f"q{k}") < b), F.col(f"q{k}"))
    while True:
        wide: dict[tuple[int, float, float], list[float]] = {}
        for (k, p), (a, b, many) in brackets.items():
            if many > GATHERED and a < b:
                wide.setdefault((k, a, b), []).append(p)
        if not wide:
            break
        # The first brackets, from end to end, hold all but the ends themselves.
        first = all(a == ends[k]["lo"] and b == ends[k]["hi"] for k, a, b in wide)
        seen = [(0, ends[k]["n"]) for k, _, _ in wide] if first else [tuple(r) for r in picked.agg(*[F.struct(F.count_if(F.col(f"q{k}") <= a), F.count(inside(k, a, b))) for k, a, b in wide]).first()]
        rates = [(j, k, float("-inf") if first else a, float("inf") if first else b, SAMPLED / max(1, m)) for j, ((_, m), (k, a, b)) in enumerate(zip(seen, wide, strict=True))]
        drawn: dict[int, list[float]] = {}
        # One row a bracket on the right; about SAMPLED values a bracket come back.
        met = each.join(F.broadcast(df.sparkSession.createDataFrame(rates, "j int, k int, a double, b double, rate double")), "k").filter((F.col("x") > F.col("a")) & (F.col("x") < F.col("b")) & (F.rand() < F.col("rate")))
        for r in met.groupBy("j").agg(F.sort_array(F.collect_list("x")).alias("xs")).toArrow().to_pylist():
            drawn[r["j"]] = r["xs"]
        for j, ((before, m), ((k, a, b), ps)) in enumerate(zip(seen, wide.items(), strict=True)):
            sample = drawn.get(j, [])
            for p in ps:
                share = min(1.0, max(0.0, ((ends[k]["n"] - 1) * p - before) / max(1, m)))
                margin = 5 * math.sqrt(len(sample) * share * (1 - share)) + 5
                lo, hi = math.floor(share * len(sample) - margin), math.ceil(share * len(sample) + margin)
                low, high = sample[lo] if lo >= 0 else a, sample[hi] if hi < len(sample) else b
                brackets[k, p] = (low, high, min(m - 1, int(m * 2 * margin / max(1, len(sample)))))
    edges = {k: sorted({e for (j, _), (a, b, _) in brackets.items() if j == k for e in (a, b)}) for k in range(len(names)) if ends[k]["n"]}
    counts: dict[int, list[tuple[int, float | None, int]]] = {k: [] for k in edges}
    if edges:
        most = max(map(len, edges.values()))
        cuts = []
        for k, e in edges.items():
            inner = {j for (i, _), (a, b, _) in brackets.items() if i == k for j in range(e.index(a) + 1, e.index(b) + 1)}
            cuts.append((k, e + [float("nan")] * (most - len(e)), [j in inner for j in range(most + 1)]))
        met = each.join(F.broadcast(df.sparkSession.createDataFrame(cuts, "k int, edges array<double>, open array<boolean>")), "k")  # one row a column
        # Even codes are stretches between edges, odd ones the edges themselves.
        code = F.lit(0)
        for j in range(most):
            code = code + (F.col("x") >= F.col("edges")[j]).cast("int") + (F.col("x") > F.col("edges")[j]).cast("int")
        met = met.select("k", "x", "open", code.alias("code"))
        value = F.when((F.col("code") % 2 == 0) & F.get("open", F.floor(F.col("code") / 2).cast("int")), F.col("x"))
        grouped = met.select("k", "code", value.alias("x")).groupBy("k", "code", "x").agg(F.count(F.lit(1)).alias("n")).toArrow()
        for k, *row in zip(*(grouped.column(c).to_pylist() for c in ("k", "code", "x", "n")), strict=True):
            counts[k].append(tuple(row))
    found: dict[str, dict[float, float] | None] = {c: {} if ends[k]["n"] else None for k, c in enumerate(names)}
    for k, rows in counts.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0.0))
        upto = list(itertools.accumulate(r[2] for r in rows))
        for p in probabilities:
            h = (ends[k]["n"] - 1) * p
            values = []
            for rank in (math.floor(h), math.ceil(h)):
                code, x, _ = rows[bisect.bisect_right(upto, rank)]
                values.append(edges[k][code // 2] if code % 2 else x)
            if None not in values:
                found[names[k]][p] = _interpolated(*values, h - math.floor(h))
    return found


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the mean rank of each distinct value of the column, from 1."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(counted, column, ["n"]).select(column, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias(name))
