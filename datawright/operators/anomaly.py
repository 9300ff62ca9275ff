"""Anomalies: joint outliers by Mahalanobis distance, contextual ones by group medians."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import number, text
from ..sources.frames import ROW
from .statistics import chi2_quantile

TOP, LEVEL, THRESHOLD, LEAST = 50, 0.999, 4.0, 12


def joint(df: DataFrame, columns: list[str], key: str = ROW, level: float = LEVEL, top: int = TOP) -> DataFrame:
    """(key, d2, columns): the ``top`` rows beyond the chi-square quantile, with their two most extreme columns; none with under 5 complete rows a column.

    One aggregate gives means and sample covariances; their pseudo-inverse makes the distance a polynomial.
    """
    complete = df.select(key, *[number(df, c).alias(f"x{k}") for k, c in enumerate(columns)]).dropna(subset=[f"x{k}" for k in range(len(columns))])
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    one = complete.agg(F.count(F.lit(1)), *[F.avg(f"x{k}") for k in range(d)], *[F.covar_samp(f"x{i}", f"x{j}") for i, j in pairs]).first()
    if one[0] < 5 * d:
        return complete.select(key, F.lit(0.0).alias("d2"), F.array().cast("array<string>").alias("columns")).limit(0)
    mean, cov = [float(v) for v in one[1 : 1 + d]], np.zeros((d, d))
    for (i, j), v in zip(pairs, one[1 + d :], strict=True):
        cov[i, j] = cov[j, i] = v
    inverse = np.linalg.pinv(cov)
    off = [F.col(f"x{k}") - F.lit(mean[k]) for k in range(d)]
    d2 = sum((off[i] * off[j] * F.lit(float(inverse[i, j]) * (1 if i == j else 2)) for i, j in pairs), F.lit(0.0))
    z = F.array_sort(F.array(*[F.struct((-F.abs(off[k]) / F.lit(float(np.sqrt(cov[k, k])) or 1.0)).alias("z"), F.lit(columns[k]).alias("c")) for k in range(d)]))
    scored = complete.select(key, d2.alias("d2"), F.transform(F.slice(z, 1, 2), lambda s: s["c"]).alias("columns"))
    return scored.filter(F.col("d2") > chi2_quantile(level, d)).orderBy(F.desc("d2"), key).limit(top)


def contextual(df: DataFrame, value: str, by: str, key: str = ROW, threshold: float = THRESHOLD, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(key, group, value, score): rows over ``threshold`` scaled median absolute deviations off their group's median. Groups under ``least`` or without spread are left out."""
    base = df.select(key, text(df, by).alias("group"), number(df, value).alias("value")).filter("group is not null and value is not null")
    centre = base.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("centre")).filter(F.col("n") >= least)
    off = base.join(centre, "group").withColumn("off", F.abs(F.col("value") - F.col("centre")))
    spread = off.groupBy("group").agg((F.median("off") * 1.4826).alias("spread")).filter("spread > 0")
    scored = off.join(spread, "group").select(key, "group", "value", (F.col("off") / F.col("spread")).alias("score"))
    return scored.filter(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(top)


def small_groups(df: DataFrame, value: str, by: str, least: int = LEAST) -> DataFrame:
    """(groups): how many groups have too few values to judge."""
    base = df.select(text(df, by).alias("group"), number(df, value).alias("value")).filter("group is not null and value is not null")
    return base.groupBy("group").count().agg(F.count_if(F.col("count") < least).alias("groups"))
