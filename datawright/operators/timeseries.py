"""Time-series diagnosis: cadence, duplicates, order, missing periods, stale runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.cells import cell, text
from ..sources.frames import ROW
from .ordering import quantiles

# Named steps in seconds, longest first.
STEPS = (("yearly", 365 * 86_400), ("quarterly", 91 * 86_400), ("monthly", 30 * 86_400), ("weekly", 7 * 86_400), ("daily", 86_400), ("hourly", 3_600), ("minutely", 60), ("secondly", 1))


def _times(df: DataFrame, time: str) -> DataFrame:
    return df.select(cell(df, time).time.alias("t")).filter("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def _steps(df: DataFrame, time: str) -> DataFrame:
    """(gap): seconds between neighbouring distinct times. Within days by windows; days are joined at their ends."""
    t = _times(df, time).select("t", F.to_date("t").alias("day"))
    inner = t.select(F.col("t"), F.lag("t").over(W.partitionBy("day").orderBy("t")).alias("before"))
    ends = t.groupBy("day").agg(F.min("t").alias("t"), F.max("t").alias("last"))
    outer = ends.select("t", F.lag("last").over(W.orderBy("day")).alias("before"))
    return inner.unionByName(outer).filter("before is not null").select(((F.unix_micros("t") - F.unix_micros("before")) / 1e6).alias("gap"))


def cadence(df: DataFrame, time: str) -> DataFrame:
    """(median_gap, cadence, step, agreement): the longest named step of which the median gap is at least three quarters; the share of gaps within a quarter of it."""
    gaps = _steps(df, time)
    half = quantiles(gaps, {"gap": F.col("gap")}, [0.5])["gap"]
    middle = df.sparkSession.createDataFrame([(half[0] if half else None,)], "median_gap double")
    named = step = F.lit(None)
    for name, seconds in reversed(STEPS):
        fits = F.col("median_gap") >= 0.75 * seconds
        named, step = F.when(fits, name).otherwise(named), F.when(fits, float(seconds)).otherwise(step)
    one = middle.select("median_gap", named.alias("cadence"), step.cast("double").alias("step"))
    share = gaps.crossJoin(F.broadcast(one)).agg(F.avg((F.abs(F.col("gap") - F.col("step")) <= 0.25 * F.col("step")).cast("double")).alias("agreement"))  # one row
    return one.crossJoin(share)


def duplicate_times(df: DataFrame, time: str) -> DataFrame:
    """(rows, duplicates): rows with a time, and those that repeat one."""
    return _times(df, time).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def out_of_order(df: DataFrame, time: str, order: str = ROW, block: int = 100_000) -> DataFrame:
    """(out_of_order): rows whose time lies before that of the row before them in ``order`` (whole numbers); blocks of rows are compared in parallel and joined at their edges."""
    t = df.select(F.col(order).alias("o"), cell(df, time).time.alias("t")).filter("t is not null").withColumn("b", F.floor(F.col("o") / block))
    inner = t.select((F.col("t") < F.lag("t").over(W.partitionBy("b").orderBy("o"))).alias("back"))
    edges = t.groupBy("b").agg(F.min_by("t", "o").alias("first"), F.max_by("t", "o").alias("last"))
    outer = edges.select((F.col("first") < F.lag("last").over(W.orderBy("b"))).alias("back"))
    return inner.unionByName(outer).agg(F.count_if("back").alias("out_of_order"))


def missing_periods(df: DataFrame, time: str, step: float) -> DataFrame:
    """(period): grid points from the first time in fixed steps (seconds) that no row has."""
    seen = _times(df, time)
    ends = seen.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    micros = int(step * 1_000_000)
    grid = ends.filter("lo is not null").select(F.explode(F.sequence(F.unix_micros("lo"), F.unix_micros("hi"), F.lit(micros))).alias("m")).select(F.timestamp_micros("m").alias("period"))
    return grid.join(seen.select(F.col("t").alias("period")), "period", "left_anti")


def stale_runs(df: DataFrame, time: str, column: str, minimum: int, order: str = ROW, by: list[str] | None = None) -> DataFrame:
    """(by, start, end, n, value): runs of equal present values in time order of at least ``minimum`` rows. Give ``by`` on large tables: a series is a window."""
    keys = by or []
    t = df.select(*keys, F.col(order).alias("o"), cell(df, time).time.alias("t"), text(df, column).alias("value")).filter("t is not null")
    series = W.partitionBy(*(keys or [F.lit(0)])).orderBy("t", "o")
    changed = t.withColumn("new", (~F.col("value").eqNullSafe(F.lag("value").over(series))).cast("int"))
    runs = changed.withColumn("run", F.sum("new").over(series.rowsBetween(W.unboundedPreceding, 0)))
    return runs.filter("value is not null").groupBy(*keys, "run", "value").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum).select(*keys, "start", "end", "n", "value")


@dataclass
class TimeSeriesReport:
    rows: int
    duplicates: int
    out_of_order: int
    cadence: str | None
    step: float | None
    agreement: float | None
    missing: int
    stale: dict[str, int]
    mixed_timezones: bool = False

    @property
    def coverage(self) -> float:
        distinct = self.rows - self.duplicates
        return distinct / (self.missing + distinct) if self.missing + distinct else 1.0


def timeseries(df: DataFrame, time: str, watch: list[str] | None = None, stale_after: int = 0, order: str = ROW) -> TimeSeriesReport:
    """The whole diagnosis; columns in ``watch`` are searched for stale runs of ``stale_after`` rows, or a tenth of the rows but at least 5."""
    d, c = duplicate_times(df, time).first(), cadence(df, time).first()
    missing = missing_periods(df, time, c["step"]).count() if c["step"] else 0
    minimum = stale_after or max(5, d["rows"] // 10)
    stale = {w: stale_runs(df, time, w, minimum, order).count() for w in watch or []}
    return TimeSeriesReport(d["rows"], d["duplicates"], out_of_order(df, time, order).first()[0], c["cadence"], c["step"], c["agreement"], missing, stale)
