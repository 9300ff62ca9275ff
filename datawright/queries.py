"""Registered queries over the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells
from .operators import anomaly, association, charts, drift, linkage, mechanism, panel, preprocess, privacy, profile, timeseries
from .plans.state import Clause, ViewState
from .plans.validate import ValidationPlan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers ``f(table)``, where ``table(name)`` reads a table."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, as in the SQL; negative zero becomes zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _holes(t: Callable[[str], DataFrame]) -> DataFrame:
    """lineitem with missing cells that follow from its keys."""
    d = t("lineitem")
    return d.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("qty"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_discount") + 0.0).alias("disc"),
        F.when(~((F.col("l_partkey") % 7 == 0) & (F.col("l_suppkey") % 3 == 0)), F.col("l_returnflag")).alias("flag"), "l_linestatus",
    )


HOLES = "(SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS qty, CASE WHEN l_suppkey % 5 <> 0 THEN l_discount + 0.0 END AS disc, CASE WHEN NOT (l_partkey % 7 = 0 AND l_suppkey % 3 = 0) THEN l_returnflag END AS flag, l_linestatus FROM lineitem)"


# Validation ---------------------------------------------------------------------------------------------


def lineitem_plan() -> ValidationPlan:
    return (
        ValidationPlan().not_null("l_orderkey").unique_together("l_orderkey", "l_linenumber").between("l_discount", 0, 0.05).between("l_quantity", 1, 50).isin("l_returnflag", ["A", "R"]).matches("l_linestatus", "[OF]")
        .custom("l_extendedprice > 1000", "price_over_1000").implies("l_returnflag == 'N'", "l_linestatus == 'O'", "returned_are_open")
    )


def _graded(parts: list[tuple[str, str]]) -> str:
    union = " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS evaluated, {c} AS failed FROM lineitem" for n, c in parts)
    return f"SELECT rule, evaluated, failed, round(failed / evaluated, 6) AS failure_rate, CASE WHEN failed = 0 THEN 'PASS' WHEN failed / evaluated >= 0.25 THEN 'CRITICAL' WHEN failed / evaluated >= 0.05 THEN 'ERROR' ELSE 'WARNING' END AS outcome FROM ({union})"


_RULES = [
    ("not_null(l_orderkey)", "count(*) FILTER (l_orderkey IS NULL)"), ("unique_together(l_orderkey, l_linenumber)", "(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))"),
    ("between(l_discount, 0, 0.05)", "count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.05))"), ("between(l_quantity, 1, 50)", "count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 50))"), ("isin(l_returnflag)", "count(*) FILTER (l_returnflag NOT IN ('A', 'R'))"),
    ("matches(l_linestatus)", "count(*) FILTER (NOT regexp_matches(l_linestatus, '^(?:[OF])'))"), ("price_over_1000", "count(*) FILTER (NOT (l_extendedprice > 1000))"), ("returned_are_open", "count(*) FILTER (NOT (NOT l_returnflag = 'N' OR l_linestatus = 'O'))"),
]


@query("validate_lineitem", _graded(_RULES))
def _(t):  # noqa: ANN001, ANN202
    return r6(lineitem_plan().run(t("lineitem")).table())


@query("validate_split", "SELECT ok, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AND l_discount BETWEEN 0 AND 0.05 AND l_quantity BETWEEN 1 AND 50 AND l_returnflag IN ('A', 'R') AND regexp_matches(l_linestatus, '^[OF]') AND l_extendedprice > 1000 AND (l_returnflag <> 'N' OR l_linestatus = 'O') AS ok FROM lineitem) GROUP BY ok")
def _(t):  # noqa: ANN001, ANN202
    return lineitem_plan().marked(t("lineitem")).groupBy(F.col("__ok").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


# Profile ------------------------------------------------------------------------------------------------

_NUM = """SELECT '{c}' AS "column", count({c}) AS count, {r}, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, 0::BIGINT AS infinities,
  (SELECT count(*) FROM {t}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t}) WHERE b > a AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))) AS outliers FROM {t}"""
_MOMENTS = 'round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) + 0.0 AS "min", round(quantile_cont({c}, 0.25), 6) + 0.0 AS q1, round(quantile_cont({c}, 0.5), 6) + 0.0 AS median, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q3, round(max({c}), 6) + 0.0 AS "max", round(skewness({c}), 6) + 0.0 AS skew, round(kurtosis({c}), 6) + 0.0 AS kurtosis'


def _numeric_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(_NUM.format(c=c, t=table, r=_MOMENTS.format(c=c)) for c in columns)


@query("profile_numeric", _numeric_sql("lineitem", ["l_quantity", "l_extendedprice", "l_tax"]))
def _(t):  # noqa: ANN001, ANN202
    return r6(profile.numeric_summary(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("profile_numeric_orders", _numeric_sql("orders", ["o_totalprice"]))
def _(t):  # noqa: ANN001, ANN202
    return r6(profile.numeric_summary(t("orders"), ["o_totalprice"]))


@query(
    "profile_histogram",
    "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), g AS (SELECT k AS bin, lo + (hi - lo) * k / 20 AS low, CASE WHEN k = 19 THEN hi ELSE lo + (hi - lo) * (k + 1) / 20 END AS high FROM e, (SELECT unnest(range(20)) AS k)) "
    "SELECT g.bin::INT AS bin, round(low, 6) AS low, round(high, 6) AS high, count(l_extendedprice) AS n FROM g LEFT JOIN lineitem ON l_extendedprice >= low AND (l_extendedprice < high OR bin = 19) GROUP BY ALL",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(profile.histogram(t("lineitem"), "l_extendedprice"))


@query("profile_ecdf", "WITH o AS (SELECT o_totalprice AS value, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT round(value, 6) AS value, round((i + 1) / n, 6) AS share FROM o WHERE i % greatest(1, n // 200) = 0")
def _(t):  # noqa: ANN001, ANN202
    return r6(profile.ecdf(t("orders"), "o_totalprice"))


def _cat_sql(table: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", sum(n)::BIGINT AS count, count(*) AS \"distinct\", count(*) FILTER (n / total < 0.01) AS rare, round(max(n / total), 6) AS imbalance, round(-sum(n / total * log2(n / total)), 6) + 0.0 AS entropy FROM (SELECT {c}, count(*) AS n, sum(count(*)) OVER () AS total FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})"


@query("profile_categorical", " UNION ALL ".join(_cat_sql("orders", c) for c in ("o_orderstatus", "o_orderpriority")))
def _(t):  # noqa: ANN001, ANN202
    return r6(profile.categorical_summary(t("orders"), ["o_orderstatus", "o_orderpriority"]))


@query("profile_categorical_documents", " UNION ALL ".join(_cat_sql("documents", c) for c in ("lang", "source")))
def _(t):  # noqa: ANN001, ANN202
    return r6(profile.categorical_summary(t("documents"), ["lang", "source"]))


@query("profile_top_levels", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 20")
def _(t):  # noqa: ANN001, ANN202
    return profile.top_levels(t("part"), "p_brand")


@query(
    "profile_datetime",
    "WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1e6 AS gap FROM events), m AS (SELECT median(gap) FILTER (gap > 0) AS mg FROM g) "
    "SELECT 'ts' AS \"column\", (SELECT count(*) FROM events) AS count, (SELECT min(ts) FROM events) AS \"min\", (SELECT max(ts) FROM events) AS \"max\", round((SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 FROM events), 6) AS span_days, round(mg, 6) AS median_gap, "
    "CASE WHEN mg < 1 THEN 'sub-second' WHEN mg < 60 THEN 'secondly' WHEN mg < 3600 THEN 'minutely' WHEN mg < 86400 THEN 'hourly' WHEN mg < 604800 THEN 'daily' WHEN mg < 2419200 THEN 'weekly' WHEN mg < 7776000 THEN 'monthly' WHEN mg < 31536000 THEN 'quarterly' ELSE 'yearly' END AS frequency, "
    "(SELECT count(*) - count(DISTINCT ts) FROM events) AS duplicates, (SELECT count(*) FROM g, m WHERE gap > 3 * mg) AS gaps FROM m",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(profile.datetime_summary(t("events"), "ts"))


@query("profile_periods", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 60")
def _(t):  # noqa: ANN001, ANN202
    return profile.period_counts(t("orders"), "o_orderdate")


def _text_sql(table: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c}) AS count, min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length, round(avg(length({c})), 6) AS mean_length, count(*) FILTER ({c} = '') AS empty, count(*) FILTER ({c} <> '' AND regexp_replace({c}, '\\s+', '', 'g') = '') AS blank, count(*) FILTER (regexp_matches({c}, '[^\\x00-\\x7F]')) AS non_ascii FROM {table}"


@query("profile_text", _text_sql("documents", "text") + " UNION ALL " + _text_sql("documents", "source"))
def _(t):  # noqa: ANN001, ANN202
    return r6(profile.text_summary(t("documents"), ["text", "source"]))


@query("profile_text_pages", _text_sql("pages", "url"))
def _(t):  # noqa: ANN001, ANN202
    return r6(profile.text_summary(t("pages"), ["url"]))


@query("duplicate_rows", "SELECT (count(*) - count(DISTINCT text))::BIGINT AS duplicates FROM documents")
def _(t):  # noqa: ANN001, ANN202
    d = t("documents").select("text")
    return d.groupBy("text").count().agg(F.sum(F.col("count") - 1).alias("duplicates"))


@query("duplicate_identifiers", "SELECT versions = 1 AS exact, count(*) AS keys, sum(n)::BIGINT AS rows FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag || '|' || l_linestatus) AS versions FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    d = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.concat_ws("|", "l_returnflag", "l_linestatus")).alias("versions")).filter("n > 1")
    return d.groupBy((F.col("versions") == 1).alias("exact")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"))


# Associations and missing cells -------------------------------------------------------------------------


@query("assoc_pearson", f"SELECT round(corr(qty, l_extendedprice), 6) AS value, count(*) AS n FROM {HOLES} WHERE qty IS NOT NULL")
def _(t):  # noqa: ANN001, ANN202
    return r6(association.correlation(_holes(t), "qty", "l_extendedprice", "pearson"))


@query(
    "assoc_spearman",
    f"WITH p AS (SELECT qty AS x, l_extendedprice AS y FROM {HOLES} WHERE qty IS NOT NULL), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p) SELECT round(corr(rx, ry), 6) AS value, count(*) AS n FROM k",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(association.correlation(_holes(t), "qty", "l_extendedprice", "spearman"))


@query(
    "assoc_kendall",
    "WITH c AS (SELECT p_size AS x, (p_partkey % 13)::DOUBLE AS y, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS score FROM c a, c b), "
    "m AS (SELECT sum(n) AS n FROM c), tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY y)) "
    "SELECT round(score / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS value, n::BIGINT AS n FROM s, m, tx, ty",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(association.correlation(t("part").withColumn("k", (F.col("p_partkey") % 13).cast("double")), "p_size", "k", "kendall"))


@query(
    "assoc_cramers_v",
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c), "
    "k AS (SELECT sum(n) AS n, sum(n * n / (na * nb)) - 1 AS phi, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM m) SELECT round(sqrt(greatest(0, phi - (r - 1) * (c - 1) / (n - 1)) / (least(r - (r - 1) * (r - 1) / (n - 1), c - (c - 1) * (c - 1) / (n - 1)) - 1)), 6) AS value, n::BIGINT AS n FROM k",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(association.cramers_v(t("lineitem"), "l_returnflag", "l_linestatus"))


@query("assoc_correlation_ratio", "WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), a AS (SELECT avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS total, count(*) AS n FROM orders) SELECT round(sqrt(sum(g.n * (g.m - a.m) * (g.m - a.m)) / any_value(a.total)), 6) AS value, any_value(a.n) AS n FROM g, a")
def _(t):  # noqa: ANN001, ANN202
    return r6(association.correlation_ratio(t("orders"), "o_orderpriority", "o_totalprice"))


@query("missing_by_column", f"SELECT c AS \"column\", m AS missing, round(m / n, 6) AS rate FROM (SELECT count(*) AS n, count(*) FILTER (qty IS NULL) AS a, count(*) FILTER (disc IS NULL) AS b, count(*) FILTER (flag IS NULL) AS d FROM {HOLES}) x, LATERAL (VALUES ('qty', x.a), ('disc', x.b), ('flag', x.d)) AS v(c, m)")
def _(t):  # noqa: ANN001, ANN202
    return r6(association.missing_by_column(_holes(t), ["qty", "disc", "flag"]))


@query("missing_rows", f"SELECT count(*) AS rows, count(*) FILTER (qty IS NOT NULL AND disc IS NOT NULL AND flag IS NOT NULL) AS complete, count(*) FILTER (qty IS NULL OR disc IS NULL OR flag IS NULL) AS any_missing FROM {HOLES}")
def _(t):  # noqa: ANN001, ANN202
    return association.missing_rows(_holes(t), ["qty", "disc", "flag"])


@query("missing_co_jaccard", f"SELECT * FROM (SELECT 'qty' AS \"left\", 'flag' AS \"right\", count(*) FILTER (qty IS NULL AND flag IS NULL) AS both, round(count(*) FILTER (qty IS NULL AND flag IS NULL) / count(*) FILTER (qty IS NULL OR flag IS NULL), 6) AS jaccard FROM {HOLES} UNION ALL SELECT 'qty', 'disc', count(*) FILTER (qty IS NULL AND disc IS NULL), round(count(*) FILTER (qty IS NULL AND disc IS NULL) / count(*) FILTER (qty IS NULL OR disc IS NULL), 6) FROM {HOLES} UNION ALL SELECT 'disc', 'flag', count(*) FILTER (disc IS NULL AND flag IS NULL), round(count(*) FILTER (disc IS NULL AND flag IS NULL) / count(*) FILTER (disc IS NULL OR flag IS NULL), 6) FROM {HOLES}) WHERE jaccard > 0.3")
def _(t):  # noqa: ANN001, ANN202
    return r6(association.co_missing(_holes(t), ["qty", "disc", "flag"]))


@query("missing_patterns", f"SELECT (qty IS NULL)::INT::VARCHAR || (disc IS NULL)::INT::VARCHAR || (flag IS NULL)::INT::VARCHAR AS pattern, count(*) AS n FROM {HOLES} GROUP BY 1 ORDER BY n DESC, pattern LIMIT 12")
def _(t):  # noqa: ANN001, ANN202
    return association.missing_patterns(_holes(t), ["qty", "disc", "flag"])


@query("mechanism_mwu", f"WITH p AS (SELECT l_extendedprice AS x, qty IS NULL AS gap, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS r, count(*) OVER (PARTITION BY l_extendedprice) AS t FROM {HOLES}) SELECT round(sum(r) FILTER (gap) - count(*) FILTER (gap) * (count(*) FILTER (gap) + 1) / 2, 6) AS u, count(*) FILTER (gap) AS n_absent, count(*) FILTER (NOT gap) AS n_present, round(sum(t::DOUBLE * t - 1), 6) AS ties FROM p")
def _(t):  # noqa: ANN001, ANN202
    return r6(mechanism.mwu(_holes(t), "qty", "l_extendedprice"))


@query(
    "mechanism_chi2",
    f"WITH c AS (SELECT l_linestatus AS g, (count(*) FILTER (qty IS NULL))::DOUBLE AS a, (count(*) FILTER (qty IS NOT NULL))::DOUBLE AS p FROM {HOLES} GROUP BY 1 HAVING count(*) >= 8), t AS (SELECT sum(a) AS na, sum(p) AS np, count(*) AS levels FROM c), "
    "e AS (SELECT *, (a + p) * na / (na + np) AS ea, (a + p) * np / (na + np) AS ep, CASE WHEN levels = 2 THEN 0.5 ELSE 0 END AS y FROM c, t) SELECT round(sum(pow(greatest(0, abs(a - ea) - y), 2) / ea + pow(greatest(0, abs(p - ep) - y), 2) / ep), 6) AS chi2, max(levels) AS levels, min(least(a, p)) AS least FROM e",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(mechanism.chi2(_holes(t), "qty", "l_linestatus"))


# Anomalies and drift ------------------------------------------------------------------------------------


@query(
    "anomaly_mahalanobis",
    "WITH p AS (SELECT o_orderkey, o_totalprice AS x, (epoch_us(o_orderdate) // 86400000000 % 365)::DOUBLE AS y FROM orders), m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS d FROM p), "
    "s AS (SELECT o_orderkey, (d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b) AS d2 FROM p, m) SELECT o_orderkey, round(d2, 6) AS d2 FROM s WHERE d2 > 2 ORDER BY d2 DESC, o_orderkey LIMIT 50",
)
def _(t):  # noqa: ANN001, ANN202
    d = t("orders").withColumn("day", (F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000) % 365).cast("double"))
    level = 1 - 0.36787944117144233  # the chi-square quantile of 2 degrees is then 2
    return r6(anomaly.joint(d, ["o_totalprice", "day"], "o_orderkey", level).select("o_orderkey", "d2"))


@query(
    "anomaly_contextual",
    "WITH c AS (SELECT o_orderpriority AS g, median(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12), s AS (SELECT g, 1.4826 * median(abs(o_totalprice - m)) AS s FROM orders JOIN c ON g = o_orderpriority GROUP BY g HAVING median(abs(o_totalprice - m)) > 0) "
    "SELECT o_orderkey, c.g AS \"group\", round(o_totalprice, 6) AS value, round(abs(o_totalprice - m) / s, 6) AS score FROM orders JOIN c ON c.g = o_orderpriority JOIN s ON s.g = c.g WHERE abs(o_totalprice - m) / s >= 1.2 ORDER BY abs(o_totalprice - m) / s DESC, o_orderkey LIMIT 50",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(anomaly.contextual(t("orders"), "o_totalprice", "o_orderpriority", "o_orderkey", threshold=1.2))


@query("anomaly_small_groups", "SELECT count(*) FILTER (n < 12) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def _(t):  # noqa: ANN001, ANN202
    return anomaly.small_groups(t("orders"), "o_totalprice", "o_custkey")


def _split(t: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    d = t("orders")
    return d.filter("o_orderkey % 2 = 0"), d.filter("o_orderkey % 2 = 1 AND o_totalprice > 100000")


_SIDES = "a AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1 AND o_totalprice > 100000)"


@query(
    "drift_psi",
    f"WITH {_SIDES}, q AS (SELECT DISTINCT unnest(quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM a), u AS (SELECT o_totalprice AS x, 1 AS s FROM a UNION ALL SELECT o_totalprice, 0 FROM b), n AS (SELECT (SELECT count(*) FROM q WHERE e <= x) AS bin, s FROM u), "
    "c AS (SELECT bin, greatest(1e-6, count(*) FILTER (s = 1) / (SELECT count(*) FROM a)) AS r, greatest(1e-6, count(*) FILTER (s = 0) / (SELECT count(*) FROM b)) AS c FROM n GROUP BY bin) SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM c",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(drift.psi(*_split(t), "o_totalprice"))


@query("drift_ks", f"WITH {_SIDES}, u AS (SELECT o_totalprice AS x, 1 AS r, 0 AS c FROM a UNION ALL SELECT o_totalprice, 0, 1 FROM b), g AS (SELECT x, sum(r) AS r, sum(c) AS c FROM u GROUP BY x), k AS (SELECT sum(r) OVER (ORDER BY x) / (SELECT count(*) FROM a) AS fr, sum(c) OVER (ORDER BY x) / (SELECT count(*) FROM b) AS fc FROM g) SELECT round(max(abs(fr - fc)), 6) AS ks FROM k")
def _(t):  # noqa: ANN001, ANN202
    return r6(drift.ks(*_split(t), "o_totalprice"))


@query("drift_jsd", f"WITH {_SIDES}, r AS (SELECT o_orderpriority AS x, count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY 1), c AS (SELECT o_orderpriority AS x, count(*) / (SELECT count(*) FROM b) AS q FROM b GROUP BY 1), j AS (SELECT coalesce(p, 0) + 1e-12 AS p, coalesce(q, 0) + 1e-12 AS q FROM r FULL JOIN c USING (x)) SELECT round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 6) AS jsd FROM j")
def _(t):  # noqa: ANN001, ANN202
    return r6(drift.jensen_shannon(*_split(t), "o_orderpriority"))


@query("drift_new_levels", f"WITH {_SIDES} SELECT DISTINCT o_custkey::VARCHAR AS level FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)")
def _(t):  # noqa: ANN001, ANN202
    return drift.new_levels(*_split(t), "o_custkey")


@query("drift_missing", f"SELECT round(avg((qty IS NULL)::INT) FILTER (l_orderkey % 2 = 0), 6) AS reference_rate, round(avg((qty IS NULL)::INT) FILTER (l_orderkey % 2 = 1), 6) AS current_rate, round(avg((qty IS NULL)::INT) FILTER (l_orderkey % 2 = 1) - avg((qty IS NULL)::INT) FILTER (l_orderkey % 2 = 0), 6) AS change FROM {HOLES}")
def _(t):  # noqa: ANN001, ANN202
    d = _holes(t)
    return r6(drift.missing_drift(d.filter("l_orderkey % 2 = 0"), d.filter("l_orderkey % 2 = 1"), "qty"))


# Time series and panels ---------------------------------------------------------------------------------

_GAPS = "g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1e6 AS gap FROM (SELECT DISTINCT ts FROM events))"


@query(
    "ts_cadence",
    f"WITH {_GAPS}, m AS (SELECT median(gap) AS mg FROM g), s AS (SELECT mg, (SELECT max(v) FROM (VALUES (1.0), (60.0), (3600.0), (86400.0), (604800.0), (2592000.0), (7862400.0), (31536000.0)) AS x(v) WHERE mg >= 0.75 * v)::DOUBLE AS step FROM m) "
    "SELECT round(mg, 6) AS median_gap, CASE step WHEN 1 THEN 'secondly' WHEN 60 THEN 'minutely' WHEN 3600 THEN 'hourly' WHEN 86400 THEN 'daily' WHEN 604800 THEN 'weekly' WHEN 2592000 THEN 'monthly' WHEN 7862400 THEN 'quarterly' WHEN 31536000 THEN 'yearly' END AS cadence, step, round((SELECT avg((abs(gap - step) <= 0.25 * step)::INT) FROM g WHERE gap IS NOT NULL), 6) AS agreement FROM s",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(timeseries.cadence(t("events"), "ts"))


@query("ts_duplicates", "SELECT count(*) AS rows, (count(*) - count(DISTINCT ts))::BIGINT AS duplicates FROM events")
def _(t):  # noqa: ANN001, ANN202
    return timeseries.duplicate_times(t("events"), "ts")


@query("ts_out_of_order", "SELECT count(*) FILTER (ts < before) AS out_of_order FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events)")
def _(t):  # noqa: ANN001, ANN202
    return timeseries.out_of_order(t("events"), "ts", "event_id", block=1_000)


@query("ts_missing_periods", "WITH d AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP + to_days((date_diff('day', DATE '1970-01-01', ts::DATE) // 3)::INT) AS d FROM events), g AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS period FROM d) SELECT period FROM g WHERE period NOT IN (SELECT d FROM d)")
def _(t):  # noqa: ANN001, ANN202
    # After each third day a day is left out: gaps without dropping events.
    day = F.to_date("ts")
    d = t("events").select(F.date_add(day, F.floor(F.unix_date(day) / 3).cast("int")).cast("timestamp").alias("d"))
    return timeseries.missing_periods(d, "d", 86_400)


@query(
    "ts_stale_runs",
    "WITH c AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c) "
    "SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, event_type AS value FROM r GROUP BY user_id, run, event_type HAVING count(*) >= 3",
)
def _(t):  # noqa: ANN001, ANN202
    return timeseries.stale_runs(t("events"), "ts", "event_type", 3, "event_id", ["user_id"])


def _days(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("events").withColumn("day", F.to_date("ts"))


@query(
    "panel_balance",
    "WITH p AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT user_id, count(*) AS periods, sum(n) AS n FROM p GROUP BY 1) "
    "SELECT sum(n)::BIGINT AS rows, count(*) AS entities, (SELECT count(DISTINCT day) FROM p) AS periods, sum(n - periods)::BIGINT AS duplicates, min(periods) AS min_periods, max(periods) AS max_periods, round(avg(periods), 6) AS mean_periods, min(periods) = max(periods) AS balanced, round(sum(periods) / (count(*) * (SELECT count(DISTINCT day) FROM p)), 6) AS completeness FROM e",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(panel.balance(_days(t), "user_id", "day"))


@query("panel_variation", "WITH e AS (SELECT user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v, count(DISTINCT value) AS d FROM events GROUP BY 1) SELECT round(var_pop(m), 6) AS between, round(sum(n * v) / sum(n), 6) AS within, count(*) FILTER (d <= 1) AS constant_entities FROM e")
def _(t):  # noqa: ANN001, ANN202
    return r6(panel.variation(t("events"), "user_id", "value"))


@query("panel_matrix", "SELECT o_orderpriority, bool_or(o_orderstatus = 'F') AS \"F\", bool_or(o_orderstatus = 'O') AS \"O\", bool_or(o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    return panel.completeness_matrix(t("orders"), "o_orderpriority", "o_orderstatus")


# Linkage ------------------------------------------------------------------------------------------------


@query("linkage_blocks", "SELECT lower(substr(trim(p_name), 1, 4)) AS block, count(*) AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM part GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    return linkage.blocks(t("part"), "p_name", unicode=False)


@query(
    "linkage_pairs",
    "WITH p AS (SELECT p_partkey AS id, p_brand || p_size AS b, p_brand AS f, p_retailprice AS x, p_type AS y FROM part), s AS (SELECT l.id AS \"left\", r.id AS \"right\", 1 - abs(l.x - r.x) / greatest(abs(l.x), abs(r.x), 1) AS a, CASE WHEN lower(l.y) = lower(r.y) THEN 1.0 ELSE 0.0 END::DOUBLE AS c FROM p l JOIN p r ON lower(l.b) = lower(r.b) AND l.id < r.id) "
    "SELECT \"left\", \"right\", round((a + c) / 2, 6) AS score, round(a, 6) AS score_p_retailprice, round(c, 6) AS score_p_type FROM s WHERE (a + c) / 2 >= 0.7 ORDER BY (a + c) / 2 DESC, 1, 2 LIMIT 500",
)
def _(t):  # noqa: ANN001, ANN202
    d = t("part").withColumn("b", F.concat("p_brand", F.col("p_size").cast("string")))
    return r6(linkage.link(d, ["p_retailprice", "p_type"], "b", 64, key="p_partkey", unicode=False, whole=True))


@query("linkage_similar_names")
def _(t):  # noqa: ANN001, ANN202
    return linkage.link(t("supplier").withColumn("block", F.col("s_nationkey").cast("string")), ["s_name", "s_acctbal"], "block", key="s_suppkey", whole=True)


# Preprocessing ------------------------------------------------------------------------------------------


def _filled(t: Callable[[str], DataFrame], how: str) -> DataFrame:
    d = _holes(t)
    done = preprocess.impute(d, "qty", preprocess.fill_value(d, "qty", how, 0))
    return r6(done.agg(F.count("qty").alias("n"), F.sum("qty").alias("total")))


for _how, _value in (("mean", "(SELECT avg(qty) FROM h)"), ("median", "(SELECT median(qty) FROM h)"), ("mode", "(SELECT qty FROM h WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1)"), ("constant", "0")):
    query(f"impute_{_how}", f"WITH h AS (SELECT * FROM {HOLES}) SELECT count(*) AS n, round(sum(coalesce(qty, {_value})), 6) AS total FROM h")(lambda t, how=_how: _filled(t, how))


@query("impute_group_median", f"WITH h AS (SELECT * FROM {HOLES}), g AS (SELECT l_linestatus, median(qty) AS m FROM h GROUP BY 1) SELECT l_linestatus, round(sum(coalesce(qty, m)), 6) AS total FROM h JOIN g USING (l_linestatus) GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    d = _holes(t)
    done = preprocess.impute_by_group(d, "qty", "l_linestatus", preprocess.group_medians(d, "qty", "l_linestatus"), 0.0)
    return r6(done.groupBy("l_linestatus").agg(F.sum("qty").alias("total")))


def _series(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))


_SERIES = "(SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)"


@query("impute_ffill", f"SELECT event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS v FROM {_SERIES}")
def _(t):  # noqa: ANN001, ANN202
    return r6(preprocess.fill_forward(_series(t), "v", "event_id", ["user_id"]).select("event_id", "v"))


@query("impute_bfill", f"SELECT event_id, round(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS v FROM {_SERIES}")
def _(t):  # noqa: ANN001, ANN202
    return r6(preprocess.fill_forward(_series(t), "v", "event_id", ["user_id"], backward=True).select("event_id", "v"))


@query(
    "impute_interpolate",
    f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {_SERIES}), m AS (SELECT *, CASE WHEN v IS NOT NULL THEN k END AS kk FROM n), "
    "w AS (SELECT event_id, k, last_value(v IGNORE NULLS) OVER p AS a, last_value(kk IGNORE NULLS) OVER p AS i, first_value(v IGNORE NULLS) OVER f AS b, first_value(kk IGNORE NULLS) OVER f AS j FROM m WINDOW p AS (PARTITION BY user_id ORDER BY event_id), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT event_id, round(CASE WHEN b IS NULL THEN a WHEN i = j THEN a ELSE a + (b - a) * (k - i) / (j - i) END, 6) AS v FROM w",
)
def _(t):  # noqa: ANN001, ANN202
    return r6(preprocess.interpolate(_series(t), "v", "event_id", ["user_id"]).select("event_id", "v"))


@query("missing_indicator", f"SELECT (qty IS NULL)::INT AS qty__was_missing, count(*) AS n FROM {HOLES} GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    p = preprocess.Preprocessor().indicator("qty")
    return p.fit_transform(_holes(t)).groupBy("qty__was_missing").agg(F.count(F.lit(1)).alias("n"))


@query("encode_one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus__F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus__O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus__P\" FROM orders")
def _(t):  # noqa: ANN001, ANN202
    d = t("orders").select("o_orderkey", "o_orderstatus")
    return preprocess.one_hot(d, "o_orderstatus", preprocess.sorted_levels(d, "o_orderstatus"))


@query("encode_ordinal", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS o_orderpriority FROM orders")
def _(t):  # noqa: ANN001, ANN202
    d = t("orders").select("o_orderkey", "o_orderpriority")
    return preprocess.ordinal_codes(d, "o_orderpriority", preprocess.sorted_levels(d, "o_orderpriority"))


@query("encode_frequency", f"WITH h AS (SELECT coalesce(flag, 'None') AS f FROM {HOLES}) SELECT round(n / total, 6) AS flag, sum(n)::BIGINT AS n FROM (SELECT f, count(*) AS n, sum(count(*)) OVER () AS total FROM h GROUP BY f) GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    d = _holes(t)
    return r6(preprocess.by_level(d, "flag", preprocess.level_table(d, "flag"), "__share", 0.0)).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("encode_count", f"SELECT n AS flag, sum(n)::BIGINT AS n FROM (SELECT coalesce(flag, 'None') AS f, count(*) AS n FROM {HOLES} GROUP BY 1) GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    d = _holes(t)
    return preprocess.by_level(d, "flag", preprocess.level_table(d, "flag"), "__n", 0).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("encode_target", "WITH p AS (SELECT avg(o_totalprice) AS m FROM orders), l AS (SELECT o_orderpriority, (sum(o_totalprice) + m * 10) / (count(*) + 10) AS e FROM orders, p GROUP BY o_orderpriority, m) SELECT o_orderkey, round(e, 6) AS o_orderpriority FROM orders JOIN l USING (o_orderpriority)")
def _(t):  # noqa: ANN001, ANN202
    d = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    means, prior = preprocess.target_means(d, "o_orderpriority", "o_totalprice")
    return r6(preprocess.by_level(d, "o_orderpriority", means, "__mean", prior).select("o_orderkey", "o_orderpriority"))


@query(
    "encode_target_oof",
    "WITH b AS (SELECT *, o_orderkey % 5 AS f FROM orders), lf AS (SELECT o_orderpriority, f, sum(o_totalprice) AS s, count(*) AS n FROM b GROUP BY 1, 2), l AS (SELECT o_orderpriority, sum(s) AS s, sum(n) AS n FROM lf GROUP BY 1), pf AS (SELECT f, (sum(sum(s)) OVER () - sum(s)) / (sum(sum(n)) OVER () - sum(n)) AS prior FROM lf GROUP BY f) "
    "SELECT o_orderkey, round(CASE WHEN l.n - lf.n > 0 THEN (l.s - lf.s + prior * 10) / (l.n - lf.n + 10) ELSE prior END, 4) AS o_orderpriority FROM b JOIN lf USING (o_orderpriority, f) JOIN l USING (o_orderpriority) JOIN pf USING (f)",
)
def _(t):  # noqa: ANN001, ANN202
    d = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return preprocess.target_out_of_fold(d, "o_orderpriority", "o_totalprice", "o_orderkey").select("o_orderkey", F.round("o_orderpriority", 4).alias("o_orderpriority"))


_SCALE = {
    "standard": "(x - (SELECT avg(x) FROM d)) / (SELECT stddev_pop(x) FROM d)", "minmax": "(x - (SELECT min(x) FROM d)) / (SELECT max(x) - min(x) FROM d)",
    "robust": "(x - (SELECT median(x) FROM d)) / (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) FROM d)", "maxabs": "x / (SELECT max(abs(x)) FROM d)", "log1p": "ln(1 + x - least(0, (SELECT min(x) FROM d)))",
}
for _how, _value in _SCALE.items():

    def _scale(t, how=_how):  # noqa: ANN001, ANN202
        d = t("customer").select("c_custkey", F.col("c_acctbal").alias("x"))
        return r6(d.withColumn("x", preprocess.scaled(cells.number(d, "x"), how, preprocess.fit_scale(d, "x", how))))

    query(f"scale_{_how}", f"WITH d AS (SELECT c_custkey, c_acctbal AS x FROM customer) SELECT c_custkey, round({_value}, 6) + 0.0 AS x FROM d")(_scale)


@query("scale_yeo_johnson", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (sqrt(c_acctbal + 1) - 1) / 0.5 ELSE -((pow(1 - c_acctbal, 1.5) - 1) / 1.5) END, 6) + 0.0 AS x FROM customer")
def _(t):  # noqa: ANN001, ANN202
    return r6(t("customer").select("c_custkey", preprocess.yeo_johnson(F.col("c_acctbal"), 0.5).alias("x")))


@query("scale_yeo_johnson_fitted")
def _(t):  # noqa: ANN001, ANN202
    d = t("customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return r6(d.withColumn("x", preprocess.yeo_johnson(F.col("x"), preprocess.fit_yeo(d, "x"))))


@query("scale_quantile_rank", "WITH d AS (SELECT c_custkey, c_acctbal AS x FROM customer) SELECT c_custkey, round((rank() OVER (ORDER BY x) - 1) / (SELECT count(*) FROM d), 6) AS x FROM d")
def _(t):  # noqa: ANN001, ANN202
    d = t("customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return r6(preprocess.quantile_rank(d, "x", d))


# Privacy ------------------------------------------------------------------------------------------------

_EMAIL = r"[\w.+-]+@[\w-]+\.[A-Za-z]{2,}"


@query("privacy_embedded_emails", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_EMAIL}')")
def _(t):  # noqa: ANN001, ANN202
    return t("documents").filter(privacy.embedded_match(F.col("text"), "email")).select("doc_id")


@query("privacy_match_rates", "SELECT 'c_name' AS \"column\", k AS kind, count(c_name) AS present, count(*) FILTER (regexp_matches(trim(c_name), w)) AS whole, count(*) FILTER (e <> '' AND regexp_matches(c_name, e)) AS embedded FROM customer, (VALUES ('email', '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}$', '[\\w.+-]+@[\\w-]+\\.[A-Za-z]{2,}'), ('credit_card', '^x$', 'zzzz'), ('iban', '^[A-Z]{2}\\d{2}[A-Z0-9]{10,30}$', '\\b[A-Z]{2}\\d{2}[A-Z0-9]{10,30}\\b'), ('phone', '^x$', ''), ('ipv4', '^x$', 'zzzz'), ('national_id', '^\\d{3}-?\\d{2}-?\\d{4}$', ''), ('postcode', '^\\d{4,6}$|^[A-Z]{1,2}\\d[A-Z\\d]?\\s?\\d[A-Z]{2}$', '')) AS v(k, w, e) GROUP BY k")
def _(t):  # noqa: ANN001, ANN202
    return privacy.match_rates(t("customer"), ["c_name"])


@query("privacy_luhn", "WITH d AS (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 16, '4') AS s FROM orders), x AS (SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN substr(s, i, 1)::INT ELSE CASE WHEN 2 * substr(s, i, 1)::INT > 9 THEN 2 * substr(s, i, 1)::INT - 9 ELSE 2 * substr(s, i, 1)::INT END END)) % 10 = 0 AS valid FROM d) SELECT valid, count(*) AS n FROM x GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    s = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4")
    return t("orders").select(privacy.luhn(s).alias("valid")).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query("privacy_mask", "SELECT c_custkey, left(c_name, 1) || repeat('*', length(c_name) - 3) || right(c_name, 2) AS masked FROM customer")
def _(t):  # noqa: ANN001, ANN202
    return t("customer").select("c_custkey", privacy.mask(F.col("c_name")).alias("masked"))


@query("privacy_redact", f"SELECT flag, count(*) AS n FROM (SELECT CASE WHEN flag IS NOT NULL THEN '[REDACTED]' END AS flag FROM {HOLES}) GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    return _holes(t).select(privacy.redact(F.col("flag")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("privacy_hash", "SELECT c_custkey, substr(sha256('salt' || c_name), 1, 16) AS h FROM customer")
def _(t):  # noqa: ANN001, ANN202
    return t("customer").select("c_custkey", privacy.hash_value(F.col("c_name"), "salt").alias("h"))


@query("privacy_pseudonymise", "WITH f AS (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1), k AS (SELECT o_custkey, 'ID-' || lpad((row_number() OVER (ORDER BY o))::VARCHAR, 6, '0') AS id FROM f) SELECT o_orderkey, id AS o_custkey FROM orders JOIN k USING (o_custkey)")
def _(t):  # noqa: ANN001, ANN202
    return privacy.pseudonymise(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("privacy_generalise", "SELECT '[' || (floor(p_size / 10) * 10)::INT || ', ' || (floor(p_size / 10) * 10 + 10)::INT || ')' AS bucket, count(*) AS n FROM part GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    return t("part").select(privacy.generalise(F.col("p_size")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("privacy_reidentification", "WITH g AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT sum(n)::BIGINT AS rows, count(*) AS groups, count(*) FILTER (n = 1) AS unique_rows, min(n) AS smallest, round(count(*) FILTER (n = 1) / sum(n), 6) AS risk, CASE WHEN count(*) FILTER (n = 1) / sum(n) > 0.5 THEN 'high' WHEN count(*) FILTER (n = 1) / sum(n) > 0.1 THEN 'medium' ELSE 'low' END AS level FROM g")
def _(t):  # noqa: ANN001, ANN202
    return r6(privacy.reidentification(t("customer"), ["c_nationkey", "c_mktsegment"]))


# Cells --------------------------------------------------------------------------------------------------

# Texts in the forms that cells take, made of every order's own key, price and date.
_FORMS = """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN cast(cast(o_orderkey AS BIGINT) AS {str})
  WHEN 1 THEN concat(cast(o_orderkey AS {str}), ',', lpad(cast(o_orderkey % 1000 AS {str}), 3, '0'), '.50') WHEN 2 THEN concat(cast(o_orderkey AS {str}), 'f') WHEN 3 THEN concat(' ', cast(o_orderkey AS {str}), ' ')
  WHEN 4 THEN concat(cast(o_orderkey % 100 AS {str}), 'e', cast(o_orderkey % 7 AS {str})) WHEN 5 THEN concat('1_', cast(o_orderkey AS {str})) WHEN 6 THEN o_orderpriority WHEN 7 THEN 'nan' WHEN 8 THEN concat('-', cast(o_orderkey AS {str}), '.25')
  WHEN 9 THEN concat({y}, '-', {m}, '-', {d}) WHEN 10 THEN concat({d}, '/', {m}, '/', {y}) ELSE concat({m}, '.', {d}, '.', {y}) END AS s FROM {orders}"""


def _parts(kind: str, orders: str) -> str:
    part = lambda p: f"lpad(cast({p}(o_orderdate) AS {kind}), {4 if p == 'year' else 2}, '0')"
    return _FORMS.format(str=kind, orders=orders, y=part("year"), m=part("month"), d=part("day"))


_FIXTURE = f"({_parts('VARCHAR', 'orders')})"


def _texts(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("orders").sparkSession.sql(_parts("STRING", "{orders}"), orders=t("orders"))


@query("cells_numbers", f"SELECT o_orderkey, s, CASE WHEN regexp_matches(trim(replace(s, ',', '')), '(?i)^[+-]?((\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?)$') THEN try_cast(trim(replace(s, ',', '')) AS DOUBLE) END AS x FROM {_FIXTURE}")
def _(t):  # noqa: ANN001, ANN202
    return _texts(t).select("o_orderkey", "s", cells.text_number(F.col("s")).alias("x"))


@query("cells_forms", f"SELECT CASE WHEN regexp_matches(trim(s), '(?i)^[+-]?((\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?|nan)$') THEN 'numeric-string' WHEN regexp_matches(trim(s), '^[+-]?[\\d,]+(\\.\\d+)?$') THEN 'formatted-numeric-string' ELSE 'string' END AS form, count(*) AS n FROM {_FIXTURE} GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    return _texts(t).groupBy(cells.text_form(F.col("s")).alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "cells_dates",
    f"WITH d AS (SELECT o_orderkey, s, list_filter([try_strptime(s, '%Y-%m-%d')], lambda x: x IS NOT NULL) AS i, list_filter([try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%d-%m-%Y'), try_strptime(s, '%d.%m.%Y')], lambda x: x IS NOT NULL) AS a, list_filter([try_strptime(s, '%m/%d/%Y'), try_strptime(s, '%m-%d-%Y'), try_strptime(s, '%m.%d.%Y')], lambda x: x IS NOT NULL) AS b FROM {_FIXTURE}) "
    "SELECT o_orderkey, s, CASE WHEN len(i) + len(a) + len(b) = 0 THEN 'invalid' WHEN len(b) > 0 AND len(a) = 0 THEN 'format_conflict' WHEN len(list_distinct(list_concat(i, a, b))) = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM d",
)
def _(t):  # noqa: ANN001, ANN202
    return _texts(t).select("o_orderkey", "s", cells.date_status(cells.date_readings(F.col("s")), F.lit("day_first")).alias("status"))


@query("cells_non_ascii", "SELECT lang, count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS n FROM documents GROUP BY lang")
def _(t):  # noqa: ANN001, ANN202
    return t("documents").groupBy("lang").agg(F.count_if(F.size(cells.non_ascii(F.col("text"))) > 0).alias("n"))


@query("cells_confusables", "SELECT doc_id, replace(replace(text, '’', ''''), '–', '-') AS text FROM documents")
def _(t):  # noqa: ANN001, ANN202
    return t("documents").select("doc_id", cells.unconfused(F.col("text")).alias("text"))


# Detector predicates on the shared tables ---------------------------------------------------------------


@query("detect_ranges", "SELECT count(*) FILTER (l_quantity < 5) AS below, count(*) FILTER (l_quantity > 45) AS above FROM lineitem")
def _(t):  # noqa: ANN001, ANN202
    x = cells.number(t("lineitem"), "l_quantity")
    return t("lineitem").agg(F.count_if(x < 5).alias("below"), F.count_if(x > 45).alias("above"))


@query("detect_formula", "SELECT count(*) AS n, count(*) FILTER (abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount)) > 0.01) AS bad FROM lineitem")
def _(t):  # noqa: ANN001, ANN202
    from .plans.detectors import Formula, residual

    d = t("lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    off = residual(d, Formula("net", "l_extendedprice - l_extendedprice * l_discount", ("l_extendedprice", "l_discount"), "net"))
    return d.agg(F.count(off).alias("n"), F.count_if(off > 0.01).alias("bad"))


@query("detect_states", "SELECT count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 11 = 0) AS paid_without_payment_date, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 11 = 0) AS partial_without_payment_date FROM orders")
def _(t):  # noqa: ANN001, ANN202
    from .plans.detectors import REGISTRY, Context

    d = t("orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("payment_date"))
    return d.agg(*[e.alias(n) for n, e in REGISTRY["state_consistency"].requests(d, Context(paid="F", partial="P", pending="O")).items()])


# Places of customers, one of ten by the key: country, city, conflict, unknown.
_PLACES = [("Algeria", "Oran", "false", "false"), ("algerie ", "Paris", "true", "false"), ("Maroc", "Fez", "false", "false"), ("France", "Lyon", "false", "false"), ("Tunisia", "Atlantis", "false", "true"), ("Egypt", None, "false", "false"), ("ALGERIA", "oran", "false", "false"), ("France", "Fez", "true", "false"), ("Tunisia", "Lyon", "true", "false"), ("Morocco", "Nowhere", "false", "true")]


def _pick(k: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if p[k] is None else p[k] if k > 1 else repr(p[k])}" for i, p in enumerate(_PLACES))
    return f"CASE c_custkey % 10 {cases} END"


@query("detect_geography", f"SELECT {_pick(0)} AS country, {_pick(1)} AS city, {_pick(2)} AS conflict, {_pick(3)} AS \"unknown\", count(*) AS n FROM customer GROUP BY ALL")
def _(t):  # noqa: ANN001, ANN202
    from .plans.detectors import REGISTRY, Context

    d = t("customer").select(F.expr(_pick(0)).alias("country"), F.expr(_pick(1)).alias("city"), F.lit("EUR").alias("currency"))
    found = REGISTRY["geographic_consistency"].resolved(d, Context()).select("country", "city", "conflict", "unknown")
    return d.groupBy("country", "city").agg(F.count(F.lit(1)).alias("n")).join(found.distinct(), [d["country"].eqNullSafe(found["country"]), d["city"].eqNullSafe(found["city"])]).select(d["country"], d["city"], "conflict", "unknown", "n")


# Filters and charts -------------------------------------------------------------------------------------

_CLAUSES = {
    "eq": (("o_orderstatus", "F"), "o_orderstatus = 'F'"), "ne": (("o_orderstatus", "F"), "o_orderstatus <> 'F'"), "gt": (("o_totalprice", 200_000), "o_totalprice > 200000"), "ge": (("o_custkey", 100), "o_custkey >= 100"), "lt": (("o_totalprice", 50_000), "o_totalprice < 50000"),
    "le": (("o_custkey", 10), "o_custkey <= 10"), "in": (("o_orderstatus", ["F", "P"]), "o_orderstatus IN ('F', 'P')"), "contains": (("o_orderpriority", "urgent"), "lower(o_orderpriority) LIKE '%urgent%'"), "missing": (("o_orderdate", None), "o_orderdate IS NULL"), "present": (("o_orderdate", None), "o_orderdate IS NOT NULL"),
}
for _how, ((_column, _value), _where) in _CLAUSES.items():
    query(f"filter_{_how}", f"SELECT o_orderkey FROM orders WHERE {_where}")(lambda t, c=Clause(_column, _how, _value): ViewState((c,)).view(t("orders")).select("o_orderkey"))


@query("filter_selection", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21, -1) AND o_totalprice > 1000")
def _(t):  # noqa: ANN001, ANN202
    state = ViewState((Clause("o_totalprice", "gt", 1000),)).select([1, 2, 3, 5, 8, 13, 21, -1])
    return state.selected(t("orders"), "o_orderkey").select("o_orderkey")


for _how, _value in (("count", "count(o_totalprice)"), ("mean", "avg(o_totalprice)"), ("median", "median(o_totalprice)"), ("sum", "sum(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)")):
    _cast = _value if _how == "count" else f"round({_value}, 4)"

    def _chart(t, how=_how):  # noqa: ANN001, ANN202
        d = charts.aggregated(t("orders"), "o_orderpriority", "o_totalprice", how)
        return d if how == "count" else d.select("level", F.round("value", 4).alias("value"))

    query(f"compose_{_how}", f"SELECT o_orderpriority AS level, {_cast} AS value FROM orders GROUP BY 1 ORDER BY {_value} DESC, 1 LIMIT 40")(_chart)


@query("compose_time", "SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS time, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1")
def _(t):  # noqa: ANN001, ANN202
    return r6(charts.over_time(t("orders"), "o_orderdate", "o_totalprice"))


@query("chart_target_means", "SELECT p_brand AS level, round(avg(p_retailprice), 6) AS mean, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, level LIMIT 12")
def _(t):  # noqa: ANN001, ANN202
    return r6(charts.target_means(t("part"), "p_brand", "p_retailprice"))


@query("chart_sample")
def _(t):  # noqa: ANN001, ANN202
    return charts.sample(t("orders"), ["o_totalprice", "o_custkey"], key="o_orderkey")


# Whole runs ---------------------------------------------------------------------------------------------


@query("scan_orders", "SELECT 'RANGE-o_totalprice' AS finding, count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) AS rows FROM orders HAVING count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) > 0")
def _(t):  # noqa: ANN001, ANN202
    from .plans.detectors import Range
    from .plans.scan import scan

    found = scan(t("orders"), ranges=(Range("o_totalprice", 1_000, 400_000),), only=["range_violation"])
    return t("orders").sparkSession.createDataFrame([(i.id, i.affected) for i in found.issues], "finding string, rows long")


@query("fingerprint")
def _(t):  # noqa: ANN001, ANN202
    from .sources.frames import Fingerprint

    f = Fingerprint.of(t("orders"))
    return t("orders").sparkSession.createDataFrame([(f.rows, f.columns, f.schema, f.content)], "rows long, columns long, schema string, content string")


@query("contract_inferred", "SELECT 'o_orderkey' AS \"column\", 'numeric' AS dtype, false AS nullable, count(*) = count(DISTINCT o_orderkey) AS \"unique\" FROM orders UNION ALL SELECT 'o_orderstatus', 'text', false, count(*) = count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice', 'numeric', false, count(*) = count(DISTINCT o_totalprice) FROM orders")
def _(t):  # noqa: ANN001, ANN202
    from .plans.contract import DataContract

    d = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    made = DataContract.infer(d)
    return d.sparkSession.createDataFrame([(c.name, c.dtype, c.nullable, c.unique) for c in made.columns], "column string, dtype string, nullable boolean, unique boolean")


@query("rules_learned")
def _(t):  # noqa: ANN001, ANN202
    from .plans.contract import learn_rules

    d = t("orders")
    return d.sparkSession.createDataFrame([(r.column, r.kind, str(r.arguments), r.confidence) for r in learn_rules(d).rules], "column string, kind string, arguments string, confidence double")


@query("preprocess_advice")
def _(t):  # noqa: ANN001, ANN202
    d = _holes(t)
    return d.sparkSession.createDataFrame([(a.column, a.kind, a.method) for a in preprocess.recommend(d)], "column string, kind string, method string")


@query(
    "scan_lineitem",
    "WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS d FROM lineitem GROUP BY 1 HAVING count(*) > 1) "
    "SELECT * FROM (SELECT 'DUP-CONFLICT-l_orderkey' AS finding, 'BLOCKING' AS severity, 'DO_NOT_TOUCH' AS repair_class, sum(n) FILTER (d > 1)::BIGINT AS rows FROM g UNION ALL SELECT 'RANGE-l_discount', 'CRITICAL_REVIEW', 'USER_CONFIRMATION_REQUIRED', count(*) FILTER (l_discount < 0 OR l_discount > 0.05) FROM lineitem "
    "UNION ALL SELECT 'RANGE-l_quantity', 'CRITICAL_REVIEW', 'USER_CONFIRMATION_REQUIRED', count(*) FILTER (l_quantity < 1 OR l_quantity > 45) FROM lineitem) WHERE rows > 0",
)
def _(t):  # noqa: ANN001, ANN202
    from .plans.detectors import Range
    from .plans.scan import scan

    found = scan(t("lineitem"), key="l_orderkey", ranges=(Range("l_discount", 0, 0.05), Range("l_quantity", 1, 45)))
    return found.data.sparkSession.createDataFrame([(i.id, i.severity.name, i.repair_class.name, i.affected) for i in found.issues], "finding string, severity string, repair_class string, rows long")


@query("auto_prepare_orders", "SELECT 'CAT-o_orderpriority' AS finding, 'canonicalise_mechanical' AS operation, true AS applied, count(*) AS cells FROM orders WHERE o_orderkey % 9 = 0 AND lower(o_orderpriority) <> o_orderpriority")
def _(t):  # noqa: ANN001, ANN202
    from .plans.prepare import auto_prepare

    d = t("orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")))
    made = auto_prepare(d, categorical=("o_orderpriority", "o_orderstatus"))
    return d.sparkSession.createDataFrame([(r.issue, r.operation, r.applied, r.cells_changed) for r in made.audit.records], "finding string, operation string, applied boolean, cells long")


#: Column: kind, so that the SQL checks both.
_KINDS = {"l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric", "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric", "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime"}


@query("profile_lineitem", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS rows, (count(*) - count({c}))::BIGINT AS missing, count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c, k in _KINDS.items()))
def _(t):  # noqa: ANN001, ANN202
    made = profile.profile(t("lineitem"))
    return t("lineitem").sparkSession.createDataFrame([(c.name, c.kind, c.rows, c.missing, c.distinct) for c in made.columns.values()], "column string, kind string, rows long, missing long, distinct long")


@query("associations_orders")
def _(t):  # noqa: ANN001, ANN202
    found = association.associations(t("orders").select("o_orderstatus", "o_totalprice", "o_custkey", "o_orderpriority"))
    return t("orders").sparkSession.createDataFrame([(p.left, p.right, p.method, p.value, p.n) for p in found.pairs], "left string, right string, method string, value double, n long")


@query("mechanism_lineitem")
def _(t):  # noqa: ANN001, ANN202
    found = mechanism.mechanism(_holes(t).select("qty", "l_extendedprice", "flag", "l_linestatus"), ["qty"])
    return t("lineitem").sparkSession.createDataFrame([(m.column, m.verdict, x.predictor, x.test, x.adjusted) for m in found for x in m.tests], "column string, verdict string, predictor string, test string, adjusted double")


@query("drift_report_orders")
def _(t):  # noqa: ANN001, ANN202
    rep = drift.compare(*(d.select("o_totalprice", "o_orderpriority") for d in _split(t)))
    return t("orders").sparkSession.createDataFrame([(x.column, x.kind, x.severity) for x in rep.found], "column string, kind string, severity string")
