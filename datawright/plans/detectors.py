"""The fourteen detectors of a scan.

A detector names the aggregates it needs (``requests``); a scan puts those of all detectors into one job and hands the values
back. Detectors that need groups run a grouped job of their own. Affected rows stay distributed: a finding holds their predicate.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import CONFUSABLES, FAMILY, INVISIBLE, MIXED, cell, date_readings, date_status, folded, has_confusable, is_missing, number, similarity, text, unaccented, unconfused
from ..functions.entities import CURRENCY, EntityPack
from ..operators.ordering import quantiles
from ..sources.frames import ROW
from .model import Issue, Severity, Treatment

S = Severity


@dataclass(frozen=True)
class Range:
    column: str
    minimum: float | None = None
    maximum: float | None = None
    reason: str = ""


@dataclass(frozen=True)
class ConditionalMissing:
    """``column`` is rightly absent where ``condition`` is one of ``states``."""

    column: str
    condition: str
    states: tuple[str, ...]


@dataclass(frozen=True)
class Formula:
    """``target`` should equal the SQL ``expression`` over ``inputs``."""

    label: str
    expression: str
    inputs: tuple[str, ...]
    target: str


# The preset for invoices.
RANGES = (Range("quantity", 1), Range("discount_pct", 0, 1), Range("tax_pct", 0, 1), Range("customer_rating", 1, 5), Range("employee_count", 1))
CONDITIONAL = (ConditionalMissing("payment_date", "status", ("Pending", "Overdue")), ConditionalMissing("payment_amount", "status", ("Pending", "Overdue")))
FORMULAS = (Formula("invoice_amount = quantity * unit_price * (1 - discount_pct) * (1 + tax_pct)", "quantity * unit_price * (1 - discount_pct) * (1 + tax_pct)", ("quantity", "unit_price", "discount_pct", "tax_pct"), "invoice_amount"),)
SENTINELS = (999, 9999, 99999, 999999, 9999999, -1, -9, -99, -999, -9999)
MAX_LEVELS, NEAR, NEAR_LENGTH = 50, 0.85, 5


@dataclass
class Context:
    """What the caller knows about the table."""

    key: str | None = None
    identifier: str | None = None
    pattern: str = r"^[A-Z]+-(\d{4})-\d+$"
    compare_to: str | None = None
    date_columns: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    ranges: tuple[Range, ...] = RANGES
    conditional: tuple[ConditionalMissing, ...] = CONDITIONAL
    formulas: tuple[Formula, ...] = FORMULAS
    tolerance: float = 0.01
    least_fit: float = 0.60
    status: str = "status"
    paid: str = "Paid"
    pending: str = "Pending"
    partial: str = "Partial"
    payment_date: str = "payment_date"
    payment_amount: str = "payment_amount"
    invoice_amount: str = "invoice_amount"
    country: str = "country"
    city: str = "city"
    currency: str = "currency"
    revenue: str = "annual_revenue"
    profit: str = "reported_profit"
    pack: EntityPack = field(default_factory=EntityPack)
    expected_currency: dict[str, str] = field(default_factory=lambda: dict(CURRENCY))


class Detector:
    name = ""

    def needs(self, c: Context) -> tuple[str, ...]:
        """Columns without which the detector does not apply."""
        return ()

    def requests(self, df: DataFrame, c: Context) -> dict[str, Column]:
        return {}

    def findings(self, df: DataFrame, c: Context, v: dict[str, Any]) -> list[Issue]:
        raise NotImplementedError


REGISTRY: dict[str, Detector] = {}


def register(made: type[Detector]) -> type[Detector]:
    if made.name in REGISTRY:
        raise ValueError(f"a detector named {made.name!r} is registered")
    REGISTRY[made.name] = made()
    return made


def _names(df: DataFrame) -> list[str]:
    return [x for x in df.columns if x != ROW]


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.name != ROW and (isinstance(f.dataType, T.StringType) or f.dataType == MIXED)]


def _string(df: DataFrame, column: str) -> Column:
    """The cell's text where the cell is a text."""
    return F.col(f"`{column}`.s") if df.schema[column].dataType == MIXED else F.col(f"`{column}`")


@register
class Missingness(Detector):
    name = "missingness"

    def requests(self, df, c):  # noqa: ANN001, ANN201
        ruled = {r.column: r for r in c.conditional if r.condition in df.columns}
        out = {}
        for x in _names(df):
            out[f"n:{x}"] = F.count_if(is_missing(df, x))
            if x in ruled:
                out[f"s:{x}"] = F.count_if(is_missing(df, x) & text(df, ruled[x].condition).isin(*ruled[x].states))
        return out | {"rows": F.count(F.lit(1))}

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        ruled = {r.column: r for r in c.conditional if r.condition in df.columns}
        found = []
        for x in _names(df):
            n = v[f"n:{x}"]
            if not n:
                continue
            gap = lambda d, x=x: is_missing(d, x)
            if x not in ruled:
                found.append(Issue(f"MISS-{x}", "missingness", S.WARNING if n / v["rows"] > 0.05 else S.NOTICE, (x,), 1.0, n, (Treatment("record_only", 0.99),), rows=gap))
                continue
            r, structural = ruled[x], v[f"s:{x}"]
            inside = lambda d, r=r: F.coalesce(text(d, r.condition).isin(*r.states), F.lit(False))
            if structural:
                found.append(Issue(f"MISS-STRUCTURAL-{x}", "structural_missingness", S.INFO, (x, r.condition), 0.95, structural, (Treatment("leave_unchanged", 0.99),), rows=lambda d, g=gap, i=inside: g(d) & i(d)))
            if n - structural:
                found.append(Issue(f"MISS-SUSPICIOUS-{x}", "suspicious_missingness", S.HIGH_WARNING, (x, r.condition), 0.95, n - structural, (Treatment("review_contradiction", 0.30, domain_rule=True),), rows=lambda d, g=gap, i=inside: g(d) & ~i(d)))
        return found


@register
class RangeViolation(Detector):
    name = "range_violation"

    def requests(self, df, c):  # noqa: ANN001, ANN201
        out = {}
        for r in c.ranges:
            if r.column in df.columns:
                x = number(df, r.column)
                out[f"below:{r.column}"] = F.count_if(x < r.minimum) if r.minimum is not None else F.max(F.lit(0))
                out[f"above:{r.column}"] = F.count_if(x > r.maximum) if r.maximum is not None else F.max(F.lit(0))
        return out

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        found = []
        for r in c.ranges:
            if r.column not in df.columns or not (n := (v[f"below:{r.column}"] or 0) + (v[f"above:{r.column}"] or 0)):
                continue

            def outside(d: DataFrame, r: Range = r) -> Column:
                x = number(d, r.column)
                low = (x < r.minimum) if r.minimum is not None else F.lit(False)
                return low | (x > r.maximum) if r.maximum is not None else low

            details = {"below": v[f"below:{r.column}"], "above": v[f"above:{r.column}"], "minimum": r.minimum, "maximum": r.maximum}
            found.append(Issue(f"RANGE-{r.column}", "range_violation", S.CRITICAL_REVIEW, (r.column,), 1.0, n, (Treatment("quarantine", 0.85), Treatment("set_missing_with_flag", 0.80)), details=details, rows=outside))
        return found


@register
class SentinelCandidate(Detector):
    name = "sentinel_candidate"

    @staticmethod
    def _clean(df: DataFrame, column: str) -> Column:
        n = number(df, column)
        return F.when(~n.isin(*[float(s) for s in SENTINELS]), n)

    @staticmethod
    def _columns(df: DataFrame) -> list[str]:
        return [x for x in _names(df) if isinstance(df.schema[x].dataType, (T.NumericType, T.StringType)) or df.schema[x].dataType == MIXED]

    def requests(self, df, c):  # noqa: ANN001, ANN201
        out = {}
        for x in self._columns(df):
            n = number(df, x)
            out[f"n:{x}"] = F.count(n)
            out |= {f"{s}:{x}": F.count_if(n == float(s)) for s in SENTINELS}
        return out

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        """Quantiles are computed only for columns that hold a code at least twice."""
        held = [x for x in self._columns(df) if v[f"n:{x}"] >= 30 and any(v[f"{s}:{x}"] >= 2 for s in SENTINELS)]
        if not held:
            return []
        row = df.agg(*[F.min(self._clean(df, x)) for x in held]).first()
        cuts = quantiles(df, {x: self._clean(df, x) for x in held}, [0.25, 0.75, 0.999])
        found = []
        for x, low in zip(held, row, strict=True):
            if not cuts[x]:
                continue
            q1, q3, top = cuts[x]
            codes = {s: v[f"{s}:{x}"] for s in SENTINELS if v[f"{s}:{x}"] >= 2 and (q3 > q1 and s > top + 10 * (q3 - q1) or s < 0 <= low)}
            if codes:
                found.append(Issue(f"SENTINEL-{x}", "sentinel_candidate", S.HIGH_WARNING, (x,), 0.97, sum(codes.values()), (Treatment("treat_as_missing", 0.55), Treatment("keep_and_flag", 0.50)), details={"codes": codes}, rows=lambda d, x=x, codes=codes: number(d, x).isin(*[float(s) for s in codes])))
        return found


@register
class FormulaInvariant(Detector):
    name = "formula_invariant"

    def requests(self, df, c):  # noqa: ANN001, ANN201
        out = {}
        for f in c.formulas:
            if {*f.inputs, f.target} <= {*df.columns}:
                off = residual(df, f)
                out[f"n:{f.target}"], out[f"bad:{f.target}"], out[f"med:{f.target}"] = F.count(off), F.count_if(off > c.tolerance), F.median(F.when(off > c.tolerance, off))
        return out

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        found = []
        for f in c.formulas:
            n, bad = v.get(f"n:{f.target}") or 0, v.get(f"bad:{f.target}") or 0
            if n and bad and 1 - bad / n >= c.least_fit:
                found.append(Issue(f"INVARIANT-{f.target}", "formula_violation", S.HIGH_WARNING, (*f.inputs, f.target), 0.99, bad, (Treatment("confirm_relation_as_rule", 0.45, domain_rule=True),), details={"formula": f.label, "fit": 1 - bad / n, "median_residual": v[f"med:{f.target}"]}, rows=lambda d, f=f: residual(d, f) > c.tolerance))
        return found


def residual(df: DataFrame, f: Formula) -> Column:
    """Absolute difference of target and formula; the formula's names stand for parsed numbers."""
    named = F.struct(*[number(df, x).alias(x) for x in f.inputs])
    value = F.transform(F.array(named), lambda r: _substituted(f, r))[0]
    return F.abs(number(df, f.target) - value)


def _substituted(f: Formula, r: Column) -> Column:
    import ast

    operators = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b)}

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.BinOp):
            return operators[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -walk(n.operand)
        if isinstance(n, ast.Constant):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            return r[n.id]
        raise ValueError(f"a formula knows names, numbers and + - * / only: {f.expression}")

    return walk(ast.parse(f.expression, mode="eval"))


@register
class StateConsistency(Detector):
    name = "state_consistency"

    def needs(self, c):  # noqa: ANN001, ANN201
        return (c.status,)

    @staticmethod
    def rules(df: DataFrame, c: Context) -> list[tuple[str, Column, Severity]]:
        state, found = text(df, c.status), []
        if c.payment_date in df.columns:
            none = is_missing(df, c.payment_date)
            found += [("paid_without_payment_date", (state == c.paid) & none, S.HIGH_WARNING), ("partial_without_payment_date", (state == c.partial) & none, S.WARNING)]
        if c.payment_amount in df.columns:
            paid = number(df, c.payment_amount)
            found += [("paid_without_payment_amount", (state == c.paid) & paid.isNull(), S.HIGH_WARNING), ("pending_with_payment", (state == c.pending) & (paid > 0), S.HIGH_WARNING)]
            if c.invoice_amount in df.columns:
                found.append(("paid_amount_mismatch", (state == c.paid) & (F.abs(paid - number(df, c.invoice_amount)) > 0.01), S.WARNING))
        return found

    def requests(self, df, c):  # noqa: ANN001, ANN201
        return {n: F.count_if(e) for n, e, _ in self.rules(df, c)}

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        return [
            Issue(f"STATE-{n}", "state_contradiction", s, (c.status,), 0.95, v[n], (Treatment("review_state_transition", 0.30, domain_rule=True),), rows=lambda d, n=n: next(e for m, e, _ in self.rules(d, c) if m == n))
            for n, _, s in self.rules(df, c)
            if v[n]
        ]


@register
class GeographicConsistency(Detector):
    name = "geographic_consistency"

    def needs(self, c):  # noqa: ANN001, ANN201
        return (c.country, c.city)

    @staticmethod
    def resolved(df: DataFrame, c: Context) -> DataFrame:
        """Distinct (country, city) with their entities, conflict and unknown flags, and counts: folding runs on distinct pairs only."""
        spark = df.sparkSession
        pairs = df.select(text(df, c.country).alias("country"), text(df, c.city).alias("city")).groupBy("country", "city").agg(F.count(F.lit(1)).alias("n"))
        pairs = pairs.select("*", folded("country").alias("fc"), folded("city").alias("fy"))
        countries, cities = (c.pack.table(spark, k) for k in ("country", "city"))
        joined = pairs.join(F.broadcast(countries.select(F.col("form").alias("fc"), F.col("id").alias("country_id"))), "fc", "left").join(F.broadcast(cities.select(F.col("form").alias("fy"), F.col("parent").alias("city_country"))), "fy", "left")
        return joined.select("country", "city", "n", "country_id", F.coalesce(F.col("city_country") != F.col("country_id"), F.lit(False)).alias("conflict"), (F.col("city").isNotNull() & (F.trim("city") != "") & F.col("city_country").isNull()).alias("unknown"))

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        found = []
        r = self.resolved(df, c)
        one = r.agg(F.sum(F.when(F.col("conflict"), F.col("n"))), F.sum(F.when(F.col("unknown"), F.col("n"))), F.count_if("unknown")).first()
        if one[0]:
            rows = lambda d: d.join(self.resolved(d, c).filter("conflict").select(F.col("country").alias("__a"), F.col("city").alias("__b")), (text(d, c.country) == F.col("__a")) & (text(d, c.city) == F.col("__b"))).select(ROW)
            found.append(Issue("GEO-country-city", "geographic_conflict", S.HIGH_WARNING, (c.country, c.city), 0.98, one[0], (Treatment("review_geographic_pair", 0.40),), rows=rows))
        if one[1]:
            found.append(Issue("GEO-unknown-city", "unknown_entity", S.NOTICE, (c.city,), 1.0, 0, (Treatment("extend_reference_pack", 0.50),), details={"cities": one[2], "cells": one[1]}))
        return found


@register
class CurrencyContext(Detector):
    name = "currency_context"

    def needs(self, c):  # noqa: ANN001, ANN201
        return (c.country, c.currency)

    @staticmethod
    def odd(values: DataFrame, c: Context) -> DataFrame:
        """Those of ``values``, which has a ``country`` and a ``currency``, whose currency is not the country's."""
        known = values.select("*", folded("country").alias("form")).join(F.broadcast(c.pack.table(values.sparkSession, "country").select("form", "id")), "form")
        expected = F.lit(None).cast("string")
        for k, e in c.expected_currency.items():
            expected = F.when(F.col("id") == k, e).otherwise(expected)
        return known.filter(F.col("currency") != expected)

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        values = lambda d: [text(d, c.country).alias("country"), F.trim(text(d, c.currency)).alias("currency")]
        odd = self.odd(df.select(*values(df)).filter("country is not null and currency is not null").groupBy("country", "currency").agg(F.count(F.lit(1)).alias("n")), c)
        affected = odd.agg(F.sum("n")).first()[0]
        if not affected:
            return []
        # The most frequent pairs are shown; count and rows are those of all.
        seen = odd.orderBy(F.desc("n"), "country", "currency").limit(1000).collect()
        rows = lambda d: self.odd(d.select(ROW, *values(d)), c).select(ROW)
        return [Issue("CURRENCY-context", "currency_context", S.NOTICE, (c.country, c.currency), 0.90, affected, (Treatment("define_currency_policy", 0.50),), details={"pairs": {f"{r['country']}/{r['currency']}": r["n"] for r in seen}}, rows=rows)]


@register
class AccountingPlausibility(Detector):
    name = "accounting_plausibility"

    def needs(self, c):  # noqa: ANN001, ANN201
        return (c.revenue, c.profit)

    def requests(self, df, c):  # noqa: ANN001, ANN201
        return {"n": F.count_if(number(df, c.profit) > number(df, c.revenue))}

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        return [Issue("ACCOUNTING-profit-exceeds-revenue", "accounting_implausibility", S.WARNING, (c.revenue, c.profit), 0.85, v["n"], (Treatment("review_accounting_definition", 0.35, domain_rule=True),), rows=lambda d: number(d, c.profit) > number(d, c.revenue))] if v["n"] else []


@register
class MixedPhysicalType(Detector):
    name = "mixed_physical_type"

    def requests(self, df, c):  # noqa: ANN001, ANN201
        return {f"{f}:{x}": F.count_if(cell(df, x).form == f) for x in _texts(df) for f in FAMILY}

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        found = []
        for x in _texts(df):
            forms = {f: v[f"{f}:{x}"] for f in FAMILY if v[f"{f}:{x}"]}
            if len({FAMILY[f] for f in forms}) < 2 and not (len(forms) > 1 and {"float", "int"} & set(forms) and {"numeric-string", "formatted-numeric-string"} & set(forms)):
                continue
            families = {FAMILY[f] for f in forms}
            present = sum(forms.values())
            common = max(forms, key=lambda f: forms[f])
            if families == {"number"}:
                treatment = Treatment("parse_numeric", 1.0)
            elif "temporal" in families:
                treatment = Treatment("parse_datetime_unambiguous", 0.99)
            else:
                treatment = Treatment("normalise_text_representation", 0.70)
            found.append(Issue(f"TYPE-{x}", "mixed_physical_type", S.HIGH_WARNING, (x,), 1.0, present - forms[common], (treatment,), details={"forms": forms}, rows=lambda d, x=x, common=common: ~cell(d, x).missing & (cell(d, x).form != common)))
        return found


@register
class DuplicateIdentifier(Detector):
    name = "duplicate_identifier"

    def needs(self, c):  # noqa: ANN001, ANN201
        return (c.key,) if c.key else ("",)

    @staticmethod
    def groups(df: DataFrame, key: str) -> DataFrame:
        """(key, n, versions, first): repeated keys, whether their rows agree in all columns as texts, and their first row."""
        whole = F.xxhash64(*[F.coalesce(text(df, x), F.lit("\0")) for x in _names(df)])
        return df.filter(~is_missing(df, key)).groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(whole).alias("versions"), F.min(ROW).alias("first")).filter("n > 1")

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        key, found = c.key, []
        one = self.groups(df, key).agg(F.count_if(F.col("versions") == 1), F.sum(F.when(F.col("versions") == 1, F.col("n"))), F.count_if(F.col("versions") > 1), F.sum(F.when(F.col("versions") > 1, F.col("n")))).first()
        rows = lambda test: lambda d: d.join(self.groups(d, key).filter(test).select("__key"), d[key] == F.col("__key"), "left_semi").select(ROW)
        if one[0]:
            found.append(Issue(f"DUP-EXACT-{key}", "exact_duplicate", S.WARNING, (key,), 1.0, one[1], (Treatment("keep_first", 0.99, irreversible=True),), details={"keys": one[0]}, rows=rows("versions = 1")))
        if one[2]:
            found.append(Issue(f"DUP-CONFLICT-{key}", "conflicting_duplicate", S.BLOCKING, (key,), 1.0, one[3], (Treatment("define_precedence_rule", 0.10, domain_rule=True),), details={"keys": one[2]}, rows=rows("versions > 1")))
        return found


@register
class IdentifierMetadata(Detector):
    name = "identifier_metadata"

    def needs(self, c):  # noqa: ANN001, ANN201
        return (c.identifier or "", c.compare_to or "")

    @staticmethod
    def wrong(df: DataFrame, c: Context) -> Column:
        year = F.regexp_extract(_string(df, c.identifier), c.pattern, 1).try_cast("int")
        return year != F.year(cell(df, c.compare_to).time)

    def requests(self, df, c):  # noqa: ANN001, ANN201
        return {"n": F.count_if(self.wrong(df, c))}

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        return [Issue(f"ID-META-{c.identifier}", "identifier_metadata_mismatch", S.HIGH_WARNING, (c.identifier, c.compare_to), 0.99, v["n"], (Treatment("flag_for_review", 0.35, domain_rule=True),), rows=lambda d: self.wrong(d, c))] if v["n"] else []


def dominant_layout(df: DataFrame, column: str) -> str | None:
    """The layout most texts with a single layout have; ties go to the first in reading order."""
    layouts = F.array_distinct(F.transform(date_readings(_string(df, column)), lambda r: r["layout"]))
    votes = df.select(layouts.alias("l"), F.col(ROW)).filter(F.size("l") == 1).groupBy(F.col("l")[0].alias("layout")).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first")).orderBy(F.desc("n"), "first").limit(1).first()
    return votes["layout"] if votes else None


@register
class DateIntegrity(Detector):
    name = "date_integrity"

    def needs(self, c):  # noqa: ANN001, ANN201
        return c.date_columns or ("",)

    @staticmethod
    def status(df: DataFrame, column: str, layout: str | None) -> Column:
        s = _string(df, column)
        return F.when(s.isNotNull(), date_status(date_readings(s), F.lit(layout).cast("string")))

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        found = []
        for x in [x for x in c.date_columns if x in _texts(df)]:
            layout = dominant_layout(df, x)
            counts = {r[0]: r[1] for r in df.groupBy(self.status(df, x, layout)).count().collect()}
            native = 0 if df.schema[x].dataType != MIXED else df.filter(F.col(f"`{x}`.t").isNotNull()).count()
            rows = lambda s, x=x, layout=layout: lambda d: self.status(d, x, layout) == s
            if not native and (ok := counts.get("ok", 0) + counts.get("format_conflict", 0)):
                found.append(Issue(f"DATE-UNPARSED-{x}", "mixed_physical_type", S.WARNING, (x,), 1.0, ok, (Treatment("parse_datetime_unambiguous", 0.99, parameters={"layout": layout}),), rows=lambda d, x=x, layout=layout: self.status(d, x, layout).isin("ok", "format_conflict")))
            if n := counts.get("invalid", 0):
                found.append(Issue(f"DATE-INVALID-{x}", "invalid_date", S.CRITICAL_REVIEW, (x,), 1.0, n, rows=rows("invalid")))
            if n := counts.get("ambiguous", 0):
                found.append(Issue(f"DATE-AMBIGUOUS-{x}", "ambiguous_date", S.HIGH_WARNING, (x,), 1.0, n, (Treatment("apply_dominant_layout", 0.72), Treatment("quarantine_for_review", 0.60)), details={"layout": layout}, rows=rows("ambiguous")))
            if n := counts.get("format_conflict", 0):
                found.append(Issue(f"DATE-FORMAT-CONFLICT-{x}", "ambiguous_date", S.NOTICE, (x,), 0.95, n, (Treatment("accept_unambiguous_parse", 0.96, parameters={"layout": layout}),), details={"layout": layout}, rows=rows("format_conflict")))
        return found


@register
class UnicodeConfusable(Detector):
    name = "unicode_confusable"

    def requests(self, df, c):  # noqa: ANN001, ANN201
        return {x: F.count_if(has_confusable(_string(df, x))) for x in _texts(df)}

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        return [
            Issue(f"UNICODE-{x}", "unicode_confusable", S.HIGH_WARNING, (x,), 0.99, v[x], (Treatment("fold_confusables", 0.97),), details={"characters": len(CONFUSABLES) + len(INVISIBLE)}, rows=lambda d, x=x: has_confusable(_string(d, x)))
            for x in _texts(df)
            if v[x]
        ]


@register
class CategoryVariant(Detector):
    name = "category_variant"

    def requests(self, df, c):  # noqa: ANN001, ANN201
        return {x: F.approx_count_distinct(_string(df, x)) for x in c.categorical or _texts(df) if x in _texts(df)}

    @staticmethod
    def levels(df: DataFrame, columns: list[str]) -> dict[str, list[tuple[str, int, str, str]]]:
        """{column: (text, count, loose key, strict key)} of the columns with at most ``MAX_LEVELS`` levels; one grouped job for all of them."""
        if not columns:
            return {}
        pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("c"), _string(df, x).alias("v")) for x in columns])).alias("p")
        counted = df.select(pairs).filter("p.v is not null").groupBy("p.c", "p.v").agg(F.count(F.lit(1)).alias("n"))
        plain = lambda e: F.regexp_replace(F.lower(e), r"[^\p{L}\p{N}]", "")
        found: dict[str, list] = {x: [] for x in columns}
        for r in counted.select("c", "v", "n", plain(unconfused(unaccented("v"))).alias("loose"), plain(unconfused(F.col("v"))).alias("strict")).limit(len(columns) * 4 * MAX_LEVELS).collect():
            found[r["c"]].append((r["v"], r["n"], r["loose"], r["strict"]))
        return {x: sorted(rows) for x, rows in found.items() if len(rows) <= MAX_LEVELS}

    @staticmethod
    def graded(levels: list[tuple[str, int, str, str]]) -> tuple[dict[str, str], dict[str, str]]:
        """(mechanical, semantic) merges: text to the most frequent, then shortest text of its cluster. Mechanical if only case, punctuation, blanks or look-alikes differ."""
        mechanical, semantic = {}, {}
        clusters: dict[str, list] = {}
        for r in levels:
            clusters.setdefault(r[2], []).append(r)
        best = lambda rows: min(rows, key=lambda r: (-r[1], len(r[0]), r[0]))
        for rows in clusters.values():
            winner = best(rows)
            for r in rows:
                if r[0] != winner[0]:
                    (mechanical if r[3] == winner[3] else semantic)[r[0]] = winner[0]
        for (ka, a), (kb, b) in itertools.combinations(sorted(clusters.items()), 2):
            if min(len(ka), len(kb)) >= NEAR_LENGTH and similarity(ka, kb) >= NEAR:
                heavy, light = (a, b) if sum(r[1] for r in a) >= sum(r[1] for r in b) else (b, a)
                semantic |= {r[0]: best(heavy)[0] for r in light}
        return mechanical, semantic

    def findings(self, df, c, v):  # noqa: ANN001, ANN201
        found = []
        # The sketch's error is far below the factor of two that it is given here.
        for x, levels in self.levels(df, [x for x, n in v.items() if n <= 2 * MAX_LEVELS]).items():
            mechanical, semantic = self.graded(levels)
            if not mechanical and not semantic:
                continue
            counts = {r[0]: r[1] for r in levels}
            treatments = []
            if mechanical:
                treatments.append(Treatment("canonicalise_mechanical", 0.99, parameters={"mapping": mechanical}))
            if semantic:
                treatments.append(Treatment("merge_semantic_variants", 0.80, irreversible=True, parameters={"mapping": semantic}))
            every = [*mechanical, *semantic]
            found.append(Issue(f"CAT-{x}", "category_variant", S.WARNING, (x,), 0.99, sum(counts[k] for k in every), tuple(treatments), details={"mechanical": mechanical, "semantic": semantic}, rows=lambda d, x=x, every=every: _string(d, x).isin(*every)))
        return found


Progress = Callable[[str, int, int], None]
