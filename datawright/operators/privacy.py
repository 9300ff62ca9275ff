"""Personal data: detection, risk, and the transformations that hide it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import is_missing
from ..sources.frames import ROW


def luhn(c: Column) -> Column:
    """12 to 19 digits with a valid check digit, blanks and dashes ignored."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def plausible_phone(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", "")).between(7, 15)


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Kind, sensitivity, pattern of the whole value, pattern inside a text (or none), confidence.
KINDS = (
    ("email", "direct_identifier", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", r"[\w.+-]+@[\w-]+\.[A-Za-z]{2,}", 0.97),
    ("credit_card", "sensitive", r"^[\d\s-]{12,25}$", r"\b(?:\d[ -]?){12,19}\b", 0.95),
    ("iban", "sensitive", r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", 0.9),
    ("phone", "direct_identifier", r"^\+?[\d][\d\s().-]{5,17}\d$", None, 0.75),
    ("ipv4", "quasi_identifier", rf"^(?:{_OCTET}\.){{3}}{_OCTET}$", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0.95),
    ("national_id", "direct_identifier", r"^\d{3}-?\d{2}-?\d{4}$", None, 0.6),
    ("postcode", "quasi_identifier", r"^\d{4,6}$|^[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$", None, 0.5),
)
VALIDATORS = {"credit_card": luhn, "phone": plausible_phone}
# Parts of column names that point to personal data.
NAME_HINTS = {
    "name": "direct_identifier", "surname": "direct_identifier", "firstname": "direct_identifier", "lastname": "direct_identifier", "email": "direct_identifier", "phone": "direct_identifier", "address": "direct_identifier",
    "passport": "direct_identifier", "ssn": "direct_identifier", "iban": "sensitive", "salary": "confidential", "birth": "quasi_identifier", "dob": "quasi_identifier", "gender": "quasi_identifier", "postcode": "quasi_identifier",
    "zip": "quasi_identifier", "city": "quasi_identifier", "ethnicity": "sensitive", "religion": "sensitive", "health": "sensitive", "diagnosis": "sensitive",
}
TYPED_AT = 0.5


def whole_match(c: Column, kind: str) -> Column:
    pattern = next(k[2] for k in KINDS if k[0] == kind)
    fits = F.trim(c).rlike(pattern)
    return F.coalesce(fits & VALIDATORS[kind](F.trim(c)) if kind in VALIDATORS else fits, F.lit(False))


def embedded_match(c: Column, kind: str) -> Column:
    """Whether a text holds a valid match; false for kinds that are only sought as whole values."""
    pattern = next(k[3] for k in KINDS if k[0] == kind)
    if pattern is None:
        return F.lit(False)
    if kind in VALIDATORS:
        return F.coalesce(F.exists(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), VALIDATORS[kind]), F.lit(False))
    return F.coalesce(c.rlike(pattern), F.lit(False))


def match_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, present, whole, embedded): one aggregate over all text columns and kinds."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    each = [F.struct(F.lit(c).alias("column"), F.lit(k[0]).alias("kind"), F.count(F.col(c)).alias("present"), F.count_if(whole_match(F.col(c), k[0])).alias("whole"), F.count_if(embedded_match(F.col(c), k[0])).alias("embedded")) for c in names for k in KINDS]
    return df.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@dataclass(frozen=True)
class PrivacyFinding:
    column: str
    kind: str
    sensitivity: str
    confidence: float
    rate: float
    rows: int
    embedded: bool = False
    from_name: bool = False


@dataclass
class PrivacyReport:
    findings: list[PrivacyFinding] = field(default_factory=list)

    def columns(self, sensitivity: str) -> list[str]:
        return sorted({f.column for f in self.findings if f.sensitivity == sensitivity})


def scan(df: DataFrame, typed_at: float = TYPED_AT) -> PrivacyReport:
    """Types a column by its best kind if enough whole values match; else reports matches inside texts; else goes by the column's name."""
    report = PrivacyReport()
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    rates: dict[str, dict[str, tuple[int, int, int]]] = {}
    for r in match_rates(df, names).collect() if names else []:
        rates.setdefault(r["column"], {})[r["kind"]] = (r["present"], r["whole"], r["embedded"])
    for c in [x for x in df.columns if x != ROW]:
        best, inside = None, []
        for kind, sensitivity, _, _, confidence in KINDS:
            present, whole, embedded = rates.get(c, {}).get(kind, (0, 0, 0))
            if whole and whole / present >= typed_at:
                made = PrivacyFinding(c, kind, sensitivity, confidence * whole / present, whole / present, whole)
                best = made if best is None or made.confidence > best.confidence else best
            elif rows := whole or embedded:
                inside.append(PrivacyFinding(c, kind, sensitivity, confidence, rows / present, rows, embedded=True))
        report.findings += inside
        if best is None and not inside:
            hint = next(((h, s) for h, s in NAME_HINTS.items() if h in c.lower()), None)
            if hint and not df.filter(~is_missing(df, c)).isEmpty():
                best = PrivacyFinding(c, hint[0], hint[1], 0.55, 0.0, 0, from_name=True)
        if best:
            report.findings.append(best)
    return report


def reidentification(df: DataFrame, quasi: list[str]) -> DataFrame:
    """(rows, groups, unique_rows, smallest, risk, level): rows alone in their group of quasi-identifiers, nulls being a value of their own."""
    one = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") == 1).alias("unique_rows"), F.min("n").alias("smallest"))
    risk = F.coalesce(F.try_divide("unique_rows", "rows"), F.lit(0.0))
    return one.select("*", risk.alias("risk"), F.when(risk > 0.5, "high").when(risk > 0.1, "medium").otherwise("low").alias("level"))


def mask(c: Column, first: int = 1, last: int = 2, char: str = "*") -> Column:
    """Keeps the first and last characters, of a text with ``@`` what follows it instead; a text no longer than what is kept is hidden whole."""
    s, star = c.cast("string"), F.lit(char)
    local = F.substring_index(s, "@", 1)
    domain = F.substr(s, F.length(local) + 1)
    address = F.concat(F.left(local, F.lit(first)), F.repeat(star, F.greatest(F.length(local) - first, F.lit(1))), domain)
    hidden = F.length(s) - first - last
    plain = F.when(hidden <= 0, F.repeat(star, F.length(s))).otherwise(F.concat(F.left(s, F.lit(first)), F.repeat(star, hidden), F.right(s, F.lit(last))))
    return F.when(F.contains(s, F.lit("@")), address).otherwise(plain)


def redact(c: Column, placeholder: str = "[REDACTED]") -> Column:
    return F.when(c.isNotNull(), F.lit(placeholder))


def hash_value(c: Column, salt: str = "", length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, length)


def generalise(c: Column, bucket: float = 10.0) -> Column:
    """``[low, low + bucket)`` of a number; whole bounds without decimals."""
    low = F.floor(c / F.lit(bucket)) * F.lit(bucket)
    show = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.when(c.isNotNull(), F.concat(F.lit("["), show(low), F.lit(", "), show(low + F.lit(bucket)), F.lit(")")))


def pseudonymise(df: DataFrame, column: str, order: str = ROW, prefix: str = "ID", name: str | None = None) -> DataFrame:
    """Replaces values by numbered names in the order of their first row; equal values stay equal, nulls stay null, and no mapping is kept.

    Distinct values are numbered by prefix sums over ordered buckets, not in one task.
    """
    from .ordering import cumulative

    firsts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.min(order).alias("__o"), F.lit(1).alias("one"))
    numbered = cumulative(firsts, "__o", ["one"]).select("__v", F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("cum_one").cast("string"), 6, "0")).alias("__id"))
    joined = df.join(numbered, df[column] == F.col("__v"), "left")
    return joined.select(*[df[c] for c in df.columns if c != (name or column)], F.col("__id").alias(name or column))
