"""What a single cell is: missing, its storage form, its number, text and time.

Columns of one type have one form, known from the schema. Columns whose cells differ in type are loaded as
``MIXED``: a struct with the form and one payload. All builders are Catalyst expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that is a number once trimmed and freed of commas. Underscores and type suffixes are no part of numbers.
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
#: Digits with thousands separators.
FORMATTED = r"^[+-]?[\d,]+(\.\d+)?$"
MIXED = T.StructType([T.StructField("form", T.StringType()), T.StructField("s", T.StringType()), T.StructField("d", T.DoubleType()), T.StructField("t", T.TimestampType())])

FAMILY = {"int": "number", "float": "number", "numeric-string": "number", "formatted-numeric-string": "number", "bool": "bool", "datetime": "temporal", "date": "temporal", "string": "text"}
_INT, _FLOAT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType, T.DecimalType)
UNSUPPORTED = (T.ArrayType, T.MapType, T.BinaryType, T.StructType)


def clean_nan(c: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def text_number(c: Column) -> Column:
    """Number of a text, null if it is none. Infinities count as numbers, nan does not."""
    plain = F.regexp_replace(F.trim(c), ",", "")
    return F.when(plain.rlike(NUMBER) & ~F.lower(plain).endswith("nan"), plain.try_cast("double"))


def text_form(c: Column) -> Column:
    """Storage form of a present text."""
    return F.when(F.trim(c).rlike(NUMBER), "numeric-string").when(F.trim(c).rlike(FORMATTED) & text_number(c).isNotNull(), "formatted-numeric-string").otherwise("string")


@dataclass(frozen=True)
class Cell:
    """The four views of a column's cells, and their test for absence."""

    missing: Column
    form: Column
    number: Column
    text: Column
    time: Column


def cell(df: DataFrame, name: str) -> Cell:
    """The views of a column; built once for each DataFrame, as building them is what costs on the driver."""
    built = df.__dict__.setdefault("_datawright_cells", {})
    if name not in built:
        built[name] = _cell(df, name)
    return built[name]


def _cell(df: DataFrame, name: str) -> Cell:
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    none = lambda t: F.lit(None).cast(t)
    if kind == MIXED:
        form = F.coalesce(c["form"], F.lit("missing"))
        number = F.coalesce(F.when(form != "bool", c["d"]), text_number(c["s"]))
        return Cell(form == "missing", form, number, F.coalesce(c["s"], c["d"].cast("string"), c["t"].cast("string")), c["t"])
    if isinstance(kind, T.StringType):
        return Cell(c.isNull(), F.when(c.isNull(), "missing").otherwise(text_form(c)), text_number(c), c, none("timestamp"))
    value = clean_nan(c, kind)
    wrap = lambda form: F.when(value.isNull(), "missing").otherwise(form)
    if isinstance(kind, _INT):
        return Cell(value.isNull(), wrap("int"), value.cast("double"), value.cast("string"), none("timestamp"))
    if isinstance(kind, _FLOAT):
        value = value + F.lit(0.0) if not isinstance(kind, T.DecimalType) else value
        return Cell(value.isNull(), wrap("float"), value.cast("double"), value.cast("string"), none("timestamp"))
    if isinstance(kind, T.BooleanType):
        return Cell(value.isNull(), wrap("bool"), none("double"), value.cast("string"), none("timestamp"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Cell(value.isNull(), wrap("datetime"), none("double"), value.cast("string"), value.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return Cell(value.isNull(), wrap("date"), none("double"), value.cast("string"), value.cast("timestamp"))
    if isinstance(kind, T.DayTimeIntervalType):
        seconds = F.expr(f"CAST(extract(DAY FROM `{name}`) * 86400 + extract(HOUR FROM `{name}`) * 3600 + extract(MINUTE FROM `{name}`) * 60 AS DOUBLE) + CAST(extract(SECOND FROM `{name}`) AS DOUBLE)")
        return Cell(value.isNull(), wrap("timedelta"), seconds, value.cast("string"), none("timestamp"))
    return Cell(value.isNull(), wrap(kind.typeName()), none("double"), F.to_json(F.struct(value)), none("timestamp"))


def is_missing(df: DataFrame, name: str) -> Column:
    return cell(df, name).missing


def number(df: DataFrame, name: str) -> Column:
    """The column's finite or infinite numbers as double; null where a cell is no number."""
    return cell(df, name).number


def text(df: DataFrame, name: str) -> Column:
    return cell(df, name).text


def mixed(form: Column, s: Column | None = None, d: Column | None = None, t: Column | None = None) -> Column:
    """A mixed cell from one payload; ``form`` is null for a missing cell."""
    pick = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(form.alias("form"), pick(s, "string").alias("s"), pick(d, "double").alias("d"), pick(t, "timestamp").alias("t"))


def non_ascii(c: Column) -> Column:
    """Characters beyond ASCII."""
    return F.regexp_extract_all(c, F.lit("[^\\x00-\\x7F]"), F.lit(0))


def in_range(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Closed range; a missing bound or cell passes."""
    fine = F.lit(True)
    if low is not None:
        fine = fine & (c >= F.lit(low))
    if high is not None:
        fine = fine & (c <= F.lit(high))
    return c.isNull() | fine


def expression(rule: str) -> Column:
    """A rule in Spark SQL; ``==``, ``!=``, ``&``, ``|``, ``~`` are read as ``=``, ``<>``, AND, OR, NOT. Null counts as false."""
    sql = rule.replace("==", "=").replace("!=", "<>").replace("&", " AND ").replace("|", " OR ").replace("~", " NOT ")
    return F.coalesce(F.expr(sql), F.lit(False))


# Dates ------------------------------------------------------------------------------------------------

# Accepted date patterns and the field order that each implies.
DATE_FORMATS = (("yyyy-M-d", "iso"), ("yyyy/M/d", "iso"), ("d/M/yyyy", "day_first"), ("d-M-yyyy", "day_first"), ("d.M.yyyy", "day_first"), ("M/d/yyyy", "month_first"), ("M-d-yyyy", "month_first"), ("M.d.yyyy", "month_first"))


def date_readings(c: Column) -> Column:
    """array<struct<layout, value>> of every reading of a text as a date."""
    trimmed = F.trim(c)
    shaped = trimmed.rlike(r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$")
    each = F.array(*[F.struct(F.lit(layout).alias("layout"), F.try_to_date(trimmed, f).alias("value")) for f, layout in DATE_FORMATS])
    return F.when(shaped, F.filter(each, lambda r: r["value"].isNotNull())).otherwise(F.filter(each, lambda r: F.lit(False)))


def date_status(readings: Column, dominant: Column) -> Column:
    """``invalid``, ``ok``, ``ambiguous`` or ``format_conflict`` of a text with its readings, given the column's dominant layout (may be null)."""
    layouts, values = F.array_distinct(F.transform(readings, lambda r: r["layout"])), F.array_distinct(F.transform(readings, lambda r: r["value"]))
    single_conflict = (F.size(layouts) == 1) & (layouts[0] != "iso") & dominant.isNotNull() & (dominant != "iso") & (layouts[0] != dominant)
    return F.when(F.size(readings) == 0, "invalid").when(single_conflict, "format_conflict").when(F.size(values) == 1, "ok").otherwise("ambiguous")


# Texts ------------------------------------------------------------------------------------------------

# Look-alikes of ASCII characters and characters that cannot be seen.
CONFUSABLES = {"ı": "i", "İ": "I", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "һ": "h", "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "Х": "X", "‐": "-", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"'}
INVISIBLE = "​‌‍﻿   "


def has_confusable(c: Column) -> Column:
    return c.rlike("[" + "".join(CONFUSABLES) + INVISIBLE + "]")


def unconfused(c: Column) -> Column:
    """Look-alikes as ASCII, unseen characters dropped."""
    return F.translate(c, "".join(CONFUSABLES) + INVISIBLE, "".join(CONFUSABLES.values()))


@F.pandas_udf(T.StringType())
def unaccented(values):  # noqa: ANN001, ANN201
    """NFKD without combining marks; for distinct values, as Spark has no such built-in."""
    import unicodedata

    return values.map(lambda v: None if v is None else "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch)))


@F.pandas_udf(T.StringType())
def folded(values):  # noqa: ANN001, ANN201
    """Comparison form: NFKD without marks, white space collapsed, case folded; scripts are kept."""
    import unicodedata

    def one(v: str) -> str:
        bare = "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch))
        return " ".join(bare.split()).casefold()

    return values.map(lambda v: None if v is None else one(v))


def plain_fold(c: Column) -> Column:
    """The comparison form for texts without marks: trimmed, collapsed, lower case. Built-in only."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def category_key(c: Column) -> Column:
    """Letters and digits of the unconfused lower-case text (marks are taken off by ``unaccented`` before, if wanted)."""
    return F.regexp_replace(F.lower(unconfused(c)), r"[^\p{L}\p{N}]", "")


def similarity(left: str, right: str) -> float:
    """Ratio of matching blocks of two texts, in [0, 1]."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, left, right).ratio()


@F.pandas_udf(T.DoubleType())
def text_similarity(left, right):  # noqa: ANN001, ANN201
    import pandas as pd

    return pd.Series([None if a is None or b is None else similarity(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")
