"""Quality rules with adaptive thresholds, on DataFrame operations alone.

Each document gets its counts; features are whole-number rates made of them. For each language and source a mergeable
quantile sketch of each feature and of the size (logarithmic buckets with exact counts, relative error
``GAMMA - 1``; merging is adding counts) gives its figures: the median, a low quantile, the share of rows that
are not zero and their lower quartile, and the low quantile of the sizes. A document whose feature is over ``median + SPREAD * width``
is rejected; the two-sided feature is also held against the mirror image of that fence. The width is the largest of

* the median less the low quantile: what the lower part of the group varies;
* for features that are mostly zero, the lower quartile of the others times the square of their share: a rare trait says little about what is usual;
* the resolution: what one event (a symbol, a repeated line, a phrase and its repeat, a long word) makes in a short text of the group.

All three come from the group's own sketches, none from a fixed cutoff. Figures are shrunk towards those of the language, and these towards
those of all rows, as if the parent had added ``SHRINK`` rows; so small groups lean on their parent without a switch.
The thresholds, one row for each group, are written and joined to the documents to filter them.

Nulls: a null text has no words and fails the base rules; a null language or source is a group of its own.
Very long texts are handled whole, one row at a time; repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WS_RUN, staged, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
GAMMA = 1.02
SPREAD = 6
#: Rows that a parent's figures count for.
SHRINK = 200
#: Low quantile of the lower spread.
LOW = 0.05
#: Feature: what one event adds to it in a text of one word: a symbol, a five-word phrase with its repeat, a line, a word of 20 characters more.
EVENT = {"symbol_rate": 10_000, "repeat_rate": 100_000, "dup_line_rate": 10_000, "word_length": 2_000}
TWO_SIDED = ("word_length",)
SIZE = "size"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _shift(which: str, value: Column, bits: Column) -> Column:
    return F.call_function(which, value, bits)


def _repeat_starts(packed: Column, w: Column, bits: Column) -> Column:
    """Ascending starts of the 3-word windows that occur at least twice. ``packed``: sorted, a window's hash above its place."""
    low = _shift("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1)
    place = lambda x: x.bitwiseAND(low).cast("int")
    hashed = lambda x, y: F.coalesce(_shift("shiftright", x, bits) == _shift("shiftright", y, bits), F.lit(False))

    def same(x: Column, y: Column) -> Column:
        p, q = place(x), place(y)
        return F.coalesce((F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2)), F.lit(False))

    def repeated(x: Column, j: Column) -> Column:
        before, after = F.get(packed, j - 1), F.get(packed, j + 1)
        near, equal = hashed(x, before) | hashed(x, after), (hashed(x, before) & same(x, before)) | (hashed(x, after) & same(x, after))
        # Other words of the same hash stand next to it: all windows of that hash are compared.
        whole = F.exists(packed, lambda y: hashed(x, y) & (x != y) & same(x, y))
        return F.when(~near, False).when(equal, True).otherwise(whole)

    return F.transform(F.filter(packed, repeated), place)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (long). Their names must be free."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = docs.columns
    step = docs.select("*", words(F.col(text_col)).alias("__w")).select("*", F.size("__w").alias("__n"))
    step = step.select("*", F.length(F.bin(F.col("__n").cast("long"))).alias("__bits"))
    window = lambda i: _shift("shiftleft", F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)), F.col("__bits")).bitwiseOR(i.cast("long"))
    step = step.select("*", F.when(F.col("__n") > 3, F.transform(F.sequence(F.lit(0), F.col("__n") - 3), window)).otherwise(F.array().cast("array<long>")).alias("__h"))
    step = step.select("*", F.sort_array("__h").alias("__s"))
    step = step.select("*", _repeat_starts(F.col("__s"), F.col("__w"), F.col("__bits")).alias("__r"))
    step = step.select("*", F.sort_array("__r").alias("__p"))
    covered = F.aggregate(F.transform("__p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("__p", j + 1) - x, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    step = step.select("*", lines.alias("__lines"))
    return step.select(
        *[F.col(c) for c in keep],
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, WS_RUN, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def features() -> dict[str, Column]:
    n, rate = F.greatest(F.col("n_words"), F.lit(1)), lambda c: F.floor(F.col(c) * 10_000 / F.greatest(F.col("n_words"), F.lit(1)))
    return {"symbol_rate": rate("n_symbols"), "repeat_rate": rate("n_repeat_words"), "dup_line_rate": rate("n_dup_lines"), "word_length": F.floor(F.col("word_chars") * 100 / n)}


def bucket(value: Column, gamma: float = GAMMA) -> Column:
    """Bucket of a whole number >= 0; only that of zero is 0."""
    return F.ceil(F.log(value + F.lit(1.0)) / F.log(F.lit(gamma))).cast("int")


def bucket_value(b: Column, gamma: float = GAMMA) -> Column:
    return F.floor(F.pow(F.lit(gamma), b.cast("double")) - 1.0)


def sketches(counted: DataFrame, keys: tuple[str, ...] = ("lang", "source"), gamma: float = GAMMA) -> DataFrame:
    """(keys, feature, bucket, n): the sketches, of documents that pass the base rules. A sum over keys merges them."""
    passed = counted.filter(~F.col("base_failed"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), bucket(c, gamma).alias("bucket")) for f, c in (features() | {SIZE: F.col("n_words")}).items()]))
    return passed.select(*keys, pairs.alias("p")).groupBy(*keys, "p.feature", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def figures(sketch: DataFrame, keys: tuple[str, ...], gamma: float = GAMMA) -> DataFrame:
    """(keys, feature, rows, others, low, q50, others25) of sketches; ``others`` are the rows that are not zero."""
    by = W.partitionBy(*keys, "feature")
    upto = F.sum("n").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    zero = F.coalesce(F.sum(F.when(F.col("bucket") == 0, F.col("n"))).over(by), F.lit(0))
    cum = sketch.select(*keys, "feature", "bucket", upto.alias("upto"), F.sum("n").over(by).alias("rows"), zero.alias("zero"))
    at = lambda reached: F.coalesce(bucket_value(F.min(F.when(reached, F.col("bucket"))), gamma).cast("double"), F.lit(0.0))
    quantile = lambda q: at(F.col("upto") >= F.col("rows") * F.lit(q))
    others25 = at((F.col("bucket") > 0) & (F.col("upto") - F.col("zero") >= (F.col("rows") - F.col("zero")) * F.lit(0.25)))
    rows, others = F.max("rows").cast("double"), F.max(F.col("rows") - F.col("zero")).cast("double")
    return cum.groupBy(*keys, "feature").agg(rows.alias("rows"), others.alias("others"), quantile(LOW).alias("low"), quantile(0.5).alias("q50"), others25.alias("others25"))


def shrunk(sketch: DataFrame, keys: tuple[str, ...], shrink: float = SHRINK, gamma: float = GAMMA) -> DataFrame:
    """(keys, feature, share, low, q50, others25): the figures of every group, each level shrunk towards the one above."""
    above, names = None, ("share", "low", "q50", "others25")
    for k in range(len(keys) + 1):
        level = keys[:k]
        own = figures(sketch.groupBy(*level, "feature", "bucket").agg(F.sum("n").alias("n")), level, gamma).withColumn("share", F.col("others") / F.col("rows"))
        if above is None:
            above = own.select("feature", *names)
            continue
        on = [own["feature"] == F.col("__feature"), *[own[c].eqNullSafe(F.col(f"__{c}")) for c in keys[: k - 1]]]
        joined = own.join(above.select(*[F.col(c).alias(f"__{c}") for c in above.columns]), on)
        mean = lambda c, rows: ((F.col(rows) * F.col(c) + F.lit(float(shrink)) * F.col(f"__{c}")) / (F.col(rows) + F.lit(float(shrink)))).alias(c)
        above = joined.select(*level, "feature", *[mean(c, "others" if c == "others25" else "rows") for c in names])
    return above


def thresholds(counted: DataFrame, keys: tuple[str, ...] = ("lang", "source"), *, spread: float = SPREAD, shrink: float = SHRINK, gamma: float = GAMMA) -> DataFrame:
    """One row for each group: keys, and for each feature its ``<feature>_hi`` and, if two-sided, ``<feature>_lo``."""
    found = shrunk(staged(sketches(counted, keys, gamma), "sketches"), keys, shrink, gamma)
    figure = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    wide = found.groupBy(*keys).agg(figure(SIZE, "low").alias("short"), *[figure(f, c).alias(f"{f}_{c}") for f in EVENT for c in ("q50", "low", "share", "others25")])
    fences = []
    for f, event in EVENT.items():
        c = lambda name, f=f: F.col(f"{f}_{name}")
        width = F.lit(float(spread)) * F.greatest(c("q50") - c("low"), c("share") * c("share") * c("others25"), F.lit(float(event)) / F.col("short"))
        fences.append(F.floor(c("q50") + width).alias(f"{f}_hi"))
        if f in TWO_SIDED:
            fences.append(F.ceil(c("q50") - width).alias(f"{f}_lo"))
    return wide.select(*keys, *fences)


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _judged(docs: DataFrame, carried: Column, text_col: str, keys: tuple[str, ...], **options) -> DataFrame:
    """(row, keys, counts, ``base_failed``, ``kept``); ``row`` is what ``carried`` holds of each document.

    The counted rows are written once; the fences are few and written too, so that the planner knows their size and
    broadcasts them if they are small: then nothing but sketches is shuffled.
    """
    picked = docs.select(carried.alias("row"), *[F.col(f"`{k}`").cast("string").alias(f"key{i}") for i, k in enumerate(keys)], F.col(f"`{text_col}`").alias("text"))
    names = tuple(f"key{i}" for i in range(len(keys)))
    counted = staged(counts(picked).drop("text").withColumn("base_failed", _base_failed()), "counts")
    fences = staged(thresholds(counted, names, **options), "fences").select(*[F.col(k).alias(f"__{k}") for k in names], *[f"{f}_{s}" for f in EVENT for s in (("hi", "lo") if f in TWO_SIDED else ("hi",))])
    joined = counted.join(fences, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in names], "left")
    within = F.lit(True)
    for f, c in features().items():
        within = within & (c <= F.col(f"{f}_hi"))
        if f in TWO_SIDED:
            within = within & (c >= F.col(f"{f}_lo"))
    return joined.select("row", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"))


def judge(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", **options) -> DataFrame:
    """(id, counts, ``base_failed``, ``kept``) for every document."""
    found = _judged(docs, F.col(f"`{id_col}`"), text_col, keys, **options)
    return found.select(F.col("row").alias(id_col), *COUNTS, "base_failed", "kept")


def filtered(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("lang", "source"), **options) -> DataFrame:
    """The documents that pass, with all their columns. Each row carries its own verdict: ids may be null or repeated."""
    found = _judged(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text_col, keys, **options)
    return found.filter("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: DuckDB SQL of op10's rows.
SQL = """
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS d) WHERE c > 1 GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(body, '[ \\t\\n\\x0b\\f\\r]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\x0b\\f\\r]')) AS ls FROM base) b
  LEFT JOIN cov USING (doc_id)),
flagged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [10000 * n_symbols // greatest(n_words, 1), 10000 * n_repeat_words // greatest(n_words, 1),
     10000 * n_dup_lines // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1), n_words] AS f
  FROM counted),
vals AS (SELECT lang, source, k, ceil(ln(f[k] + 1.0::DOUBLE) / ln(1.02::DOUBLE))::INT AS b FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM flagged WHERE NOT base_failed)),
lev AS (
  SELECT 2 AS l, lang, source, k, b FROM vals
  UNION ALL SELECT 1, lang, NULL, k, b FROM vals
  UNION ALL SELECT 0, NULL, NULL, k, b FROM vals),
sk AS (SELECT l, lang, source, k, b, count(*) AS n FROM lev GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY l, lang, source, k ORDER BY b) AS upto, sum(n) OVER (PARTITION BY l, lang, source, k) AS total,
    coalesce(sum(n) FILTER (b = 0) OVER (PARTITION BY l, lang, source, k), 0) AS zero
  FROM sk),
q AS (
  SELECT l, lang, source, k, max(total)::DOUBLE AS total, max(total - zero)::DOUBLE AS others, max(total - zero)::DOUBLE / max(total)::DOUBLE AS share,
    coalesce(floor(pow(1.02::DOUBLE, min(b) FILTER (upto >= total * 0.05::DOUBLE)) - 1.0), 0.0)::DOUBLE AS low,
    coalesce(floor(pow(1.02::DOUBLE, min(b) FILTER (upto >= total * 0.5::DOUBLE)) - 1.0), 0.0)::DOUBLE AS q50,
    coalesce(floor(pow(1.02::DOUBLE, min(b) FILTER (b > 0 AND upto - zero >= (total - zero) * 0.25::DOUBLE)) - 1.0), 0.0)::DOUBLE AS o25
  FROM cum GROUP BY l, lang, source, k),
s1 AS (
  SELECT a.lang, a.k, (a.total * a.share + 200.0::DOUBLE * p.share) / (a.total + 200.0::DOUBLE) AS share, (a.total * a.low + 200.0::DOUBLE * p.low) / (a.total + 200.0::DOUBLE) AS low,
    (a.total * a.q50 + 200.0::DOUBLE * p.q50) / (a.total + 200.0::DOUBLE) AS q50, (a.others * a.o25 + 200.0::DOUBLE * p.o25) / (a.others + 200.0::DOUBLE) AS o25
  FROM q a JOIN q p ON a.l = 1 AND p.l = 0 AND a.k = p.k),
s2 AS (
  SELECT a.lang, a.source, a.k, (a.total * a.share + 200.0::DOUBLE * p.share) / (a.total + 200.0::DOUBLE) AS share, (a.total * a.low + 200.0::DOUBLE * p.low) / (a.total + 200.0::DOUBLE) AS low,
    (a.total * a.q50 + 200.0::DOUBLE * p.q50) / (a.total + 200.0::DOUBLE) AS q50, (a.others * a.o25 + 200.0::DOUBLE * p.o25) / (a.others + 200.0::DOUBLE) AS o25
  FROM q a JOIN s1 p ON a.l = 2 AND a.lang IS NOT DISTINCT FROM p.lang AND a.k = p.k),
wide AS (
  SELECT a.*, 6.0::DOUBLE * greatest(a.q50 - a.low, a.share * a.share * a.o25, [10000.0::DOUBLE, 100000.0::DOUBLE, 10000.0::DOUBLE, 2000.0::DOUBLE][a.k] / z.low) AS width
  FROM s2 a JOIN s2 z ON z.k = 5 AND a.k < 5 AND a.lang IS NOT DISTINCT FROM z.lang AND a.source IS NOT DISTINCT FROM z.source),
pick AS (SELECT lang, source, k, floor(q50 + width) AS hi, ceil(q50 - width) AS lo FROM wide),
bad AS (
  SELECT DISTINCT doc_id FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM flagged) x
  JOIN pick p ON x.lang IS NOT DISTINCT FROM p.lang AND x.source IS NOT DISTINCT FROM p.source AND x.k = p.k
  WHERE f[x.k] > hi OR (x.k = 4 AND f[x.k] < lo))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM flagged
"""
