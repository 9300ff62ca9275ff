"""Record linkage within a table: block, compare, keep the best pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.cells import folded, plain_fold, text_similarity
from ..sources.frames import ROW, checkpoint_dir

MOST_PAIRS, LIMIT, MINIMUM, PREFIX = 2_000_000, 500, 0.7, 4
#: How far below 1 the best pairs are looked for, one after the other, before the minimum itself.
STEPS = (1e-9, 0.001, 0.01, 0.03, 0.08, 0.2)
#: Rows of a group that meet as many others at once, and what bounds on scores may lose by rounding.
PART, SLACK = 2_000, 1e-9


class BlockTooLarge(ValueError):
    """A block would make more pairs than are compared."""


def block_key(c: Column, prefix: int = PREFIX, unicode: bool = True) -> Column:
    """First characters of the folded text; an empty or missing text has a block of its own."""
    form = folded(c.cast("string")) if unicode else plain_fold(c.cast("string"))
    return F.coalesce(F.when(form != "", F.substring(form, 1, prefix)), F.lit("\0"))


def blocks(df: DataFrame, block_on: str, prefix: int = PREFIX, unicode: bool = True) -> DataFrame:
    """(block, n, pairs)."""
    return df.groupBy(block_key(F.col(block_on), prefix, unicode).alias("block")).agg(F.count(F.lit(1)).alias("n")).select("block", "n", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))


def compare(left: Column, right: Column, kind: T.DataType, unicode: bool = True) -> Column:
    """0.5 if either is missing; for numbers 1 less their relative distance; for texts 1 if their folded forms agree, else their similarity."""
    if isinstance(kind, T.NumericType):
        a, b = left.cast("double"), right.cast("double")
        score = F.greatest(F.lit(0.0), F.nanvl(1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), F.lit(0.0)))
    else:
        score = F.when(left == right, 1.0).otherwise(text_similarity(F.when(left != right, left), right) if unicode else F.lit(0.0))
    return F.when(left.isNull() | right.isNull(), 0.5).otherwise(score)


def link(df: DataFrame, fields: list[str], block_on: str | None = None, prefix: int = PREFIX, minimum: float = MINIMUM, limit: int = LIMIT, key: str = ROW, unicode: bool = True, whole: bool = False) -> DataFrame:
    """(left, right, score, one column per field): the ``limit`` best pairs within blocks with a mean field score of at least ``minimum``.

    A block of over ``MOST_PAIRS`` pairs is refused before any pair is made, as its key tells too little apart; with ``whole``, blocks of any size are searched. With
    ``unicode`` off, texts are folded by built-ins and compared for equality. Numbers that are not a number are missing.
    """
    block_on = block_on or fields[0]
    kinds = [df.schema[f].dataType for f in fields]
    number = lambda f, kind: F.when(~F.isnan(f), F.col(f)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(f)
    form = lambda f, kind: number(f, kind) if isinstance(kind, T.NumericType) else folded(F.col(f).cast("string")) if unicode else plain_fold(F.col(f).cast("string"))
    keyed = df.select(F.col(key).alias("id"), block_key(F.col(block_on), prefix, unicode).alias("block"), *[form(f, kind).alias(f"f{k}") for k, (f, kind) in enumerate(zip(fields, kinds, strict=True))])
    worst, pairs = keyed.groupBy("block").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2), F.lit(0.0))).first()
    if not whole and worst * (worst - 1) // 2 > MOST_PAIRS:
        raise BlockTooLarge(f"the largest block has {worst} rows; block on a column that tells more apart, or on a longer prefix")
    if pairs > MOST_PAIRS:
        return _searched(keyed, fields, kinds, minimum, limit, unicode)
    left, right = _sides(keyed, ["block"])
    return _best(left.join(right, "block").filter("l_id < r_id"), fields, kinds, minimum, limit, unicode)


def _sides(rows: DataFrame, shared: list[str]) -> list[DataFrame]:
    return [rows.select(*shared, *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c not in shared]) for s in "lr"]


def _best(pairs: DataFrame, fields: list[str], kinds: list[T.DataType], minimum: float, limit: int, unicode: bool) -> DataFrame:
    scored = pairs.select(F.col("l_id").alias("left"), F.col("r_id").alias("right"), *[compare(F.col(f"l_f{k}"), F.col(f"r_f{k}"), kinds[k], unicode).alias(f"score_{f}") for k, f in enumerate(fields)])
    mean = sum((F.col(f"score_{f}") for f in fields), F.lit(0.0)) / len(fields)
    return scored.select("left", "right", mean.alias("score"), *[f"score_{f}" for f in fields]).filter(F.col("score") >= minimum).orderBy(F.desc("score"), "left", "right").limit(limit)


def _searched(keyed: DataFrame, fields: list[str], kinds: list[T.DataType], minimum: float, limit: int, unicode: bool) -> DataFrame:
    """The best pairs without comparing all: those of at least 1 less a step, for growing steps, until ``limit`` are found or the step reaches ``minimum``.

    Of rows that agree in block and fields those with the ``limit`` + 1 smallest ids stay. No pair of another row is lost: no pair of these rows scores more than they do among
    themselves, and among themselves at least ``limit`` pairs come before any pair with a larger id.
    """
    checkpoint_dir(keyed.sparkSession)
    alike = W.partitionBy("block", *[f"f{k}" for k in range(len(fields))]).orderBy("id")
    rows = keyed.filter("id IS NOT NULL").withColumn("nth", F.dense_rank().over(alike)).filter(F.col("nth") <= limit + 1).drop("nth").checkpoint()
    texts = [f"f{k}" for k, kind in enumerate(kinds) if not isinstance(kind, T.NumericType)]
    longest = max((n or 0 for n in rows.agg(*[F.max(F.length(c)) for c in texts]).first()), default=0) if texts else 0
    for step in (*STEPS, None):
        least = minimum if step is None else max(minimum, 1 - step)
        each = len(fields) * least - (len(fields) - 1) - SLACK  # as no field scores over 1
        similar = unicode and (each <= 0.5 or 2 * longest * (1 - each) >= 1)  # else different texts are bound to score less
        found = _best(_promising(rows, kinds, least, each, similar), fields, kinds, least, limit, similar).checkpoint()
        if least == minimum or found.count() >= limit:
            return found
    raise AssertionError("the last step is the minimum")


def _promising(rows: DataFrame, kinds: list[T.DataType], least: float, each: float, similar: bool) -> DataFrame:
    """All pairs within blocks that can have a mean score of at least ``least``, so at least ``each`` in every field, and others.

    Where ``each`` is over 0.5, rows with a missing field drop out, the band of the first number is part of the join key, and so are texts unless ``similar`` ones may do.
    Groups of over ``PART`` rows are cut into parts, and each part meets each.
    """
    keys, banded = ["block"], False
    if each > 0.5:
        for k, kind in enumerate(kinds):
            c = F.col(f"f{k}")
            rows = rows.filter(F.abs(c.cast("double")) < F.lit(math.inf) if isinstance(kind, T.NumericType) else c.isNotNull())
            if not isinstance(kind, T.NumericType) and not similar:
                rows, keys = rows.withColumn(f"k{k}", c), [*keys, f"k{k}"]
            elif isinstance(kind, T.NumericType) and not banded:
                rows, banded = rows.withColumn("band", _band(c.cast("double"), 1 - each)), True
    groups = rows.groupBy(*keys, *["band"] * banded).agg(F.count(F.lit(1)).alias("rows"))
    worst, work = groups.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.sum(F.col("rows").cast("double") * F.col("rows")), F.lit(0.0))).first()
    if worst > PART:  # parts by the rows of a key and, with bands, of the fullest of its bands
        parts = groups.groupBy(*keys).agg(F.ceil(F.max("rows") / PART).cast("int").alias("parts"))
        rows = rows.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    shared = [*keys, *["band"] * banded, *["parts", "part"] * (worst > PART)]
    left, right = _sides(rows, shared)
    if banded:
        right = right.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    on = [*keys, *["band"] * banded]
    if worst > PART:
        every, on = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), [*on, "l_part", "r_part"]
        left, right = (side.withColumnRenamed("part", f"{s}_part").withColumn(f"{o}_part", every).drop("parts") for side, s, o in ((left, "l", "r"), (right, "r", "l")))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, math.ceil(work / PART**2)))
    left, right = (side.repartition(tasks, *on) for side in (left, right))
    bounds = [_bound(F.col(f"l_f{k}"), F.col(f"r_f{k}"), kind, similar) for k, kind in enumerate(kinds)]
    cheap, close = (sum((b[i] for b in bounds), F.lit(0.0)) / len(kinds) >= least - SLACK for i in (0, 1))
    return left.hint("merge").join(right, on).filter((F.col("l_id") < F.col("r_id")) & F.when(cheap, close).otherwise(False))


def _band(x: Column, apart: float) -> Column:
    """Numbers with a relative distance of at most ``apart`` (under 1) lie in the same band or in neighbouring ones.

    On the scale that is linear up to 1 and logarithmic beyond, they are at most -ln(1 - ``apart``) apart; bands are wider by a hundredth for rounding.
    """
    scale = F.signum(x) * F.log(F.greatest(F.abs(x), F.lit(1.0))) + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return F.floor(scale / (-1.01 * math.log1p(-max(apart, SLACK))))


def _bound(left: Column, right: Column, kind: T.DataType, unicode: bool) -> tuple[Column, Column]:
    """What the score cannot exceed, by lengths alone and by edit distance: matching blocks are a common subsequence, and what it leaves out of both texts is at least their edit distance."""
    if isinstance(kind, T.NumericType) or not unicode:
        score = compare(left, right, kind, unicode)
        return score, score
    a, b = F.length(left), F.length(right)
    by = lambda most: F.when(left.isNull() | right.isNull(), 0.5).when(left == right, 1.0).otherwise(most)
    return by(2 * F.least(a, b) / (a + b)), by(1 - F.levenshtein(left, right) / (a + b))


@dataclass(frozen=True)
class Recall:
    compared: int
    total: int

    @property
    def note(self) -> str:
        return f"{self.compared} of {self.total} pairs were compared; links across blocks are not found"


def recall(df: DataFrame, block_on: str, prefix: int = PREFIX, unicode: bool = True) -> Recall:
    r = blocks(df, block_on, prefix, unicode).agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Recall(r[0], r[1] * (r[1] - 1) // 2)
