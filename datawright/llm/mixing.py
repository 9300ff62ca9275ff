"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` times all
words; no target passes ``cap`` times its source's words, and the excess is shared again by weight.
With caps sorted by cap/weight this is one prefix sum over the sources: no iteration.

Selection: a document's exponential key is ``-ln(u) / quality`` with ``u`` from a hash of its id, so
reruns agree. A target takes its complete epochs first; what is left of it goes to the documents in
order of their keys until the words are used up, the last one in part. The order within a source is
never sorted in one task: keys fall into ``bins`` ordered bins, words are summed for each bin and for each ``STEP`` bins, and a
document's place is the prefix of its step, plus that of its bin within the step, plus its place within the bin.

Nulls: a null text has 0 words; a null source is a source of its own, the last; a null id hashes as
an empty string. Sources without words get target 0. Repeated rows with one id are taken one after
another in an undefined but harmless order (their sizes decide). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged, tagged, unused, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Ordered key bins of a source; a bin of a source with a billion documents holds about 15,000.
BINS = 65_536
#: Bins that are added up together: no prefix sum runs over more rows than this or ``BINS / STEP``.
STEP = 256


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """Quality weight in [0.05, 1]: short texts and texts with many of ``#*$%&|<>`` weigh less."""
    chars = F.greatest(F.lit(1), F.length(text))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(8.0) * symbols / chars) * (F.least(size, F.lit(200)) + F.lit(10)) / F.lit(210.0), F.lit(0.05))


def uniform(id_: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the id."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per_source.select("source", "source_size", weight.alias("weight")).withColumn("top", F.col("source_size") * F.lit(cap))
    by_ratio = W.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    summed = ranked.select(
        "*",
        F.coalesce(F.sum("top").over(before), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
        (F.sum("source_size").over(every) * F.lit(share)).alias("total"),
        F.row_number().over(by_ratio).alias("at"),
    )
    # The level at which the sources from here on share what the capped ones before leave; the first that holds it is the level of all.
    level = ((F.col("total") - F.col("full")) / F.col("open")).alias("level")
    held = summed.select("*", level).select("*", (F.col("level") <= F.col("top") / F.col("weight")).alias("holds"))
    first = held.select("*", F.min_by("level", F.when(F.col("holds"), F.col("at"))).over(every).alias("final"), F.min(F.when(F.col("holds"), F.col("at"))).over(every).alias("final_at"))
    return first.select("source", "source_size", F.when(F.col("final_at").isNull() | (F.col("at") < F.col("final_at")), F.col("top")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """(id, source, size, source_size, target, taken) for every document."""
    return _mixed(docs, F.col(id_col), text_col, source_col, weights, share, cap, seed, bins).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def _mixed(docs: DataFrame, id_: Column, text_col: str, source_col: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, bins: int = BINS, tag: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken) for every document, and ``tag`` if there is one."""
    own = [] if tag is None else [tag]
    size = size_of(F.col(text_col))
    sized = staged(
        docs.select(id_.alias("id"), *own, F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), size.alias("size")).select(
            "id", *own, "source", "size", (-F.log(uniform(F.col("id"), seed)) / quality_of(F.col("text"), F.col("size"))).alias("key")
        ),
        "mixing",
    )
    # exp(-key) falls as the key grows; its bins are in the keys' order.
    sized = sized.withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(bins)))
    per_bin = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    step = F.floor(F.col("bin") / STEP)
    before = lambda column, by, order: F.coalesce(F.sum(column).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = per_bin.groupBy("source", step.alias("step")).agg(F.sum("bin_size").alias("step_size"))
    steps = steps.select(F.col("source").alias("t_source"), F.col("step").alias("t_step"), before("step_size", ["source"], "step").alias("step_start"))
    inside_step = per_bin.select("source", "bin", step.alias("step"), "bin_size").select("source", "bin", "step", before("bin_size", ["source", "step"], "bin").alias("bin_start"))
    starts = inside_step.join(steps, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("step") == F.col("t_step"))).select("source", "bin", (F.col("step_start") + F.col("bin_start")).alias("start"))
    within = W.partitionBy("source", "bin").orderBy("key", "id", "size", *own).rowsBetween(W.unboundedPreceding, -1)
    placed = sized.select("id", *own, "source", "size", "bin", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("inside"))
    s, a = starts.withColumnRenamed("source", "s_source").withColumnRenamed("bin", "s_bin"), aims.withColumnRenamed("source", "a_source")
    joined = placed.join(s, placed["source"].eqNullSafe(s["s_source"]) & (placed["bin"] == s["s_bin"])).join(a, placed["source"].eqNullSafe(a["a_source"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size") - F.col("start") - F.col("inside")
    return joined.select("id", *own, "source", "size", "source_size", "target", (epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), left))).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, whole texts: a document appears as often as it is taken, a part of at least half counting as a whole. Ids may be null or repeated."""
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    every, tag = tagged(docs, "documents")
    copy = unused(every.columns, "copy")
    taken = _mixed(every, F.col(id_col), text_col, source_col, **options, tag=tag).select(tag, copies.alias(copy)).filter(F.col(copy) > 0)
    kept, columns = every.join(taken, tag), [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns, F.explode(F.sequence(F.lit(1), F.col(copy))).alias(copy)).select(*columns)


#: DuckDB SQL of op9's rows.
SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / (greatest(0.05, 1.0 - 8.0 * (length(body) - length(translate(body, '#*$%&|<>', '')))::DOUBLE / greatest(1, length(body))::DOUBLE)
       * (least(size, 200) + 10)::DOUBLE / 210.0) AS key
  FROM sized),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS top FROM src),
summed AS (
  SELECT *, coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS open_weight,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
    row_number() OVER (ORDER BY top / weight, source NULLS LAST) AS pos
  FROM ranked),
held AS (SELECT *, (total - filled) / open_weight AS lvl FROM summed),
final AS (SELECT min(pos) AS pos0, min_by(lvl, pos) AS lvl0 FROM held WHERE lvl <= top / weight),
aims AS (SELECT source, source_size, CASE WHEN pos0 IS NULL OR pos < pos0 THEN top ELSE lvl0 * weight END::DOUBLE AS target FROM held, final),
placed AS (
  SELECT k.doc_id, k.source, k.size, a.source_size, a.target,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
    CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size)::BIGINT ELSE 0 END AS epochs
  FROM keyed k JOIN aims a ON k.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, source, size, source_size, target,
  (epochs * size + least(size, greatest(0, floor(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken
FROM placed
"""
