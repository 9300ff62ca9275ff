"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of the text digests, one for each partition and merged by addition, find the
digests that may be frequent. An exact count verifies them; the winners of the verified ones, at most
``counters`` rows, are broadcast and mark their copies without a shuffle. All other digests are grouped
by an ordinary shuffle of (digest, id) rows; no text is shuffled.

Nulls count as empty texts. A null id is the smallest id. Of rows that repeat an id within a group, one stays.
An empty table gives an empty result. Further columns of the input are carried through unchanged by
``deduplicate`` and left out of ``dedup_report``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ship, staged, tagged

#: Most counters of a summary, and so most rows that are broadcast (about 100 bytes each).
COUNTERS = 16_384
#: A digest counts as frequent from so many counted copies on.
HEAVY = 64


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Summary of one partition's ``digest`` column: at most ``counters`` (digest, lower bound of its count)."""
    kept: Counter[bytes] = Counter()
    for batch in batches:
        kept.update(batch.column(0).to_pylist())
        if len(kept) > counters:
            cut = sorted(kept.values(), reverse=True)[counters]
            kept = Counter({k: n - cut for k, n in kept.items() if n > cut})
    rows = [(k, n) for k, n in kept.items() if n > 1]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["digest", "n"])


def frequent(digests: DataFrame, counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """(digest, winner, group_size) of the frequent digests, counted exactly: at most ``counters`` rows.

    Every digest with more than ``2 * rows / counters + partitions + heavy`` copies is among them.
    """
    summaries = digests.select("digest").mapInArrow(lambda it: misra_gries(it, counters), "digest binary, n long")
    candidates = summaries.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= heavy).orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    return digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.max("who").alias("winner"), F.count(F.lit(1)).alias("group_size"))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, heavy: int = HEAVY, tag: Column | None = None) -> DataFrame:
    """(digest, who, winner, group_size) for every row; ``who`` is (id, tag), the tag unique to the row."""
    ship(docs.sparkSession)
    tag = F.monotonically_increasing_id() if tag is None else tag
    rows = staged(docs.select(digest(F.col(text_col)).alias("digest"), F.struct(F.col(id_col).alias("id"), tag.alias("tag")).alias("who")), "digests")
    winners = staged(frequent(rows, counters, heavy), "winners")
    split = rows.join(F.broadcast(winners), "digest", "left")
    hot = split.filter("group_size is not null")
    group = W.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("digest", "who", F.max("who").over(group).alias("winner"), F.count(F.lit(1)).over(group).alias("group_size"))
    return hot.select("digest", "who", "winner", "group_size").unionByName(rest)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """One row for each document, dropped ones too: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    return mark(docs, id_col, text_col, counters, heavy).select(
        F.col("who.id").alias(id_col), F.col("winner.id").alias("keep_id"), F.col("group_size"), (F.col("who") == F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """The documents that stay, with all their columns. Rows are chosen by a tag of their own: ids may be null or repeated."""
    every, tag = tagged(docs, "documents")
    gone = mark(every, id_col, text_col, counters, heavy, F.col(tag)).filter("who != winner").select(F.col("who.tag").alias(tag))
    return every.join(gone, tag, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL of op8's rows.
SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
