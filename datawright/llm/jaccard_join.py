"""Exact n-gram Jaccard self-join of texts: near-duplicate components.

A document's set holds its distinct word n-grams as 64-bit hashes; equal sets are one *item*, named by a 64-bit hash
of the set. Items link when the Jaccard similarity of their sets reaches ``percent``/100.

1. Shingles go to buckets by their hash, packed in binary columns (48 bits beside the bucket number). In a bucket the shingles that only one
   item has are dropped; the others return to their items with their frequency.
2. Ordered by (frequency, hash), two linked items share a shingle among the first
   ``size - ceil(t * size) + 1`` of each. Shingles of one item come first in that order, so an item whose unique
   shingles fill that prefix links with nothing and is out. What remains is small, and since intersections
   hold no unique shingles, the packed lists of shared shingles are enough for exact similarities.
3. Items are grouped by two min-hashes of their lists, large groups in chunks, and joined by signature trees;
   the links found there make first components. This is a shortcut only.
4. Every prefix shingle whose items lie in several components is left to check. The items of connected such
   shingles form clusters; a cluster's blocks of bounded size are joined by signature trees, those pairs of blocks that share such a
   shingle and are not both within one component. No link is missed: linked items share a prefix shingle, and are
   either in one component already or in blocks that share it.

Signature tree: leaves are items with a bitmap of their shingles; a node holds the OR of its children's bitmaps, the range
of their sizes and components, and the most shingles that a child loses to equal bits. Two nodes are traversed
together, and dropped when their sizes, or the common bits plus lost shingles, cannot reach the least
overlap, or when all their items are in one component.

Hot shingles: those that a hash sample finds in ``HOT_SHARE`` of the documents, or in ``HOT_ROWS`` of them if that is less (so no bucket outgrows a
worker), are not gathered in a bucket; they return to their items at once and count as the most frequent. Any fixed order of the
shingles gives the same links, so the sample decides costs only.

Hashes: an item is named by 64 bits of its set, and its shingles by 64 bits, of which 48 and the bucket's number travel. Two of n different sets share a name
with odds of n * n / 4e19 (1e8 sets: 3e-4); two different shingles of one bucket count as equal with odds of 4e-15 a pair.

Nulls, empty texts and texts of white space have no set and link with nothing. Texts of under ``n`` words are one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, staged, tagged
from .components import components
from .sentencepiece_codec import parts

WORDS = 5
PERCENT = 75
#: A shingle is hot in ``HOT_SHARE`` of the documents or ``HOT_ROWS`` of them; ``SAMPLE`` documents that hold it at the limit are sampled on average; at most ``MOST_HOT`` are listed.
HOT_SHARE, HOT_ROWS, SAMPLE, MOST_HOT = 0.02, 1_000_000, 40, 50_000
#: Bytes of text for each bucket of shingles: about two million shingles.
BUCKET_BYTES = 12_000_000
#: Bytes of a shingle's hash that travel, beside its bucket.
SENT = 6
#: Items of a chunk or block.
BLOCK = 512
#: Rows of an Arrow batch: a row may hold the shingles of a very long text.
BATCH_ROWS = 500
_SEEN = 100_000
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    many = len(words) - n + 1
    total = np.zeros(many, np.uint64)
    for k in range(n):
        total = _mixed(total + hashed[k : k + many])
    return np.unique(total)


def item_key(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), np.uint64).view(np.int64))


def _batch(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(id, key, size) for each document; size 0: no set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, 1):
                sets = [shingles(t, n) for t in texts]
                yield _batch(["id", "key", "size"], [part.column(0), pa.array([item_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {picked.dtypes[0][1]}, key long, size long")


def hot_shingles(docs: DataFrame, id_col: str, text_col: str, n: int) -> np.ndarray:
    """Sorted hot shingles, at most ``MOST_HOT``: a bounded list that is shipped with the tasks."""
    rows = docs.count()
    share = min(HOT_SHARE, HOT_ROWS / max(1, rows))
    picked = docs.filter(F.pmod(F.xxhash64(F.lit("hot"), F.col(id_col)), F.lit(max(1, int(rows * share / SAMPLE)))) == 0).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield _batch(["shingle"], [pa.array(shingles(text, n).view(np.int64))])

    least = max(20, int(share * min(rows, SAMPLE / share)))
    found = picked.mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "shingle").limit(MOST_HOT)
    return np.sort(np.array([r[0] for r in found.collect()], np.int64).view(np.uint64))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns (sorted input), each as a table."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        begin = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != current:
                if current is not None:
                    held.append(batch.slice(begin, i - begin))
                    yield pa.Table.from_batches(held)
                held, begin, current = [], i, key
        held.append(batch.slice(begin))
    if current is not None:
        yield pa.Table.from_batches(held)


def _by_group(df: DataFrame, keys: list[str], run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` on each group of rows with equal keys, the first columns of ``df``; one group at a time is held."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, len(keys)):
            yield from run(group)
        pa.default_memory_pool().release_unused()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _pack(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def _unpack(column: pa.ChunkedArray, bucket: int, buckets: int) -> np.ndarray:
    sent = _numbers(column, np.uint8).reshape(-1, SENT)
    wide = np.zeros((len(sent), 8), np.uint8)
    wide[:, :SENT] = sent
    return wide.view(np.uint64).ravel() * _U(buckets) + _U(bucket)


def _packed_shingles(docs: DataFrame, id_col: str, text_col: str, n: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, keys, sizes, counts, shingles): packed shingles of many items; a negative bucket holds hot shingles, with all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        turn = 0
        for batch in batches:
            for _, texts in parts(batch, 0, 4_000_000):
                sets, keys = [], []
                for t in texts:
                    found = shingles(t, n)
                    if len(found) and (key := (item_key(found), len(found))) not in seen:
                        if len(seen) < _SEEN:
                            seen.add(key)
                        sets.append(found)
                        keys.append(key[0])
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets], np.int64)
                all_keys, every, at = np.array(keys, np.int64), np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
                bucket = (every % _U(buckets)).astype(np.int32)
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, every), len(hot) - 1)
                    bucket[hot[place] == every] = -1 - turn % 1000
                    turn += 1
                order = np.argsort(bucket, kind="stable")
                bucket, every, at = bucket[order], every[order], at[order]
                quotient = every // _U(buckets) & _U((1 << 8 * SENT) - 1)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                rows: list[list] = [[], [], [], [], []]
                for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                    own, counts = np.unique(at[a:b], return_counts=True)
                    # Hot shingles keep the name that they would have in their bucket.
                    sent = _pack(quotient[a:b]) if bucket[a] >= 0 else (quotient[a:b] * _U(buckets) + every[a:b] % _U(buckets)).tobytes()
                    for column, value in zip(rows, (int(bucket[a]), all_keys[own].tobytes(), sizes[own].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), sent), strict=True):
                        column.append(value)
                yield _batch(["bucket", "keys", "sizes", "counts", "shingles"], [pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, keys binary, sizes binary, counts binary, shingles binary")


def _shared(group: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of one bucket: for each item its shingles that other items have too, with their frequencies."""
    bucket = group.column("bucket")[0].as_py()
    hot = bucket < 0
    keys, sizes = _numbers(group.column("keys"), np.int64), _numbers(group.column("sizes"), np.int32).astype(np.int64)
    at = np.repeat(np.arange(len(keys), dtype=np.int32), _numbers(group.column("counts"), np.int32))
    found = _numbers(group.column("shingles"), np.uint64) if hot else _unpack(group.column("shingles"), bucket, buckets)
    # One number for each item of the bucket, whichever rows bring it.
    keys, first, ids = np.unique(keys, return_index=True, return_inverse=True)
    sizes = sizes[first]
    item = ids.astype(np.int32)[at]
    order = np.lexsort((item, found))
    item, found = item[order], found[order]
    fresh = np.r_[True, (found[1:] != found[:-1]) | (item[1:] != item[:-1])]
    item, found = item[fresh], found[fresh]
    begins = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    lengths = np.diff(np.r_[begins, len(found)])
    often = np.repeat(lengths, lengths)
    if hot:
        often = np.full(len(found), np.iinfo(np.int32).max, np.int64)
    keep = often > 1
    item, found, often = item[keep], found[keep], often[keep]
    order = np.argsort(item, kind="stable")
    item, found, often = item[order], found[order], often[order].astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(item)]
    for a in range(0, len(cuts), 20_000):
        some = list(zip(cuts[a : a + 20_000], ends[a : a + 20_000], strict=True))
        own = item[cuts[a : a + 20_000]]
        yield _batch(
            ["key", "size", "shingles", "often"],
            [pa.array(keys[own]), pa.array(sizes[own]), pa.array([found[x:y].tobytes() for x, y in some], pa.binary()), pa.array([often[x:y].tobytes() for x, y in some], pa.binary())],
        )


def _least_prefix(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _candidate(percent: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        """One item from its parts: kept if shared shingles reach into its prefix."""
        size = group.column("size")[0].as_py()
        # Copies of a set in several tasks bring its hot shingles more than once.
        found, first = np.unique(_numbers(group.column("shingles"), np.uint64), return_index=True)
        often = _numbers(group.column("often"), np.int32)[first]
        prefix = _least_prefix(size, percent) - (size - len(found))
        if prefix < 1:
            return
        first = found[np.lexsort((found, often))[:prefix]].view(np.int64)
        low = [int(_mixed(found ^ _U(seed)).min().view(np.int64)) for seed in (0x51, 0xA7)]
        yield _batch(
            ["key", "size", "shingles", "prefix", "low"],
            [group.column("key").slice(0, 1).combine_chunks(), pa.array([size], pa.int64()), pa.array([found.tobytes()], pa.binary()), pa.array([first.tolist()], pa.list_(pa.int64())), pa.array([low], pa.list_(pa.int64()))],
        )

    return run


class SignatureTree:
    """Binary tree over items in order of (size, smallest shingle); level 0 holds the leaves."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, bits: int) -> None:
        self.order = np.lexsort((np.array([s[0] for s in sets], np.uint64), sizes))
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        lost = np.zeros(len(sets), np.int64)
        for row, i in enumerate(self.order):
            places = np.unique(_mixed(sets[i]) & _U(bits - 1)).astype(np.int64)
            lost[row] = len(sets[i]) - len(places)
            np.bitwise_or.at(maps[row], places >> 3, (1 << (places & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        s, l = sizes[self.order], labels[self.order]
        self.levels = [(maps, lost, s, s, l, l)]
        while len(self.levels[-1][1]) > 1:
            m, lost, lo, hi, l0, l1 = self.levels[-1]
            if len(lost) % 2:
                m, lost, lo, hi, l0, l1 = (np.concatenate([x, x[-1:]]) for x in (m, lost, lo, hi, l0, l1))
            a, b = slice(0, None, 2), slice(1, None, 2)
            self.levels.append((m[a] | m[b], np.maximum(lost[a], lost[b]), np.minimum(lo[a], lo[b]), np.maximum(hi[a], hi[b]), np.minimum(l0[a], l0[b]), np.maximum(l1[a], l1[b])))

    def level(self, k: int) -> tuple:
        return self.levels[min(k, len(self.levels) - 1)]


def _possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs (i of x, j of y) may hold a link between different components."""
    xm, x_lost, x_lo, x_hi, x_l0, x_l1 = x
    ym, y_lost, y_lo, y_hi, y_l0, y_l1 = y
    keep = (100 * x_hi[i] >= percent * y_lo[j]) & (100 * y_hi[j] >= percent * x_lo[i]) & ~((x_l0[i] == x_l1[i]) & (y_l0[j] == y_l1[j]) & (x_l0[i] == y_l0[j]))
    at = np.flatnonzero(keep)
    step = max(1, 500_000 // xm.shape[1])
    for a in range(0, len(at), step):
        p, q = i[at[a : a + step]], j[at[a : a + step]]
        common = np.bitwise_count(xm[p] & ym[q]).sum(axis=1, dtype=np.int64) + np.minimum(x_lost[p], y_lost[q])
        keep[at[a : a + step]] = (100 + percent) * common >= percent * (x_lo[p] + y_lo[q])
    return keep


def traverse(x: SignatureTree, y: SignatureTree, percent: int) -> Iterator[tuple[int, int]]:
    """Leaf pairs (item of x, item of y) that the trees cannot rule out. With x is y: each pair once."""
    top = max(len(x.levels), len(y.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        keep = _possible(x.level(k), i, y.level(k), j, percent)
        i, j = i[keep], j[keep]
        if not k:
            break
        xs, ys = len(x.level(k - 1)[1]), len(y.level(k - 1)[1])
        down_x, down_y = k - 1 < len(x.levels) - 1, k - 1 < len(y.levels) - 1
        i2 = (2 * i[:, None] + np.array([0, 0, 1, 1])) if down_x else np.repeat(i[:, None], 4, axis=1)
        j2 = (2 * j[:, None] + np.array([0, 1, 0, 1])) if down_y else np.repeat(j[:, None], 4, axis=1)
        i, j = i2.ravel(), j2.ravel()
        fine = (i < xs) & (j < ys)
        if x is y:
            fine &= i <= j
        i, j = i[fine], j[fine]
        if not (down_x and down_y):
            both = np.unique(np.stack([i, j]), axis=1)
            i, j = both[0], both[1]
    if x is y:
        i, j = i[i != j], j[i != j]
    return zip(x.order[i].tolist(), y.order[j].tolist(), strict=True)


def linked(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, percent: int) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (size_a + size_b - common)


def join_block(keys: list[int], sizes: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (key, key) that connect the components of a block as far as its pairs do. Sides 0 and 1: only pairs across; all 0: all pairs."""
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * max(map(len, sets)))), 8, 16))
    found, parent = [], {int(l): int(l) for l in labels}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    groups = [np.flatnonzero(sides == s) for s in (0, 1)]
    trees = [SignatureTree([sets[i] for i in g], sizes[g], labels[g], bits) if len(g) else None for g in groups]
    if trees[0] is None:
        return []
    other = 1 if trees[1] is not None else 0
    for p, q in traverse(trees[0], trees[other], percent):
        p, q = groups[0][p], groups[other][q]
        a, b = root(int(labels[p])), root(int(labels[q]))
        if a != b and linked(sets[p], sets[q], int(sizes[p]), int(sizes[q]), percent):
            parent[max(a, b)] = min(a, b)
            found.append((keys[p], keys[q]))
    return found


def _joined(percent: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = group.column("key").to_pylist()
        if len(keys) < 2:
            return
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        links = join_block(keys, group.column("size").to_numpy(), sets, group.column("label").to_numpy(), group.column("side").to_numpy(), percent)
        if links:
            yield _batch(["a", "b"], [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())])

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """(cluster, key, block, one) of (cluster, key, label, lead): blocks of about ``BLOCK`` items; ``one``: the label of a block within one component.

    A large component has blocks of its own. The small ones stand together by their ``lead``, the smallest star that they are in, so that few blocks share
    a star: the components of a large lead have blocks of their own, those of small leads share blocks.
    """
    half = lambda total, of: F.pmod(F.xxhash64(F.lit("block"), F.col(of)), F.ceil(F.col(total) / (BLOCK // 2)))
    per = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("many"), F.min("lead").alias("lead"))
    large = F.col("many") >= BLOCK // 2
    led = per.filter(~large).groupBy("cluster", "lead").agg(F.sum("many").alias("led"))
    rest = led.filter(F.col("led") < BLOCK // 2).groupBy("cluster").agg(F.sum("led").alias("few"))
    placed = per.join(led, ["cluster", "lead"], "left").join(rest, "cluster", "left")
    block = F.when(large, F.lit(None).cast("long")).when(F.col("led") >= BLOCK // 2, F.xxhash64(F.lit("lead"), "lead", half("led", "label"))).otherwise(F.xxhash64(F.lit("rest"), half("few", "lead")))
    sized = members.select("cluster", "key", "label").join(placed.select("cluster", "label", "many", block.alias("shared")), ["cluster", "label"])
    return sized.select("cluster", "key", F.coalesce("shared", F.xxhash64(F.col("label"), half("many", "key"))).alias("block"), F.when(F.col("shared").isNull(), F.col("label")).alias("one"))


def _block_pairs(blocks: DataFrame, stars: DataFrame) -> DataFrame:
    """(cluster, block, block2), block <= block2, of the blocks that share a star and are not both of one component: linked items share one."""
    held = blocks.join(stars.select("key", "least"), "key").groupBy("cluster", "block", "one", "least").agg(F.lit(1).alias("x")).drop("x")
    other = held.select("least", F.col("block").alias("block2"), F.col("one").alias("one2"))
    shared = held.join(other, "least").filter((F.col("block") <= F.col("block2")) & ~F.coalesce(F.col("one") == F.col("one2"), F.lit(False)))
    return shared.select("cluster", "block", "block2").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b) of item keys: links enough to connect every component of items."""
    octets = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(32, -(-octets // BUCKET_BYTES))
    packed = _packed_shingles(docs, id_col, text_col, n, buckets, hot_shingles(docs, id_col, text_col, n))
    shared = _by_group(packed, ["bucket"], lambda group: _shared(group, buckets), "key long, size long, shingles binary, often binary")
    found = staged(_by_group(shared, ["key", "size"], _candidate(percent), "key long, size long, shingles binary, prefix array<long>, low array<long>"), "candidates", BATCH_ROWS)

    # First components: groups by min-hash, in chunks of a block's size.
    tagged = found.select("key", F.posexplode("low")).select("key", F.xxhash64("pos", "col").alias("group"))
    many = tagged.groupBy("group").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    chunk = F.xxhash64("group", F.pmod(F.xxhash64(F.lit("chunk"), "key", "group"), F.ceil(F.col("many") / BLOCK)))
    chunks = tagged.join(many, "group").select("key", chunk.alias("group"))
    rows = chunks.join(found, "key").select("group", "key", "size", "shingles", F.col("key").alias("label"), F.lit(0).alias("side"))
    first = staged(_by_group(rows, ["group"], _joined(percent), "a long, b long"), "links", BATCH_ROWS)
    labels = components(first)

    # What they leave: prefix shingles whose items lie in several components.
    labelled = found.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("label"), "prefix")
    bucketed = labelled.select("key", "label", F.explode("prefix").alias("shingle"))
    open_ = bucketed.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("key").alias("least")).filter("lo < hi")
    stars = staged(bucketed.join(open_.select("shingle", "least"), "shingle").groupBy("key", "label", "least").agg(F.lit(1).alias("one")).select("key", "label", "least"), "stars")
    clusters = components(stars.select(F.col("key").alias("a"), F.col("least").alias("b")))
    leads = stars.groupBy("key", "label").agg(F.min("least").alias("lead"))
    members = leads.join(clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster")), "key")
    blocks = staged(_blocks(staged(members.select("cluster", "key", "label", "lead"), "members")), "blocks")
    pairs = staged(_block_pairs(blocks, stars), "pairs")
    sided = pairs.select("cluster", F.xxhash64("cluster", "block", "block2").alias("pair"), F.explode(F.array_distinct(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block2").alias("block"), F.when(F.col("block") == F.col("block2"), 0).otherwise(1).alias("side"))))).alias("s"))
    placed = sided.select("cluster", "pair", "s.block", "s.side").join(blocks.select("cluster", "block", "key"), ["cluster", "block"]).select("pair", "key", "side")
    rows = placed.join(found.select("key", "size", "shingles"), "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("pair", "key", "size", "shingles", F.coalesce("root", "key").alias("label"), "side")
    rest = _by_group(rows, ["pair"], _joined(percent), "a long, b long")
    return first.unionByName(staged(rest, "links", BATCH_ROWS))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``) for every document; the component's id is its smallest document id."""
    ship(docs.sparkSession)
    every = staged(items(docs, id_col, text_col, n), "items", BATCH_ROWS)
    labels = components(links(docs, id_col, text_col, n, percent))
    # Items first, one row each; then one join by item. A component or an item with very many documents meets no more than a row at a time on the other side.
    least = staged(every.filter("size > 0").groupBy("key").agg(F.min("id").alias("least")), "least")
    joined = least.join(labels.withColumnRenamed("node", "key"), "key")
    roots = staged(joined.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    found = staged(labels.join(roots, "root").select(F.col("node").alias("key"), "component_id"), "named")
    named = staged(least.join(found, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id")), "components")
    sets = every.filter("size > 0").join(named, "key").select("id", "size", "component_id")
    return sets.unionByName(every.filter("size = 0").select("id", "size", F.col("id").alias("component_id"))).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest id of each component, with all their columns. Of rows that repeat it, one stays; a null id is the smallest."""
    every, tag = tagged(docs, "documents")
    who = every.select(F.struct(F.col(id_col).alias("id"), F.col(tag).alias("tag")).alias("who"), F.col(text_col).alias("text"))
    gone = near_duplicates(who, "who", "text", n, percent).filter("who != component_id").select(F.col("who.tag").alias(tag))
    return every.join(gone, tag, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL of op5's rows: all pairs that share a shingle, so for small tables.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT a, b FROM both_ways UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a),
least_reached AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_reached r ON r.x = w.doc_id
"""
