"""WARC files and their Merkle fixity audit.

Each file has a tree of its own, made by the task that reads the file. Leaves are its records in the order of their offsets, named by record
id and occurrence. A node covers an ordered range of them: a record begins a new node of level k if the hash of its name is a multiple of
``FAN_OUT ** k``, so a record that is lost, added or lengthened changes the nodes that hold it and no others. A node's digest is the
SHA-256 of its children's names, lengths and digests; with it stands the offset range that it covers.

An audit compares the roots of two replicas and reads, level by level, only the children of nodes that differ. At the leaves it reports each
record that is ``corrupt``, ``missing`` (only in the first replica) or ``extra`` (only in the second).

Files are read whole, one at a time in a task, plain or as gzip members. Null payloads and uris are empty; records with a null id are dealt to ``NULL_FILES`` files
by their payload. Repeated rows are records of their own. Empty tables have no files, no trees and an empty audit.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, ship, staged

FAN_OUT = 16
RECORDS_PER_FILE = 1_000
NULL_FILES = 65_536
END = "\r\n\r\n"
#: Level of the roots; a level of single nodes adds nothing.
LEVELS = 4


def header(id_: Column, uri: Column, payload: Column) -> Column:
    line = "\r\n"
    return F.concat(
        F.lit(f"WARC/1.0{line}WARC-Type: resource{line}WARC-Record-ID: <urn:record:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(f">{line}WARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit(f"{line}Content-Type: text/html{line}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(END),
    )


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, file, record): ``record`` is the text of a WARC record without the two line ends that close it."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    spread = -1 - F.pmod(F.conv(F.substring(F.md5(payload), 1, 8), 16, 10).cast("long"), F.lit(NULL_FILES))
    file = F.coalesce(F.floor(F.col(f"`{id_col}`") / RECORDS_PER_FILE), spread).cast("long")
    return pages.select(F.col(f"`{id_col}`").alias("id"), file.alias("file"), F.concat(header(F.col(f"`{id_col}`"), F.col(f"`{uri_col}`"), payload), payload).alias("record"))


def write_warc(made: DataFrame, path: str, compression: str = "none") -> None:
    """Writes records as files ``file=<n>/part-*.txt[.gz]`` whose bytes are WARC: the closing line ends are the writer's separator."""
    _write(made.repartition("file").sortWithinPartitions("file", "id", F.sha2("record", 256)), path, compression)


def _write(ordered: DataFrame, path: str, compression: str) -> None:
    ordered.select("file", F.col("record").alias("value")).write.partitionBy("file").option("lineSep", END).option("compression", compression).text(path)


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.I)
_ID = re.compile(rb"\r\nWARC-Record-ID:[ \t]*<([^\r\n]*)>", re.I)


def parse_warc(content: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(offset, length with the closing line ends, header, payload) of the records of a file, plain or gzip; offsets count plain bytes."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        found = _LENGTH.search(content, at, end + 2) if end >= 0 else None
        if not content.startswith(b"WARC/", at) or not found:
            raise ValueError(f"no WARC record at byte {at}")
        stop = end + 4 + int(found[1])
        yield at, stop + 4 - at, content[at:end], content[end + 4 : stop]
        at = stop + 4


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the WARC files below a folder; a file is named by its folder ``file=<n>``, or else by its own name."""
    found = ship(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,txt.gz,warc,warc.gz}").load(path)
    named = F.regexp_extract("path", "/file=(-?[0-9]+)/[^/]*$", 1)
    return found.select(F.when(named != "", named).otherwise(F.regexp_extract("path", "([^/]*)$", 1)).alias("file"), "content")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, header, payload) of the records of WARC files, one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, rows = batch.column(0)[k].as_py(), list(parse_warc(batch.column(1)[k].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], pa.array([r[2].decode("utf-8", "replace") for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary())],
                    ["file", "offset", "length", "header", "payload"],
                )

    return _files(spark, path).mapInArrow(run, "file string, offset long, length long, header string, payload binary")


def tree(content: bytes, fan_out: int = FAN_OUT, levels: int = LEVELS) -> list[tuple[int, str, str, int, int, str]]:
    """(level, name, name of the parent, begin, end, digest) of all nodes of a file, leaves (level 0) first."""
    seen: dict[str, int] = {}
    rows: list[tuple[str, int, int, str]] = []
    starts: list[int] = []
    for begin, length, head, payload in parse_warc(content):
        found = _ID.search(head)
        name = found[1].decode("utf-8", "replace") if found else ""
        occurrence = seen[name] = seen.get(name, -1) + 1
        name = f"{name}#{occurrence}"
        rows.append((name, begin, begin + length, hashlib.sha256(head + b"\r\n\r\n" + payload + b"\r\n\r\n").hexdigest()))
        mark, level = int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "big"), 0
        while level + 1 < levels and mark % fan_out ** (level + 1) == 0:
            level += 1
        starts.append(level)
    out = []
    for level in range(levels):
        # Nodes of the next level: runs of this level's rows, of which the first is named "".
        above: list[tuple[str, int, int, str]] = []
        up: list[int] = []
        held: list[tuple[str, int, int, str]] = []
        name = ""

        def close() -> None:
            digest = hashlib.sha256(";".join(f"{n}:{e - b}:{d}" for n, b, e, d in held).encode()).hexdigest()
            above.append((name, held[0][1], held[-1][2], digest))

        for row, start in zip(rows, starts, strict=True):
            if held and start > level and level + 1 < levels:
                close()
                held, name = [], row[0]
            if not held:
                up.append(start)
            held.append(row)
            out.append((level, row[0], name, *row[1:]))
        if not held:
            return out
        close()
        rows, starts = above, up
    return [*out, *((levels, n, "", b, e, d) for n, b, e, d in rows)]


def trees(spark: SparkSession, path: str, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, level, name, parent, begin, end, digest) of the trees of the WARC files below a folder, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                nodes = tree(batch.column(1)[k].as_py(), fan_out)
                kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(nodes), pa.string()), *[pa.array([n[i] for n in nodes], t) for i, t in enumerate(kinds)]], ["file", "level", "name", "parent", "begin", "end", "digest"])

    return staged(_files(spark, path).mapInArrow(run, "file string, level int, name string, parent string, begin long, end long, digest string"), "trees")


def audit(first: DataFrame, second: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(file, name, begin, end, digest, status) of the records that differ; begin and end are the second replica's if the record is extra."""
    suspect: DataFrame | None = None
    for level in range(levels, -1, -1):
        a, b = (t.filter(F.col("level") == level) for t in (first, second))
        if suspect is not None:
            a, b = (t.join(suspect, ["file", "parent"], "left_semi") for t in (a, b))
        x, y = (d.select("file", "name", *[F.col(c).alias(f"{c}_{s}") for c in ("begin", "end", "digest")]) for d, s in ((a, "a"), (b, "b")))
        differ = x.join(y, ["file", "name"], "full_outer").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        if level:
            # Written, as the next level reads it twice.
            suspect = staged(differ.select("file", F.col("name").alias("parent")), "suspects")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    return differ.select("file", "name", *[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("begin", "end", "digest")], status.alias("status"))


def damaged(read: DataFrame) -> DataFrame:
    """(file, record) of a replica for trials, from the records of ``read_warc``: by the first two digits of the MD5 of its id a record
    has another character in its header (00), is lost (01), is there twice (02) or is a character longer (03)."""
    hit = F.substring(F.md5(F.regexp_extract("header", "WARC-Record-ID: <urn:record:([^>]*)>", 1)), 1, 2)
    longer = F.concat(F.regexp_replace("header", "Content-Length: [0-9]+$", ""), F.lit("Content-Length: "), (F.octet_length("payload") + 1).cast("string"), F.lit(END), F.col("payload").cast("string"), F.lit("!"))
    whole = F.concat("header", F.lit(END), F.col("payload").cast("string"))
    changed = F.concat(F.regexp_replace("header", "Content-Type: text/html", "Content-Type: text/htmX"), F.lit(END), F.col("payload").cast("string"))
    copies = F.when(hit == "00", F.array(changed)).when(hit == "01", F.array().cast("array<string>")).when(hit == "02", F.array(whole, whole)).when(hit == "03", F.array(longer)).otherwise(F.array(whole))
    # A file's records come from one task, in their order, and go to one file again without a shuffle.
    return read.select("file", "offset", copies.alias("copies")).sortWithinPartitions("file", "offset").select("file", F.explode("copies").alias("record"))


def fixity_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """(page_id, warc_file, offset, length, sha256, status) of every record of the first replica's trees, and of the extra ones of the second."""
    found = audit(first, second)
    differ = found.select("file", "name", "status")
    own = first.filter("level = 0").join(differ, ["file", "name"], "left").select("file", "name", "begin", "end", "digest", F.coalesce("status", F.lit("ok")).alias("status"))
    every = own.unionByName(found.filter("status = 'extra'"))
    page = F.regexp_extract("name", "^urn:record:(.*)#[0-9]+$", 1)
    return every.select(F.when(page != "", page).cast("long").alias("page_id"), F.col("file").cast("long").alias("warc_file"), F.col("begin").alias("offset"), (F.col("end") - F.col("begin")).alias("length"), F.col("digest").alias("sha256"), "status")


def trial(pages: DataFrame) -> DataFrame:
    """``fixity_report`` of pages written as WARC files against a damaged replica of these files."""
    spark = pages.sparkSession
    top = f"{shared_dir(spark).rstrip('/')}/datawright-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_warc(records(pages), f"{top}/first", "gzip")
    _write(damaged(read_warc(spark, f"{top}/first")), f"{top}/second", "gzip")
    return fixity_report(trees(spark, f"{top}/first"), trees(spark, f"{top}/second"))


#: DuckDB SQL of op7's rows.
SQL = """
WITH made AS (
  SELECT page_id, coalesce(page_id // 1000, -1 - ('0x' || substr(md5(coalesce(html, '')), 1, 8))::BIGINT % 65536)::BIGINT AS warc_file, substr(md5(coalesce(page_id::VARCHAR, '')), 1, 2) AS hit,
    concat('WARC/1.0', e, 'WARC-Type: resource', e, 'WARC-Record-ID: <urn:record:', page_id::VARCHAR, '>', e, 'WARC-Target-URI: ', url, e, 'Content-Type: text/') AS a,
    concat(e, 'Content-Length: ') AS b, coalesce(html, '') AS payload, e || e AS stop
  FROM pages, (SELECT chr(13) || chr(10) AS e)),
first AS (
  SELECT page_id, warc_file, hit, payload, concat(a, 'html', b, strlen(payload)::VARCHAR, stop, payload, stop) AS record,
    concat(a, 'html', b, (strlen(payload) + 1)::VARCHAR, stop, payload, '!', stop) AS longer
  FROM made),
sized AS (
  SELECT page_id, warc_file, hit, sha256(record) AS sha256, strlen(record)::BIGINT AS length, strlen(longer)::BIGINT AS longer FROM first),
own AS (
  SELECT *, (sum(length) OVER w - length)::BIGINT AS "offset", CASE hit WHEN '01' THEN 0 WHEN '02' THEN 2 * length WHEN '03' THEN longer ELSE length END AS there FROM sized
  WINDOW w AS (PARTITION BY warc_file ORDER BY page_id, sha256 ROWS UNBOUNDED PRECEDING)),
other AS (
  SELECT *, (sum(there) OVER w - there)::BIGINT AS begin2 FROM own WINDOW w AS (PARTITION BY warc_file ORDER BY page_id, sha256 ROWS UNBOUNDED PRECEDING))
SELECT page_id, warc_file, "offset", length, sha256, CASE hit WHEN '00' THEN 'corrupt' WHEN '01' THEN 'missing' WHEN '03' THEN 'corrupt' ELSE 'ok' END AS status FROM own
UNION ALL
SELECT page_id, warc_file, begin2 + length, length, sha256, 'extra' FROM other WHERE hit = '02'
"""
