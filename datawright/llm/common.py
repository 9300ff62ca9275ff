"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WS_RUN = "[ \\t-\\r]+"
WS_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once for each context, so that Python workers can import it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_datawright_shipped", None) != sc.applicationId:
        top = Path(__file__).resolve().parents[1]
        packed = os.path.join(tempfile.mkdtemp(prefix="datawright-"), "datawright.zip")
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(top.rglob("*.py")):
                z.write(source, source.relative_to(top.parent))
        sc.addPyFile(packed)
        sc._datawright_shipped = sc.applicationId
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text (null: none), split at the six ASCII white-space characters only."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and all run on this machine."""
    sc = spark.sparkContext
    if not (found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="datawright-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


#: Folders of intermediate tables by the scope that wrote them; None: no scope.
_written: dict[str | None, list[str]] = {}
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def _narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in a copy of its session that hands at most ``rows`` rows or 16 MB to Python at a time; the session itself stays as it is."""
    spark = df.sparkSession
    try:
        own = spark._jsparkSession.cloneSession()
        own.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        own.conf().set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
        return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.queryExecution().analyzed()), type(spark)(spark.sparkContext, own))
    except (AttributeError, TypeError):  # another kind of session
        return df


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: lineage ends there, and a lost executor loses nothing.

    ``batch_rows`` bounds the Arrow batches of wide rows while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/datawright-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    (_narrow(df, batch_rows) if batch_rows else df).write.parquet(path)
    _written.setdefault(_scope.get(), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _scanned(df: DataFrame) -> str | None:
    """Paths of a DataFrame that is a plain scan of files, else None."""
    try:
        plan = df._jdf.queryExecution().analyzed()
        return plan.relation().location().rootPaths().mkString("\n") if plan.nodeName() == "LogicalRelation" else None
    except Exception:  # another kind of session or relation
        return None


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession, name: str, docs: DataFrame) -> Iterator[None]:
    """Deletes the intermediate tables that steps of this scope wrote before, as their results are written by now, and takes note of those written inside.

    They stay if ``docs``, the input of the coming step, is not a plain scan or reads one of them.
    """
    before, paths = _written.get(name, []), _scanned(docs)
    if before and paths is not None and not any(b.rsplit("/", 1)[-1] in paths for b in before):
        _delete(spark, _written.pop(name))
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    if paths := _scanned(df):
        gone = [p for each in _written.values() for p in each if p.rsplit("/", 1)[-1] in paths]
        _delete(spark, gone)
        for each in _written.values():
            each[:] = [p for p in each if p not in gone]


def tagged(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that is unique to each row and the same whenever it is read, and that column's name: ids may be null or repeated.

    Rows of a plain Parquet scan are named by (hash of the file's path, place in the file); others are written once with a running number.
    Two of n files share a hash with odds of n * n / 4e19.
    """
    tag = unused(docs.columns, "row_tag")
    if _scanned(docs) is not None:
        try:
            at = docs.metadataColumn("_metadata")
            return docs.select("*", F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row")).alias(tag)), tag
        except AnalysisException:  # not Parquet
            pass
    return staged(docs.select("*", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")).alias(tag)), name), tag


def unused(columns: list[str], stem: str) -> str:
    """A column name that ``columns`` do not have, whatever their case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
