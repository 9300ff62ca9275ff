"""Reading tables, row identity, fingerprints and versions."""

from __future__ import annotations

import hashlib
import json
import platform
import re
import sys
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROW = "__row_id"


def read(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    """Parquet, CSV or JSON by ``kind`` or suffix. CSV is read with a header and without guessing types unless asked."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"no reader for {kind!r}")
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options)
    return reader.format(kind).load(path)


def with_row_id(df: DataFrame, order_by: list[str] | None = None, name: str = ROW) -> DataFrame:
    """Adds a contiguous row number from 0: in the order of unique columns if given, else in the order of reading.

    A row's number is its place in its partition plus the rows of the partitions before: one count per partition, and
    no shuffle. Sorted input is checkpointed first, since range boundaries are sampled anew in each run.
    """
    if name in df.columns:
        return df
    if order_by:
        checkpoint_dir(df.sparkSession)
        df = df.orderBy(*order_by).checkpoint()
    placed = df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__at")).alias(name))


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and all run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="datawright-"))
    return sc.getCheckpointDir()


def row_key(df: DataFrame, key: str | None = None) -> tuple[Column, str]:
    """(expression, strength): a unique key column, else a content hash if it is unique, else the row number."""
    if key and df.groupBy(key).count().filter("count > 1").isEmpty():
        return F.col(key), "key"
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != ROW])
    if df.groupBy(content.alias("h")).count().filter("count > 1").isEmpty():
        return content, "content"
    return F.col(ROW), "position"


@dataclass(frozen=True)
class RowIndex:
    """Identity of the rows of a table, so that a selection taken before a repair can be found in the table after it.

    Rows are named by a unique key column, else by their content if that is unique, else by their number. Selections are lists that a
    user makes; they are joined to the rows, which stay where they are.
    """

    rows: DataFrame = field(repr=False)
    name: Column = field(repr=False)
    strength: str

    @staticmethod
    def of(df: DataFrame, key: str | None = None) -> RowIndex:
        numbered = with_row_id(df)
        name, strength = row_key(numbered, key)
        return RowIndex(numbered, name.cast("string"), strength)

    @property
    def is_stable(self) -> bool:
        """Whether the names survive a change of the table: a row's number does not."""
        return self.strength != "position"

    def _chosen(self, values: Iterable[object], kind: str) -> DataFrame:
        """(at, value): the selection with its order."""
        return self.rows.sparkSession.createDataFrame([(k, v) for k, v in enumerate(values)], f"at long, value {kind}")

    def keys_for(self, positions: Iterable[int]) -> list[str]:
        """Names of the rows at these places, in this order; places outside the table are left out."""
        named = self.rows.select(F.col(ROW).cast("long").alias("value"), self.name.alias("key"))
        return [r["key"] for r in self._chosen([p for p in positions if isinstance(p, int)], "long").join(named, "value").orderBy("at").collect()]

    def positions_for(self, keys: Iterable[object]) -> list[int]:
        """Places of the rows of these names, in this order; names that no row has (any more) are left out."""
        named = self.rows.select(self.name.alias("value"), F.col(ROW).alias("place"))
        return [r["place"] for r in self._chosen([str(k) for k in keys], "string").join(named, "value").orderBy("at").collect()]

    def restrict(self, keys: Iterable[object]) -> DataFrame:
        """The rows of these names, in the order of the table."""
        chosen = self._chosen([str(k) for k in keys], "string").select("value")
        return self.rows.join(chosen, self.name == chosen["value"], "left_semi").orderBy(ROW).drop(ROW)

    def to_dict(self) -> dict[str, object]:
        return {"source": self.strength, "stable": self.is_stable, "rows": self.rows.count()}


@dataclass(frozen=True)
class Fingerprint:
    """Schema and content of a version; the content hash does not depend on the order of rows."""

    rows: int
    columns: int
    schema: str
    content: str

    @staticmethod
    def of(df: DataFrame) -> Fingerprint:
        names = [c for c in df.columns if c != ROW]
        cells = [F.to_json(F.struct(f"`{c}`")) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in df.dtypes if c != ROW]
        one = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0))).first()
        schema = hashlib.blake2b(json.dumps([(c, t) for c, t in df.dtypes if c != ROW]).encode(), digest_size=8).hexdigest()
        return Fingerprint(one[0], len(names), schema, str(one[1]))


@dataclass
class Versions:
    """Immutable DataFrame handles, one per applied operation; lineage stands in for copies."""

    handles: list[DataFrame] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)

    def add(self, df: DataFrame, label: str) -> int:
        self.handles.append(df)
        self.labels.append(label)
        return len(self.handles) - 1

    def restore(self, version: int) -> DataFrame:
        if not 0 <= version < len(self.handles):
            raise IndexError(f"no version {version}; there are {len(self.handles)}")
        return self.handles[version]


def manifest(spark: SparkSession) -> dict[str, str]:
    """Where a result was made."""
    from .. import __version__

    return {"datawright": __version__, "spark": spark.version, "python": sys.version.split()[0], "platform": platform.platform(), "timezone": spark.conf.get("spark.sql.session.timeZone"), "at": datetime.now(UTC).isoformat()}
