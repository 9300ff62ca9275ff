"""Filters and selections as data: they turn into predicates, and back and forth into JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_missing, number, text
from ..sources.frames import ROW

WORDS = {"eq": "is", "ne": "is not", "gt": "is greater than", "ge": "is at least", "lt": "is less than", "le": "is at most", "in": "is one of", "contains": "contains", "missing": "is missing", "present": "is present"}


@dataclass(frozen=True)
class Clause:
    """One condition. Equality and containment compare texts, order compares numbers and drops what is none; an unknown column selects nothing."""

    column: str
    comparison: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.comparison not in WORDS:
            raise ValueError(f"unknown comparison {self.comparison!r}")

    def describe(self) -> str:
        shown = "" if self.comparison in ("missing", "present") else f" [{', '.join(map(str, self.value))}]" if self.comparison == "in" else f" {self.value!r}"
        return f"{self.column} {WORDS[self.comparison]}{shown}"

    def predicate(self, df: DataFrame) -> Column:
        if self.column not in df.columns:
            return F.lit(False)
        gap, t, x = is_missing(df, self.column), text(df, self.column), number(df, self.column)
        value = self.value
        if self.comparison == "missing":
            return gap
        if self.comparison == "present":
            return ~gap
        tests = {"eq": lambda: t == str(value), "ne": lambda: t != str(value), "in": lambda: t.isin([str(v) for v in value or []]), "contains": lambda: F.contains(F.lower(t), F.lower(F.lit(str(value)))), "gt": lambda: x > float(value), "ge": lambda: x >= float(value), "lt": lambda: x < float(value), "le": lambda: x <= float(value)}
        return F.coalesce(~gap & tests[self.comparison](), F.lit(False))


@dataclass(frozen=True)
class ViewState:
    """Conjunctive filters, a selection of row keys, and a revision that grows with each change."""

    filters: tuple[Clause, ...] = ()
    selection: tuple[Any, ...] = ()
    revision: int = 0

    def where(self, *clauses: Clause) -> ViewState:
        return replace(self, filters=(*self.filters, *clauses), revision=self.revision + 1)

    def select(self, keys: Iterable[Any]) -> ViewState:
        return replace(self, selection=tuple(dict.fromkeys(keys)), revision=self.revision + 1)

    def clear(self) -> ViewState:
        return ViewState(revision=self.revision + 1)

    def predicate(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (c.predicate(df) for c in self.filters), F.lit(True))

    def view(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate(df))

    def selected(self, df: DataFrame, key: str = ROW) -> DataFrame:
        """Selected rows that the filters admit; without a selection, all admitted rows. Absent keys are ignored."""
        seen = self.view(df)
        if not self.selection:
            return seen
        keys = df.sparkSession.createDataFrame([(k,) for k in self.selection], [key])
        return seen.join(F.broadcast(keys.withColumn(key, F.col(key).cast(df.schema[key].dataType))), key, "left_semi")

    def to_json(self) -> str:
        return json.dumps({"filters": [vars(c) for c in self.filters], "selection": list(self.selection), "revision": self.revision})

    @staticmethod
    def from_json(saved: str) -> ViewState:
        d = json.loads(saved)
        return ViewState(tuple(Clause(**c) for c in d["filters"]), tuple(d["selection"]), d["revision"])
