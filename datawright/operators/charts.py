"""Charts: aggregate in Spark, describe the rest as data, draw SVG without dependencies.

``compose`` takes fields and answers with a chart or a refusal with its reason. Only aggregated or sampled rows reach the driver.
"""

from __future__ import annotations

import html
import json
import math
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cell, number, text
from ..plans.state import Clause, ViewState
from ..sources.frames import ROW
from .association import AssociationMatrix
from .profile import ColumnProfile, DatasetProfile, ecdf, histogram

SAMPLE, TOP, PANELS, MAX_LEVELS = 3_000, 40, 12, 40
MARKS = ("bar", "column", "histogram", "heatmap", "line", "step", "area", "box", "scatter", "text", "tile")
AGGREGATES = ("count", "mean", "median", "sum", "min", "max")


class Refused(ValueError):
    """The fields make no honest chart."""


class BackendUnavailable(RuntimeError):
    """A drawing library is not installed."""


@dataclass(frozen=True)
class Encoding:
    channel: str
    field: str
    kind: str
    title: str = ""


@dataclass(frozen=True)
class ChartSpec:
    mark: str
    title: str
    encodings: tuple[Encoding, ...]
    data: tuple[dict[str, Any], ...]
    reason: str = ""
    sampled: int | None = None
    facet: str | None = None
    notes: tuple[str, ...] = ()
    rules: tuple[tuple[str, float], ...] = ()

    def channel(self, name: str) -> str | None:
        return next((e.field for e in self.encodings if e.channel == name), None)

    def panels(self) -> list[ChartSpec]:
        """One chart per facet value, on one domain."""
        if not self.facet:
            return [self]
        values = sorted({str(r[self.facet]) for r in self.data})
        return [replace(self, facet=None, title=f"{self.title}: {v}", data=tuple(r for r in self.data if str(r[self.facet]) == v)) for v in values]

    def domain(self, channel: str) -> tuple[float, float] | None:
        name = self.channel(channel)
        values = [r[name] for r in self.data if isinstance(r.get(name), (int, float)) and not isinstance(r.get(name), bool)]
        return (min(values), max(values)) if values else None

    @staticmethod
    def size_of(value: float, low: float, high: float, smallest: float = 3.0, largest: float = 16.0) -> float:
        """Radius whose area grows with the value."""
        share = (value - low) / (high - low) if high > low else 0.5
        return math.sqrt(smallest**2 + share * (largest**2 - smallest**2))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    def describe(self) -> str:
        return f"{self.title} ({self.mark}, {len(self.data)} rows{f', a sample of {self.sampled}' if self.sampled else ''}). {self.reason}".strip()


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    distinct: int = 0

    @property
    def quantitative(self) -> bool:
        return self.kind == "numeric"

    @property
    def categorical(self) -> bool:
        return self.kind in ("categorical", "ordinal", "boolean")

    @property
    def temporal(self) -> bool:
        return self.kind == "datetime"


def fields_of(made: DatasetProfile) -> list[Field]:
    return [Field(c.name, c.kind, c.distinct) for c in made.columns.values()]


@dataclass(frozen=True)
class Composition:
    x: str
    y: str | None = None
    colour: str | None = None
    facet: str | None = None
    aggregate: str = "mean"
    filters: tuple[Clause, ...] = ()


def _rows(df: DataFrame) -> tuple[dict[str, Any], ...]:
    return tuple(r.asDict() for r in df.collect())


def aggregated(df: DataFrame, by: str, value: str | None, how: str, top: int = TOP) -> DataFrame:
    """(level, value): aggregate per level, the ``top`` largest; equal values in the order of the levels."""
    if how not in AGGREGATES:
        raise Refused(f"unknown aggregate {how!r}")
    x = number(df, value) if value else F.lit(1)
    made = {"count": F.count, "mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max}[how](x)
    return df.select("*", text(df, by).alias("__level")).filter("__level is not null").groupBy(F.col("__level").alias("level")).agg(made.alias("value")).orderBy(F.desc("value"), "level").limit(top)


def sample(df: DataFrame, columns: list[str], limit: int = SAMPLE, key: str = ROW) -> DataFrame:
    """The same ``limit`` rows on every run: those with the smallest hashes of their key."""
    numbers = [number(df, c).alias(c) for c in columns]
    kept = df.select(F.col(key).alias("__key"), *numbers).dropna(subset=columns)
    return kept.orderBy(F.xxhash64("__key"), "__key").limit(limit).drop("__key")


def over_time(df: DataFrame, time: str, value: str, how: str = "mean", unit: str = "day") -> DataFrame:
    x = number(df, value)
    made = {"count": F.count, "mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max}[how](x)
    return df.select("*", F.date_trunc(unit, cell(df, time).time).alias("__t")).filter("__t is not null").groupBy(F.col("__t").alias("time")).agg(made.alias("value")).orderBy("time")


def compose(df: DataFrame, fields: list[Field], c: Composition) -> ChartSpec:
    """A chart by the kinds of x and y: scatter, bar, line or distribution."""
    known = {f.name: f for f in fields}
    for n in (c.x, c.y, c.colour, c.facet):
        if n and n not in known:
            raise Refused(f"no field {n!r}")
    x, y = known[c.x], known.get(c.y) if c.y else None
    for f in (x, y):
        if f and not (f.quantitative or f.categorical or f.temporal):
            raise Refused(f"{f.name} is {f.kind}; it has no axis")
    kept = ViewState(c.filters).view(df)
    if c.facet and known[c.facet].distinct > PANELS:
        raise Refused(f"{c.facet} would make over {PANELS} panels")
    if y and x.quantitative and y.quantitative:
        extra = [n for n in (c.colour, c.facet) if n]
        made = kept.select(F.col(ROW).alias("__key"), number(kept, x.name).alias(x.name), number(kept, y.name).alias(y.name), *[text(kept, n).alias(n) for n in extra]).dropna(subset=[x.name, y.name]).orderBy(F.xxhash64("__key"), "__key").limit(SAMPLE).drop("__key")
        rows = _rows(made)
        return ChartSpec("scatter", f"{y.name} by {x.name}", (Encoding("x", x.name, "quantitative"), Encoding("y", y.name, "quantitative"), *([Encoding("colour", c.colour, "nominal")] if c.colour else [])), rows, "two measures", SAMPLE if len(rows) == SAMPLE else None, c.facet)
    if c.facet:
        raise Refused("an aggregated chart has no facets")
    if y and x.temporal and y.quantitative:
        return ChartSpec("line", f"{c.aggregate} of {y.name} over {x.name}", (Encoding("x", "time", "temporal"), Encoding("y", "value", "quantitative")), _rows(over_time(kept, x.name, y.name, c.aggregate)), "a measure over time")
    if x.categorical:
        if x.distinct > MAX_LEVELS:
            raise Refused(f"{x.name} has over {MAX_LEVELS} levels")
        if y and not y.quantitative:
            raise Refused(f"{y.name} is no measure")
        how = c.aggregate if y else "count"
        return ChartSpec("bar", f"{how} of {y.name if y else 'rows'} by {x.name}", (Encoding("y", "level", "nominal", x.name), Encoding("x", "value", "quantitative")), _rows(aggregated(kept, x.name, y.name if y else None, how)), "levels compared")
    if x.quantitative and not y:
        return ChartSpec("histogram", f"distribution of {x.name}", (Encoding("x", "low", "quantitative", x.name), Encoding("y", "n", "quantitative")), _rows(histogram(kept, x.name).orderBy("bin")), "one measure")
    if x.temporal and not y:
        counts = kept.select(F.date_trunc("month", cell(kept, x.name).time).alias("time")).filter("time is not null").groupBy("time").agg(F.count(F.lit(1)).alias("value")).orderBy("time")
        return ChartSpec("column", f"rows over {x.name}", (Encoding("x", "time", "temporal"), Encoding("y", "value", "quantitative")), _rows(counts), "counts by month")
    raise Refused(f"no chart for {x.kind}" + (f" and {y.kind}" if y else ""))


@dataclass(frozen=True)
class Suggestion:
    composition: Composition
    score: float
    reason: str


def recommend(fields: list[Field], limit: int = 8) -> list[Suggestion]:
    found = []
    measures, groups, times = [f for f in fields if f.quantitative], [f for f in fields if f.categorical and f.distinct <= MAX_LEVELS], [f for f in fields if f.temporal]
    found += [Suggestion(Composition(t.name, m.name), 0.95, "a measure over time") for t in times for m in measures]
    found += [Suggestion(Composition(g.name, m.name), 0.9 - 0.005 * g.distinct, "a measure by few levels") for g in groups for m in measures]
    found += [Suggestion(Composition(a.name, b.name), 0.7, "two measures") for k, a in enumerate(measures) for b in measures[k + 1 :]]
    found += [Suggestion(Composition(m.name), 0.6, "a distribution") for m in measures] + [Suggestion(Composition(g.name), 0.5, "level counts") for g in groups]
    return sorted(found, key=lambda s: (-s.score, s.composition.x, s.composition.y or ""))[:limit]


# Builders over profiles and other small results ---------------------------------------------------------


def _xy(x: str, xk: str, y: str, yk: str) -> tuple[Encoding, ...]:
    return Encoding("x", x, xk), Encoding("y", y, yk)


def distribution_chart(c: ColumnProfile) -> ChartSpec:
    s = c.summary
    iqr = s["q3"] - s["q1"]
    rows = tuple({"low": a, "high": b, "n": n} for a, b, n in c.bins)
    return ChartSpec("histogram", f"Distribution of {c.name}", _xy("low", "quantitative", "n", "quantitative"), rows, "fences lie 1.5 interquartile ranges out", rules=(("lower fence", s["q1"] - 1.5 * iqr), ("upper fence", s["q3"] + 1.5 * iqr)))


def category_chart(c: ColumnProfile, levels: list[str] | None = None, top: int = 15) -> ChartSpec:
    pairs = sorted(c.top, key=lambda p: levels.index(p[0]) if levels and p[0] in levels else len(levels or ())) if levels else c.top
    return ChartSpec("bar", f"Levels of {c.name}", _xy("n", "quantitative", "value", "nominal"), tuple({"value": v, "n": n} for v, n in pairs[:top]), "declared order" if levels else "by frequency")


def missingness_chart(rows: list[dict[str, Any]]) -> ChartSpec:
    kept = tuple(sorted((r for r in rows if r["missing"]), key=lambda r: (-r["missing"], r["column"])))
    return ChartSpec("bar", "Missing cells", _xy("missing", "quantitative", "column", "nominal"), kept)


def association_heatmap(m: AssociationMatrix, minimum: float = 0.0) -> ChartSpec:
    rows = tuple({"left": p.left, "right": p.right, "value": p.value, "method": p.method} for p in m.pairs if p.value is not None and abs(p.value) >= minimum)
    return ChartSpec("heatmap", "Associations", (*_xy("left", "nominal", "right", "nominal"), Encoding("colour", "value", "quantitative")), rows)


def timeline_chart(name: str, periods: list[dict[str, Any]]) -> ChartSpec:
    return ChartSpec("column", f"Rows over {name}", _xy("period", "temporal", "n", "quantitative"), tuple(periods))


def health_chart(before: dict[str, float], after: dict[str, float] | None = None) -> ChartSpec:
    rows = [{"dimension": k, "score": v, "state": "before"} for k, v in before.items()] + [{"dimension": k, "score": v, "state": "after"} for k, v in (after or {}).items()]
    return ChartSpec("bar", "Data health", (*_xy("score", "quantitative", "dimension", "nominal"), Encoding("colour", "state", "nominal")), tuple(rows))


def issue_chart(issues: list[Any]) -> ChartSpec:
    counts: dict[str, int] = {}
    for i in issues:
        counts[i.repair_class.name] = counts.get(i.repair_class.name, 0) + 1
    return ChartSpec("bar", "Findings by who decides", _xy("n", "quantitative", "class", "nominal"), tuple({"class": k, "n": v} for k, v in sorted(counts.items(), key=lambda x: (-x[1], x[0]))))


def before_after_chart(changes: list[Any], top: int = 25) -> ChartSpec:
    kept = sorted((c for c in changes if c.relative is not None), key=lambda c: (-abs(c.relative), c.column, c.metric))[:top]
    return ChartSpec("bar", "Relative changes", _xy("change", "quantitative", "what", "nominal"), tuple({"what": f"{c.column} {c.metric}", "change": c.relative} for c in kept))


def box_chart(*columns: ColumnProfile) -> ChartSpec:
    rows = []
    for c in columns:
        s = c.summary
        iqr = s["q3"] - s["q1"]
        rows.append({"column": c.name, "low": max(s["min"], s["q1"] - 1.5 * iqr), "q1": s["q1"], "median": s["median"], "q3": s["q3"], "high": min(s["max"], s["q3"] + 1.5 * iqr), "outliers": s["outliers"]})
    return ChartSpec("box", "Five numbers", _xy("column", "nominal", "median", "quantitative"), tuple(rows), "whiskers end at the fences")


def ecdf_chart(df: DataFrame, column: str) -> ChartSpec:
    return ChartSpec("step", f"Distribution function of {column}", _xy("value", "quantitative", "share", "quantitative"), _rows(ecdf(df, column).orderBy("value")))


def scatter_chart(df: DataFrame, x: str, y: str, limit: int = SAMPLE) -> ChartSpec:
    rows = _rows(sample(df, [x, y], limit))
    return ChartSpec("scatter", f"{y} by {x}", _xy(x, "quantitative", y, "quantitative"), rows, sampled=limit if len(rows) == limit else None)


def target_means(df: DataFrame, column: str, target: str, most: int = 12) -> DataFrame:
    """(level, mean, n): the ``most`` most frequent levels with the mean of the target."""
    base = df.select(text(df, column).alias("level"), number(df, target).alias("y")).filter("level is not null and y is not null")
    return base.groupBy("level").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level").limit(most)


def target_chart(df: DataFrame, column: str, target: str, most: int = 12) -> ChartSpec:
    overall = df.agg(F.avg(number(df, target))).first()[0]
    return ChartSpec("bar", f"Mean {target} by {column}", _xy("mean", "quantitative", "level", "nominal"), _rows(target_means(df, column, target, most)), rules=(("overall", overall),))


def kpi_chart(items: list[tuple[str, Any]], title: str = "Summary") -> ChartSpec:
    return ChartSpec("tile", title, (Encoding("text", "value", "nominal"),), tuple({"name": k, "value": v} for k, v in items))


def stage_chart(stages: list[tuple[str, float]], title: str, reason: str = "") -> ChartSpec:
    return ChartSpec("column", title, _xy("stage", "nominal", "value", "quantitative"), tuple({"stage": s, "value": v} for s, v in stages), reason)


def text_length_chart(name: str, bins: list[tuple[float, float, int]]) -> ChartSpec:
    return ChartSpec("histogram", f"Text lengths of {name}", _xy("low", "quantitative", "n", "quantitative"), tuple({"low": a, "high": b, "n": n} for a, b, n in bins))


def column_charts(c: ColumnProfile) -> list[ChartSpec]:
    if c.kind == "numeric" and c.summary.get("q1") is not None:
        return [*([distribution_chart(c)] if c.bins else []), box_chart(c)]
    return [category_chart(c)] if c.top else []


def overview_charts(made: DatasetProfile, matrix: AssociationMatrix | None = None, missing: list[dict[str, Any]] | None = None, most: int = 12) -> list[ChartSpec]:
    found = [*([missingness_chart(missing)] if missing else []), *([association_heatmap(matrix)] if matrix else [])]
    for c in sorted(made.columns.values(), key=lambda c: (-c.distinct, c.name))[:most]:
        found += column_charts(c)[:1]
    return found


# Drawing ------------------------------------------------------------------------------------------------

WIDTH, HEIGHT, PAD = 560, 320, 46


@dataclass(frozen=True)
class Theme:
    ink: str = "#222222"
    paper: str = "#ffffff"
    accent: str = "#3366aa"
    colours: tuple[str, ...] = ("#3366aa", "#cc6633", "#559955", "#996699", "#888833", "#338899")


def _scale(low: float, high: float, a: float, b: float):  # noqa: ANN202
    return lambda v: (a + b) / 2 if high == low else a + (v - low) * (b - a) / (high - low)


def _num(v: Any) -> float:
    return v.timestamp() if hasattr(v, "timestamp") else float(v)


def render_svg(spec: ChartSpec, theme: Theme = Theme()) -> str:  # noqa: B008
    """The chart as SVG text; facets side by side."""
    panels = spec.panels()
    parts = []
    for k, p in enumerate(panels):
        parts.append(f'<g transform="translate({k * WIDTH},0)"><text x="{PAD}" y="20" fill="{theme.ink}" font-size="14">{html.escape(p.title)}</text>{_marks(p, theme)}</g>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH * len(panels)} {HEIGHT}" font-family="sans-serif"><rect width="100%" height="100%" fill="{theme.paper}"/>{"".join(parts)}</svg>'


def _marks(p: ChartSpec, t: Theme) -> str:
    rows = [r for r in p.data if all(r.get(e.field) is not None for e in p.encodings if e.channel in "xy")]
    if not rows:
        return f'<text x="{PAD}" y="{HEIGHT / 2}" fill="{t.ink}">no data</text>'
    left, right, top, bottom = PAD, WIDTH - 12, 32, HEIGHT - PAD
    x, y = p.channel("x"), p.channel("y")
    label = lambda px, py, s, anchor="start": f'<text x="{px:.1f}" y="{py:.1f}" font-size="10" fill="{t.ink}" text-anchor="{anchor}">{html.escape(str(s))[:40]}</text>'
    if p.mark == "tile":
        return "".join(label(left, 50 + 22 * k, f"{r['name']}: {r['value']}") for k, r in enumerate(rows))
    if p.mark == "bar":
        names = [str(r[y]) for r in rows]
        values = [_num(r[x]) for r in rows]
        to, step = _scale(min(0.0, *values), max(0.0, *values), left + 90, right), (bottom - top) / len(rows)
        colour = p.channel("colour")
        shades = {v: t.colours[k % len(t.colours)] for k, v in enumerate(dict.fromkeys(r.get(colour) for r in rows))} if colour else {}
        return "".join(f'<rect x="{min(to(0), to(v)):.1f}" y="{top + k * step:.1f}" width="{abs(to(v) - to(0)):.1f}" height="{step * 0.8:.1f}" fill="{shades.get(rows[k].get(colour), t.accent)}"/>' + label(left + 86, top + k * step + step * 0.6, names[k], "end") for k, v in enumerate(values))
    if p.mark == "heatmap":
        xs, ys = sorted({str(r[x]) for r in rows}), sorted({str(r[y]) for r in rows})
        w, h = (right - left - 80) / len(xs), (bottom - top) / len(ys)
        cells = "".join(f'<rect x="{left + 80 + xs.index(str(r[x])) * w:.1f}" y="{top + ys.index(str(r[y])) * h:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{t.accent}" opacity="{min(1.0, abs(r["value"])):.3f}"/>' for r in rows)
        return cells + "".join(label(left + 76, top + k * h + h / 2, n, "end") for k, n in enumerate(ys)) + "".join(label(left + 80 + k * w, bottom + 12, n) for k, n in enumerate(xs))
    if p.mark == "box":
        low, high = min(r["low"] for r in rows), max(r["high"] for r in rows)
        to, step = _scale(low, high, bottom, top), (right - left) / len(rows)
        out = []
        for k, r in enumerate(rows):
            cx = left + (k + 0.5) * step
            out.append(f'<line x1="{cx:.1f}" x2="{cx:.1f}" y1="{to(r["low"]):.1f}" y2="{to(r["high"]):.1f}" stroke="{t.ink}"/><rect x="{cx - step / 4:.1f}" y="{to(r["q3"]):.1f}" width="{step / 2:.1f}" height="{to(r["q1"]) - to(r["q3"]):.1f}" fill="{t.accent}"/><line x1="{cx - step / 4:.1f}" x2="{cx + step / 4:.1f}" y1="{to(r["median"]):.1f}" y2="{to(r["median"]):.1f}" stroke="{t.paper}"/>' + label(cx, bottom + 12, r["column"], "middle"))
        return "".join(out)
    nominal = any(e.channel == "x" and e.kind == "nominal" for e in p.encodings)
    xv = list(range(len(rows))) if nominal else [_num(r[x]) for r in rows]
    yv = [_num(r[y]) for r in rows]
    ends = [_num(r["high"]) for r in rows] if p.mark == "histogram" and "high" in rows[0] else xv
    tx, ty = _scale(min(xv), max(ends), left, right), _scale(min(0.0, *yv) if p.mark in ("histogram", "column", "area") else min(yv), max(yv), bottom, top)
    axis = f'<line x1="{left}" x2="{right}" y1="{bottom}" y2="{bottom}" stroke="{t.ink}"/>' + label(left, bottom + 14, rows[0][x]) + label(right, bottom + 14, rows[-1][x], "end") + label(4, top + 8, f"{max(yv):g}") + label(4, bottom, f"{min(yv):g}")
    rules = "".join(f'<line x1="{tx(v):.1f}" x2="{tx(v):.1f}" y1="{top}" y2="{bottom}" stroke="{t.colours[1]}" stroke-dasharray="4"/>' for _, v in p.rules if min(xv) <= v <= max(ends))
    if p.mark in ("histogram", "column"):
        wide = (right - left) / max(1, len(rows))
        return axis + "".join(f'<rect x="{tx(a):.1f}" y="{ty(v):.1f}" width="{max(1.0, tx(b) - tx(a) if b != a else wide * 0.8):.1f}" height="{ty(0) - ty(v):.1f}" fill="{t.accent}" stroke="{t.paper}"/>' for a, b, v in zip(xv, ends, yv, strict=True)) + rules
    if p.mark == "scatter":
        return axis + "".join(f'<circle cx="{tx(a):.1f}" cy="{ty(b):.1f}" r="2.5" fill="{t.accent}" opacity="0.5"/>' for a, b in zip(xv, yv, strict=True))
    points = [(tx(a), ty(b)) for a, b in zip(xv, yv, strict=True)]
    if p.mark == "step":
        points = [q for a, b in zip(points, [*points[1:], points[-1]], strict=True) for q in (a, (b[0], a[1]))]
    return axis + f'<polyline fill="none" stroke="{t.accent}" points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in points)}"/>'


def save_chart(spec: ChartSpec, path: str) -> None:
    """By suffix: .svg, .json or .html; other formats need a drawing library that is not part of this package."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("svg", "json", "html"):
        raise BackendUnavailable(f".{kind} needs matplotlib or plotly")
    body = spec.to_json() if kind == "json" else render_svg(spec)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><title>{html.escape(spec.title)}</title>{body}" if kind == "html" else body)


@dataclass
class ChartSet:
    charts: list[ChartSpec] = field(default_factory=list)

    def add(self, chart: ChartSpec) -> ChartSet:
        self.charts.append(chart)
        return self

    def to_dict(self) -> dict[str, Any]:
        return {"charts": [c.to_dict() for c in self.charts]}
