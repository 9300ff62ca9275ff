import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from datawright.functions import cells
from datawright.functions.entities import EntityPack
from datawright.operators import anomaly, association, charts, drift, linkage, mechanism, panel, preprocess, privacy, profile, statistics, timeseries
from datawright.plans.contract import DataContract, learn_rules
from datawright.plans.state import Clause, ViewState
from datawright.plans.validate import Outcome, ValidationFailed, ValidationPlan
from datawright.sources.frames import Fingerprint, RowIndex, Versions, read, row_key, with_row_id


def one(df):
    return df.first()[0]


def test_cells(spark):
    texts = ["1", "1,200.5", "12f", " 7 ", "1_000", "nan", "", None, "x"]
    d = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in d.select(cells.number(d, "s")).collect()] == [1.0, 1200.5, None, 7.0, None, None, None, None, None]
    assert [r[0] for r in d.select(cells.cell(d, "s").form).collect()] == ["numeric-string", "formatted-numeric-string", "string", "numeric-string", "string", "numeric-string", "string", "missing", "string"]
    n = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in n.select(cells.is_missing(n, "x")).collect()] == [False, True, True]
    assert d.select(cells.folded(F.lit("  Sétif  Été "))).first()[0] == "setif ete"
    assert one(d.select(cells.category_key(F.lit("Ré-tail ")))) == "rétail"


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dates(dt.date(1990, 1, 1), dt.date(2030, 12, 31)), st.sampled_from(["%Y-%m-%d", "%d/%m/%Y", "%m.%d.%Y"]))
def test_dates_read_back(spark, day, fmt):
    r = spark.range(1).select(cells.date_readings(F.lit(day.strftime(fmt)))).first()[0]
    assert day in {x["value"] for x in r}


def test_row_ids_and_versions(spark, tmp_path):
    d = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("k"))
    ids = [r["__row_id"] for r in with_row_id(d).collect()]
    assert sorted(ids) == list(range(1000))
    assert [r["k"] for r in with_row_id(d, ["k"]).orderBy("__row_id").collect()] == list(range(1000))
    assert row_key(d, "k")[1] == "key" and row_key(with_row_id(d.select((F.col("k") % 2).alias("z"))))[1] == "position"
    assert Fingerprint.of(d) == Fingerprint.of(d.orderBy("k")) != Fingerprint.of(d.filter("k > 0"))
    v = Versions()
    v.add(d, "raw")
    with pytest.raises(IndexError):
        v.restore(3)
    d.coalesce(1).write.csv(str(tmp_path / "t.csv"), header=True)
    assert read(spark, str(tmp_path / "t.csv")).count() == 1000
    with pytest.raises(ValueError):
        read(spark, "t.xlsx")


def test_profile_kinds(spark):
    rows = [(float(k), ["a", "b", "c"][k % 3], f"note {k}", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), "same", None, k % 2 == 0, [k]) for k in range(60)]
    d = spark.createDataFrame(rows, "amount double, grade string, note string, at timestamp, const string, nothing string, flag boolean, blob array<int>")
    p = profile.profile(profile.ordinal(d, "grade", ["a", "b", "c"]), histograms=True)
    assert {n: c.kind for n, c in p.columns.items()} == {"amount": "numeric", "grade": "ordinal", "note": "text", "at": "datetime", "const": "constant", "nothing": "empty", "flag": "boolean", "blob": "unsupported"}
    assert p.columns["flag"].summary["rate_true"] == 0.5 and sum(n for _, _, n in p.columns["amount"].bins) == 60
    assert p.columns["amount"].is_identifier_like and p.columns["at"].summary["frequency"] == "daily"
    q = profile.profile(d.withColumn("amount", F.col("amount") * 2))
    changes, flags = profile.compare_profiles(p, q)
    assert any(c.metric == "mean" and c.relative == pytest.approx(1.0) for c in changes) and any("mean" in f for f in flags)
    assert len(charts.overview_charts(p)) > 2 and profile.support_table().count("\n") == 10


def test_moments_match_numpy(spark):
    x = np.array([1.0, 2, 4, 8, 20])
    r = profile.numeric_summary(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"]).first()
    assert r["std"] == pytest.approx(x.std()) and r["skew"] == pytest.approx(1.6406, abs=1e-4) and r["kurtosis"] == pytest.approx(2.6125, abs=1e-4)
    same = profile.numeric_summary(spark.createDataFrame([(3.0,)] * 4, "x double"), ["x"]).first()
    assert (same["skew"], same["outliers"]) == (0.0, 0)


def test_associations(spark):
    r = random.Random(1)
    rows = [(float(k), float(k * k), "u" if k < 50 else "v", ["p", "q"][r.randrange(2)]) for k in range(100)]
    d = spark.createDataFrame(rows, "a double, b double, g string, h string")
    m = association.associations(d)
    best = m.strongest(1)[0]
    assert best.value == pytest.approx(1.0) and best.method == "spearman"
    assert m.as_grid()["a"]["a"] == 1.0
    assert one(association.correlation(d, "a", "b", "kendall")) == pytest.approx(1.0)
    assert one(association.cramers_v(d, "g", "g")) == pytest.approx(1.0, abs=0.02)
    assert one(association.correlation(d.filter("a < 2"), "a", "b")) is None


def test_mechanism(spark):
    r = random.Random(2)
    rows = []
    for _ in range(400):
        region = r.choice("NS")
        rows.append((None if r.random() < {"N": 0.6, "S": 0.05}[region] else r.gauss(0, 1), region, r.gauss(0, 1)))
    d = spark.createDataFrame(rows, "income double, region string, noise double")
    found = mechanism.mechanism(d)
    assert [(m.column, m.verdict) for m in found] == [("income", "not_mcar")]
    assert {t.predictor: t.is_significant for t in found[0].tests} == {"region": True, "noise": False}


def test_statistics():
    assert statistics.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert statistics.chi2_quantile(0.999, 3) == pytest.approx(16.26624, abs=1e-4)
    assert statistics.chi2_tail(10.0, 5) == pytest.approx(0.0752352, abs=1e-6)
    assert statistics.normal_tail(1.96) == pytest.approx(0.0249979, abs=1e-6)
    assert statistics.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


def test_anomalies(spark):
    r = np.random.default_rng(3)
    h = r.normal(170, 10, 400)
    rows = [(k, float(a), float(a * 0.9 + r.normal(0, 1))) for k, a in enumerate(h)] + [(999, 190.0, 150.0)]
    d = spark.createDataFrame(rows, "__row_id long, h double, w double")
    top = anomaly.joint(d, ["h", "w"]).first()
    assert top["__row_id"] == 999
    assert anomaly.joint(d.limit(5), ["h", "w"]).count() == 0
    t = spark.createDataFrame([(k, "cold", 0.0 + k % 3) for k in range(40)] + [(40, "cold", 25.0)] + [(41 + k, "hot", 25.0 + k % 3) for k in range(40)], "__row_id long, city string, temp double")
    assert [x["__row_id"] for x in anomaly.contextual(t, "temp", "city").collect()] == [40]


def test_drift(spark):
    r = np.random.default_rng(4)
    a = spark.createDataFrame([(float(x), c) for x, c in zip(r.normal(0, 1, 400), r.choice(list("abc"), 400), strict=True)], "x double, c string")
    b = spark.createDataFrame([(float(x), c) for x, c in zip(r.normal(2, 1, 400), r.choice(list("abd"), 400), strict=True)], "x double, c string")
    rep = {d.column: d for d in drift.compare(a, b).found}
    assert rep["x"].severity == "extreme" and rep["c"].new == ("d",) and rep["c"].lost == ("c",) and rep["c"].severity == "severe"
    assert not drift.compare(a, a).drifted
    c = drift.cleaning_drift({"A": 1, "B": 2}, {"B": 4, "C": 1})
    assert (c["appeared"], c["resolved"], c["worsened"]) == (["C"], ["A"], ["B"])


def test_timeseries_and_panel(spark):
    day = dt.datetime(2024, 1, 1)
    times = [0, 1, 2, 2, 5, 4]
    d = spark.createDataFrame([(k, day + dt.timedelta(days=t), 1.0) for k, t in enumerate(times)], "__row_id long, at timestamp, v double")
    r = timeseries.timeseries(d, "at", ["v"], stale_after=3)
    assert (r.duplicates, r.out_of_order, r.cadence, r.missing, r.stale) == (1, 1, "daily", 1, {"v": 1}) and r.coverage == pytest.approx(5 / 6)
    p = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 5.0), ("b", 2, 5.0), ("b", 2, 5.0), ("c", 1, 7.0)], "firm string, year int, x double")
    rep = panel.panel(p, "firm", "year")
    assert (rep.facts["entities"], rep.facts["duplicates"], rep.facts["balanced"]) == (3, 1, False) and rep.variations[0].constant_within


def test_linkage(spark):
    d = spark.createDataFrame([(0, "Café Réal", "Oran"), (1, "cafe real", "oran"), (2, "Cafe Reale", "Oran"), (3, "Zoo", "Oran"), (4, None, "Oran")], "__row_id long, name string, city string")
    pairs = [(r["left"], r["right"]) for r in linkage.link(d, ["name", "city"]).collect()]
    assert (0, 1) == pairs[0] and {(0, 2), (1, 2)} <= set(pairs) and all(3 not in p for p in pairs)
    assert linkage.recall(d, "name").compared == 3
    with pytest.raises(linkage.BlockTooLarge):
        linkage.link(spark.range(3000).select(F.col("id").alias("__row_id"), F.lit("x").alias("n")), ["n"])


def test_validation(spark):
    d = spark.createDataFrame([(1, 3.0, "a"), (1, None, "b"), (2, 9.0, "zz"), (3, 4.0, None)], "id int, rating double, status string")
    plan = ValidationPlan().unique("id").not_null("rating").between("rating", 1, 5).isin("status", ["a", "b"]).matches("status", "[az]").column_exists("gone").custom("rating > 1 & id < 3").between("gone", 0, 1)
    r = plan.run(d)
    assert [x.failed for x in r.results] == [2, 1, 1, 1, 1, 4, 2, 4]
    good, bad = ValidationPlan().unique("id").between("rating", 1, 5).run(d).split()
    assert (good.count(), bad.count()) == (1, 3)
    with pytest.raises(ValidationFailed):
        r.raise_if_failed()
    with pytest.raises(ValueError):
        plan.unique("id")
    assert ValidationPlan().between("id", 1, 3).run(d).outcome is Outcome.PASS and ValidationPlan().not_null("id").run(d.limit(0)).outcome is Outcome.PASS


def test_contracts_and_learning(spark):
    d = spark.createDataFrame([(k, float(k % 9), ["x", "y"][k % 2], None if k % 5 else "n") for k in range(60)], "id long, v double, s string, note string")
    c = DataContract.infer(d)
    assert c.primary_key == "id" and DataContract.from_dict(c.to_dict()) == c and c.to_plan().run(d).outcome is Outcome.PASS and "allowed" in c.to_yaml()
    changed = DataContract.infer(d.withColumn("v", F.lit("t")).drop("note"))
    assert DataContract.is_breaking(c.diff(changed)) and not c.diff(c)
    learned = learn_rules(d)
    kinds = {(r.column, r.kind) for r in learned.rules}
    assert {("id", "unique"), ("v", "between"), ("s", "isin"), ("v", "not_null")} <= kinds and ("v", "unique") not in kinds
    assert learned.plan().run(d).outcome is Outcome.PASS and learn_rules(d.limit(10)).abstained and "plan.isin" in learned.to_python()


def test_preprocessing(spark):
    rows = [(k, None if k % 9 == 0 else float(k), ["a", "b", "c"][k % 3], float(k % 2)) for k in range(45)]
    d = spark.createDataFrame(rows, "__row_id long, x double, g string, y double")
    p = preprocess.Preprocessor("y").indicator("x").impute("x", "median").encode("g", "one_hot").scale("x", "standard")
    out = p.fit_transform(d)
    assert {"x__was_missing", "g__a"} <= set(out.columns) and out.agg(F.avg("x")).first()[0] == pytest.approx(0, abs=1e-9)
    unseen = spark.createDataFrame([(0, 1.0, "zz", 0.0)], d.schema)
    assert p.transform(unseen).select("g__a", "g__b", "g__c").first() == (0, 0, 0)
    with pytest.raises(preprocess.NotFitted):
        preprocess.Preprocessor().scale("x").transform(d)
    with pytest.raises(ValueError):
        preprocess.Preprocessor().encode("g", "target")
    oof = preprocess.Preprocessor("y").encode("g", "target").fit_transform(d).select("g").distinct().count()
    assert oof > 3
    leak = preprocess.Preprocessor("y").encode("g", "smoothed_mean_target").impute("x", "ffill")
    assert len(leak.check(d)) == 2
    ff = preprocess.Preprocessor().impute("x", "interpolate").fit_transform(d).orderBy("__row_id").collect()
    assert ff[0]["x"] is None and ff[9]["x"] == 9.0
    advice = preprocess.recommend(d, target="y")
    assert {"impute", "encode", "scale"} <= {a.kind for a in advice} and preprocess.to_preprocessor(advice, "y").fit_transform(d).count() == 45
    assert preprocess.fit_yeo(spark.createDataFrame([(math.exp(k / 10),) for k in range(60)], "x double"), "x") < 0.5


def test_privacy(spark):
    d = spark.createDataFrame([("a@b.com", "4532015112830366", "10.0.0.1", "1234567812345678", "call a@b.org now", 1.0), ("c@d.net", "4532015112830366", "10.0.0.2", "8765432187654321", "nothing", 2.0)], "contact string, card string, ip string, order_ref string, note string, salary double")
    kinds = {(f.column, f.kind): f for f in privacy.scan(d).findings}
    assert {("contact", "email"), ("card", "credit_card"), ("ip", "ipv4"), ("note", "email"), ("salary", "salary")} <= set(kinds) and ("order_ref", "credit_card") not in kinds
    assert kinds["note", "email"].embedded and kinds["salary", "salary"].from_name
    masked = [r[0] for r in spark.createDataFrame([("john@x.org",), ("abcdef",), ("ab",), (None,)], "s string").select(privacy.mask(F.col("s"))).collect()]
    assert masked == ["j***@x.org", "a***ef", "**", None]
    assert one(spark.range(1).select(privacy.generalise(F.lit(37)))) == "[30, 40)"
    risk = privacy.reidentification(spark.createDataFrame([("x",), ("x",), (None,)], "q string"), ["q"]).first()
    assert risk["unique_rows"] == 1 and risk["level"] == "medium"


def test_filters_and_charts(spark, tmp_path):
    d = spark.createDataFrame([(0, "1"), (1, "5"), (2, "Text"), (3, None)], "__row_id long, n string")
    rows = lambda *c: [r[0] for r in ViewState(c).view(d).orderBy("__row_id").collect()]
    assert rows(Clause("n", "gt", 2)) == [1] and rows(Clause("n", "contains", "EX")) == [2] and rows(Clause("n", "missing")) == [3] and rows(Clause("gone", "eq", 1)) == [] and rows(Clause("n", "in", [1, "Text"])) == [0, 2]
    s = ViewState((Clause("n", "present"),)).select([2, 3, 77])
    assert [r[0] for r in s.selected(d).collect()] == [2] and ViewState.from_json(s.to_json()) == s
    t = spark.createDataFrame([(k, float(k), float(-k), ["a", "b"][k % 2], dt.datetime(2024, 1, 1 + k % 28)) for k in range(100)], "__row_id long, x double, y double, g string, at timestamp")
    fields = charts.fields_of(profile.profile(t))
    marks = {charts.compose(t, fields, c).mark for c in (charts.Composition("x", "y", facet="g"), charts.Composition("g", "x"), charts.Composition("at", "x"), charts.Composition("x"), charts.Composition("at"))}
    assert marks == {"scatter", "bar", "line", "histogram", "column"}
    with pytest.raises(charts.Refused):
        charts.compose(t, fields, charts.Composition("g", "x", facet="g"))
    faceted = charts.compose(t, fields, charts.Composition("x", "y", facet="g"))
    assert len(faceted.panels()) == 2 and charts.render_svg(faceted).count("<circle") == 100
    charts.save_chart(charts.ecdf_chart(t, "x"), str(tmp_path / "e.svg"))
    with pytest.raises(charts.BackendUnavailable):
        charts.save_chart(faceted, "x.png")
    assert charts.recommend(fields)[0].composition.x == "at"


def test_entities():
    p = EntityPack()
    assert p.resolve(" alger ", "city") == ("DZ.ALG", "transliteration", 0.97) and p.resolve("nowhere", "city")[1] == "unresolved"
    with pytest.raises(ValueError):
        EntityPack((("A", "city", None, {"exact": ["X"]}), ("B", "city", None, {"exact": ["x"]})))


@pytest.mark.parametrize("sampled, gathered", [(20_000, 50_000), (100, 300)])
def test_quantiles_are_exact_at_every_size(spark, monkeypatch, sampled, gathered):
    """Few values are read off at once; many are bracketed by samples first, over several passes."""
    from datawright.operators import ordering

    monkeypatch.setattr(ordering, "SAMPLED", sampled)
    monkeypatch.setattr(ordering, "GATHERED", gathered)
    r = np.random.default_rng(3)
    n = 4_000
    data = {"plain": r.normal(size=n), "ties": np.where(r.random(n) < 0.4, 0.0, r.lognormal(size=n)), "levels": r.integers(0, 5, n).astype(float), "one": np.full(n, 3.0), "none": np.full(n, np.nan), "holes": np.where(r.random(n) < 0.5, np.nan, r.random(n))}
    df = spark.createDataFrame([tuple(None if np.isnan(v[k]) else float(v[k]) for v in data.values()) for k in range(n)], ", ".join(f"{c} double" for c in data))
    shares = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = ordering.quantiles(df, {c: F.col(c) for c in data}, shares)
    for c, v in data.items():
        present = v[~np.isnan(v)]
        assert (got[c] is None) == (not len(present))
        assert not len(present) or np.allclose(got[c], np.quantile(present, shares), rtol=1e-12)


def test_distinct_values_of_all_kinds_are_counted(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0.0D, 'a', true, DATE '2024-01-01', array(1)), (2, -0.0D, 'A', true, DATE '2024-01-02', array(1)), (2, double('nan'), NULL, NULL, NULL, NULL), (NULL, 1.5D, '', false, DATE '2024-01-01', array(2)) AS t(i, d, s, b, day, list)")
    assert profile.distinct_counts(df, df.columns) == {"i": 2, "d": 2, "s": 3, "b": 2, "day": 2, "list": 2}


def test_selections_outlive_repairs(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int").coalesce(1)
    index = RowIndex.of(d, "k")
    assert index.is_stable and index.positions_for(["c", "gone", "a"]) == [2, 0] and index.keys_for([1, 7, 0]) == ["b", "a"]
    assert [tuple(r) for r in index.restrict(["c", "a", "x"]).collect()] == [("a", 1), ("c", 3)]
    after = RowIndex.of(d.filter("k != 'a'").withColumn("v", F.col("v") + 1), "k")
    assert after.positions_for(index.keys_for([0, 2])) == [1]
    assert RowIndex.of(d).strength == "content" and RowIndex.of(d.unionByName(d)).to_dict() == {"source": "position", "stable": False, "rows": 6}
    assert index.positions_for([]) == [] and index.restrict([]).count() == 0
