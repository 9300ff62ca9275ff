import datetime as dt

import pytest
from pyspark.sql import functions as F

from datawright.operators import mechanism, panel, timeseries
from datawright.plans import domain
from datawright.plans.model import RepairClass
from datawright.plans.validate import Outcome, ValidationPlan
from datawright.streaming import validate_stream


def test_domain_findings_go_to_people(spark):
    day = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(k, day + dt.timedelta(days=t), 1.0) for k, t in enumerate([0, 1, 2, 2, 5, 4])], "__row_id long, at timestamp, v double")
    found = domain.timeseries_issues(timeseries.timeseries(d, "at", ["v"], stale_after=3), "at")
    assert {i.id for i in found} == {"TS-DUPLICATE-at", "TS-GAP-at", "TS-ORDER-at", "TS-STALE-v"}
    assert {i.repair_class for i in found} == {RepairClass.DOMAIN_RULE_REQUIRED, RepairClass.AUTO_FIX_WITH_LOG, RepairClass.AMBIGUOUS}
    p = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 5.0), ("b", 1, 5.0), ("c", 1, 7.0)], "firm string, year int, x double")
    ids = {i.id: i for i in domain.panel_issues(panel.panel(p, "firm", "year"), "firm", "year")}
    assert set(ids) == {"PANEL-DUPLICATE-firm", "PANEL-UNBALANCED-firm", "PANEL-CONSTANT-WITHIN-x"} and ids["PANEL-DUPLICATE-firm"].repair_class is RepairClass.DO_NOT_TOUCH


def test_anomalies_links_and_mechanisms(spark):
    t = spark.createDataFrame([(k, "cold", 0.0 + k % 3) for k in range(40)] + [(40, "cold", 25.0)], "__row_id long, city string, temp double")
    (i,) = domain.anomaly_issues(t, by="city", value="temp")
    assert [r["row_id"] for r in i.row_ids(t).collect()] == [40]
    with pytest.raises(ValueError):
        domain.anomaly_issues(t, by="city")
    n = spark.createDataFrame([(0, "Acme Ltd"), (1, "acme ltd"), (2, "Zed")], "__row_id long, name string")
    (link,) = domain.link_issues(n, ["name"])
    assert link.id == "LINK-0-1" and len(link.treatments) == 3 and link.row_ids(n).count() == 2
    m = mechanism.Mechanism("x", "not_mcar", 9, [mechanism.Dependence("g", "chi2", 9.0, 0.001, 0.002)])
    assert domain.mechanism_issues([m])[0].columns == ("x", "g")


def test_streams_are_validated(spark, tmp_path):
    spark.createDataFrame([(1, 3.0), (2, 9.0)], "id int, x double").write.parquet(str(tmp_path / "in"))
    seen = []
    q = validate_stream(spark.readStream.schema("id int, x double").parquet(str(tmp_path / "in")), ValidationPlan().between("x", 1, 5), lambda r, k: seen.append(r.outcome), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen == [Outcome.CRITICAL]


def test_currency_count_and_rows_beyond_the_shown_pairs(spark):
    from datawright.plans.detectors import Context, CurrencyContext

    df = spark.createDataFrame([(k, "France", "EUR" if k < 5 else f"X{k}") for k in range(1205)], "__row_id long, country string, currency string")
    (issue,) = CurrencyContext().findings(df, Context(), {})
    assert issue.affected == 1200 and len(issue.details["pairs"]) == 1000
    assert {r[0] for r in issue.rows(df).collect()} == set(range(5, 1205))


def test_distinct_counts_are_exact_at_every_size(spark, monkeypatch):
    from datawright.operators import profile

    monkeypatch.setattr(profile, "EXACT_ROWS", 10, raising=False)
    found = profile.profile(spark.range(30_000).select(F.concat(F.lit("v"), "id").alias("a"))).columns["a"]
    assert found.distinct == 30_000
