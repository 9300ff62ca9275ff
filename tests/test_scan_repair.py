import json

import pytest
from conftest import CONTEXT
from pyspark.sql import functions as F

from datawright.plans import report
from datawright.plans.detectors import REGISTRY
from datawright.plans.model import Completion, Issue, Ladder, RepairClass, Risk, Severity, Treatment, classify, health
from datawright.plans.prepare import GuidedSession, Unfinished, WorkflowError, auto_prepare, default_workflow, guided_prepare
from datawright.plans.repair import preview
from datawright.plans.scan import scan


@pytest.fixture(scope="module")
def prepared(invoices):
    return auto_prepare(invoices, **CONTEXT)


def affected(found, name):
    return next((i.affected for i in found.issues if i.id == name), None)


def test_every_detector_completes(scanned):
    assert {c.detector: c.status for c in scanned.checks} == {n: "completed" for n in REGISTRY}
    assert scanned.coverage == 1.0 and len(REGISTRY) == 14


@pytest.mark.parametrize("name, rows", [
    ("DATE-INVALID-invoice_date", 2), ("DATE-AMBIGUOUS-invoice_date", 1), ("DATE-FORMAT-CONFLICT-invoice_date", 1), ("TYPE-invoice_date", 7), ("TYPE-unit_price", 2), ("TYPE-annual_revenue", 1), ("ID-META-invoice_id", 1), ("DUP-EXACT-invoice_id", 2), ("DUP-CONFLICT-invoice_id", 2),
    ("GEO-country-city", 2), ("CURRENCY-context", 1), ("RANGE-quantity", 2), ("RANGE-customer_rating", 1), ("SENTINEL-employee_count", 2), ("INVARIANT-invoice_amount", 3), ("UNICODE-sector", 1), ("MISS-STRUCTURAL-payment_date", 2), ("MISS-SUSPICIOUS-payment_date", 1),
    ("STATE-paid_without_payment_date", 1), ("STATE-paid_amount_mismatch", 1), ("ACCOUNTING-profit-exceeds-revenue", 1),
])
def test_planted_defects(scanned, name, rows):
    assert affected(scanned, name) == rows


def test_rows_of_findings_match_their_counts(scanned):
    counts = {r["finding_id"]: r["count"] for r in scanned.finding_rows().groupBy("finding_id").count().collect()}
    for i in scanned.issues:
        if i.rows is not None:
            assert counts.get(i.id, 0) == i.affected, i.id


def test_unknown_city_is_a_notice(scanned):
    i = next(i for i in scanned.issues if i.id == "GEO-unknown-city")
    assert i.severity is Severity.NOTICE and i.details == {"cities": 1, "cells": 1}


def test_category_variants(scanned):
    d = next(i for i in scanned.issues if i.id == "CAT-country").details
    assert d["mechanical"] == {"ALGERIA": "Algeria", " morocco": "Morocco"}


def test_only_and_strict(invoices):
    found = scan(invoices, only=["range_violation"], **CONTEXT)
    assert {c.detector for c in found.checks} == {"range_violation"}
    assert scan(invoices.select("quantity", "__row_id"), only=["duplicate_identifier"]).checks[0].status == "not_applicable"


def test_auto_prepare_repairs_and_records(prepared):
    done = {r.operation for r in prepared.audit.applied}
    assert {"parse_numeric", "parse_datetime_unambiguous", "canonicalise_mechanical", "fold_confusables", "record_only", "leave_unchanged"} <= done
    assert prepared.status is Completion.BLOCKED
    assert {r.issue for r in prepared.audit.refused} >= {"DUP-CONFLICT-invoice_id", "DATE-INVALID-invoice_date"}
    assert dict(prepared.clean_df.dtypes)["unit_price"] == "double"
    assert prepared.after.health.overall > prepared.before.health.overall
    assert prepared.clean_df.filter("sector = 'Retail'").count() == prepared.raw_df.filter("sector = 'Retail'").count() + 1


def test_second_run_changes_nothing(prepared):
    again = auto_prepare(prepared.clean_df, **CONTEXT)
    assert again.audit.cells_changed == 0


def test_rollback_and_finalize(prepared):
    assert prepared.rollback(0).schema == prepared.raw_df.schema
    with pytest.raises(Unfinished):
        prepared.finalize()
    with pytest.raises(Unfinished):
        _ = prepared.verified_df
    with pytest.raises(ValueError):
        prepared.waive("DATE-INVALID-invoice_date", " ")


def test_guided_session_replays(invoices, scanned):
    s = GuidedSession(scanned.data, scanned, CONTEXT)
    assert s.queue()[0].severity is Severity.BLOCKING
    with pytest.raises(ValueError):
        s.answer("DUP-CONFLICT-invoice_id")
    s.answer("SENTINEL-employee_count", "choose_alternative", "treat_as_missing")
    s.answer("STATE-paid_amount_mismatch", "waive", reason="agreed with the customer")
    saved = s.export_decisions()
    t = guided_prepare(invoices, decisions=json.loads(saved) | {"decisions": json.loads(saved)["decisions"] | {"GONE": {"answer": "skip"}}}, **CONTEXT)
    assert t.decisions == s.decisions
    r = t.finish()
    assert affected(r.after, "SENTINEL-employee_count") is None and "STATE-paid_amount_mismatch" in r.waived
    assert r.clean_df.filter(F.col("employee_count").isNull()).count() == 2


def test_preview_keeps_nothing(scanned):
    i = next(i for i in scanned.issues if i.id == "TYPE-unit_price")
    p = preview(scanned.data, i, "parse_numeric")
    assert p.deltas["mean"][0] == pytest.approx(p.deltas["mean"][1]) and p.treatment == "parse_numeric"


def test_workflow_equals_auto(invoices, prepared):
    run = default_workflow().run(invoices, **CONTEXT)
    assert run.cells_changed == prepared.audit.cells_changed
    w = default_workflow().enable("scan", False)
    with pytest.raises(WorkflowError):
        w.run(invoices)
    assert default_workflow().from_json(default_workflow().to_json()).to_python() == default_workflow().to_python()
    with pytest.raises(WorkflowError):
        default_workflow().connect("scan", "report")


def test_policy_routes_then_demotes():
    assert classify(1.0, Risk(Severity.BLOCKING))[0] is RepairClass.DO_NOT_TOUCH
    assert classify(1.0, Risk(has_treatment=False))[0] is RepairClass.AMBIGUOUS
    assert classify(1.0, Risk(domain_rule=True))[0] is RepairClass.DOMAIN_RULE_REQUIRED
    for c, want in ((0.98, RepairClass.SAFE_AUTO_FIX), (0.9, RepairClass.AUTO_FIX_WITH_LOG), (0.75, RepairClass.REVIEW_RECOMMENDED), (0.6, RepairClass.USER_CONFIRMATION_REQUIRED), (0.59, RepairClass.AMBIGUOUS)):
        assert classify(c, Risk())[0] is want
    assert classify(0.99, Risk(irreversible=True))[0] is RepairClass.USER_CONFIRMATION_REQUIRED
    assert classify(0.99, Risk(material=True))[0] is RepairClass.REVIEW_RECOMMENDED
    assert classify(0.5, Risk(irreversible=True))[0] is RepairClass.AMBIGUOUS
    with pytest.raises(ValueError):
        Ladder(0.9, 0.9)


def test_issue_checks_and_health():
    with pytest.raises(ValueError):
        Issue("X", "missingness", Severity.INFO, ("a",), 1.0, 1, (Treatment("t", 0.5),), recommended="u")
    i = Issue("X", "range_violation", Severity.CRITICAL_REVIEW, ("a",), 1.0, 50, (Treatment("a", 0.85), Treatment("b", 0.80)))
    assert i.repair_class is RepairClass.USER_CONFIRMATION_REQUIRED
    assert health([i], 100).dimensions["validity"] == pytest.approx(100 - 20 * (0.35 + 0.65 * 0.5))
    assert health([], 0).overall == 100


def test_reports(prepared, scanned, tmp_path):
    md = report.preparation_report(prepared)
    assert "## Not done" in md and "DUP-CONFLICT-invoice_id" in md
    page = report.studio_html(prepared, charts=2)
    assert page.count("<svg") >= 3 and len(page) < 2_500_000 and 'class="flagged"' in page
    for kind in ("md", "html", "ipynb", "json"):
        report.publish(prepared, str(tmp_path / f"r.{kind}"))
    with pytest.raises(report.SinkUnavailable):
        report.publish(prepared, "r.pdf")
    assert len(report.build_deck(prepared)) == 5 and report.capability_table().to_latex().startswith(r"\begin{tabular}")
    assert report.severity_table(scanned.issues).to_text() and report.category_table(scanned.issues).rows and report.column_table(scanned).to_html()


def test_clean_table_has_no_findings(spark):
    d = spark.createDataFrame([(k, float(k % 7), ["red", "blue"][k % 2]) for k in range(60)], "id long, x double, colour string")
    assert scan(d, key="id").issues == []
