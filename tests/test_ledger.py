"""End-to-end results over the golden ledger, whose records and answers are fixed values."""

import json

import pytest
from conftest import golden_records, record
from pyspark.sql import functions as F

from ledgerwise.operators import accounts as A
from ledgerwise.operators import audit, dedup, quality
from ledgerwise.plans import metrics as M
from ledgerwise.plans.ledger import Ledger


@pytest.fixture(scope="module")
def ledger(make_raw):
    built = Ledger(make_raw(golden_records()))
    for name in ("rows", "groups"):
        built.__dict__[name] = getattr(built, name).cache()
    return built


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_revenue(ledger):
    assert rows(M.paid_revenue(ledger.invoices, "2024-01-01", "2025-01-01")) == [(271000,)]
    assert rows(M.refunds_and_net(ledger.invoices)) == [(4900, 266100)]
    assert rows(M.open_exposure(ledger.invoices)) == [(2, 24700)]


def test_period_is_half_open(ledger):
    assert rows(M.paid_revenue(ledger.invoices, "2024-01-15", "2024-02-15")) == [(222000,)]


def test_mean_mrr_counts_churned_accounts_as_zero(ledger):
    got = {r["region"]: (r["mean_mrr_cents"], r["accounts"]) for r in M.mean_mrr(ledger.snapshots).collect()}
    assert got == {"NA": (26950, 2), "LATAM": (13230, 1), "EMEA": (9900, 2), "APAC": (4900, 1)}
    assert rows(M.top_region(ledger.snapshots)) == [("NA", 26950, 2)]
    assert rows(M.segment_mean_mrr(ledger.snapshots, "EMEA")) == [("EMEA", 9900, 2)]


def test_snapshot_churn(ledger):
    got = {r["plan"]: tuple(r)[1:] for r in M.plan_churn(ledger.snapshots).collect()}
    assert got["enterprise"] == (1, 1, 10000) and got["starter"] == (0, 4, 0)


def test_top_accounts(ledger):
    assert rows(M.top_accounts(ledger.snapshots)) == [
        ("A6", "Zeta", 132300, "not_low"), ("A1", "Alpha", 93100, "low"), ("A2", "Beta", 29900, "not_low"),
        ("A5", "Epsilon", 10800, "unknown"), ("A3", "Gamma", 0, "not_low"),
    ]


def test_local_totals_keep_currencies_apart(ledger):
    got = {r["currency"]: r["amount_local"] for r in M.local_currency_totals(ledger.invoices).collect()}
    assert got["EUR"] == 100 and set(got) == {"EUR", "USD"}


def test_period_revenue_by_region(ledger):
    got = {tuple(r)[:2]: r["net_cents"] for r in M.period_revenue(ledger.invoices, ledger.snapshots).collect()}
    assert got[("NA", "2024-01")] == 49000 and got[("NA", "2024-03")] == -4900
    assert sum(got.values()) == 266100


def test_coverage(ledger):
    r = ledger.coverage.head().asDict()
    assert (r["source_records"], r["invoice_groups"], r["accepted_invoices"]) == (11, 9, 8)
    assert (r["equivalent_duplicate_copies"], r["quarantined_invoice_groups"]) == (1, 1)
    assert (r["quarantined_source_records"], r["modeled_accounts"]) == (2, 6)
    assert str(r["as_of"]) == "2024-03-15" and r["invoices_after_as_of"] == 0
    assert (r["total_min_cents"], r["total_max_cents"]) == (266100, 315100)


def test_report_with_warnings(ledger):
    report = ledger.report.head()
    assert report["warning_counts"] == {"price_fx_mismatch": 2}
    evidence = quality.coverage_evidence(ledger.report)
    assert evidence.columns[:2] == ["as_of", "accepted_invoices"] and len(evidence.columns) == 6


def test_provenance(ledger):
    assert rows(ledger.sources.filter("invoice_id = 'I1'"), "source_row") == [("I1", 2), ("I1", 3)]
    assert rows(ledger.quarantine) == [("I9", "conflicting_variants", 2, 0, 49000)]
    found = rows(ledger.quarantine_rows.select("source_row", "errors"), "source_row")
    assert found == [(11, []), (12, [])]


def test_as_of_snapshot(ledger):
    earlier = Ledger(ledger.raw, "2024-01-31")
    a1 = earlier.accounts.filter("account_id = 'A1'").head()
    assert (a1["snapshot_invoice_id"], a1["net_revenue_usd_cents"]) == ("I1", 49000)
    assert earlier.coverage.head()["invoices_after_as_of"] == 2


def test_snapshot_history_equals_the_model_of_each_day(ledger):
    days = ["2023-12-31", "2024-01-14", "2024-01-15", "2024-01-31", "2024-02-29", "2024-03-31", "2030-01-01"]
    found = A.snapshots_at(A.snapshot_intervals(ledger.invoices), F.array(*[F.to_date(F.lit(d)) for d in days]))
    columns = [c for c in found.columns if c != "changed_fields"] + ["changed_fields"]
    got = sorted(map(tuple, found.select(*columns).collect()), key=str)
    want = [tuple(r) for d in days for r in Ledger(ledger.raw, d).snapshots.select(*columns).collect()]
    assert len(got) > 15 and got == sorted(want, key=str)


def test_annual_billing_does_not_change_mrr(ledger):
    assert ledger.accounts.filter("account_id = 'A6'").head()["mrr_usd_cents"] == 13230


def test_no_violations_after_dedup(ledger):
    assert ledger.violations().filter("n > 0").count() == 0
    broken = quality.violations_without_dedup(ledger.rows).filter("n > 0")
    assert rows(broken) == [("invoices.invoice_id unique", 2)]


def test_audit(ledger, spark):
    wanted = spark.createDataFrame([("I9",), ("I3",)], "invoice_id string")
    found = audit.invoice_audit(ledger.rows, ledger.groups, ledger.raw, wanted)
    got = rows(found.drop("detail", "min_cents", "max_cents"), "source_row", "kind")
    assert got == [
        ("I3", 5, None, "issue"), ("I3", 5, None, "record"),
        ("I9", 11, "conflicting_variants", "record"), ("I9", 12, "conflicting_variants", "record"),
    ]
    raw = {r["source_row"]: r.asDict() for r in ledger.raw.drop("record_id").collect()}
    bounds = {g["invoice_group"]: (g["min_cents"], g["max_cents"]) for g in ledger.groups.collect()}
    for r in found.collect():
        assert (r["min_cents"], r["max_cents"]) == bounds[r["invoice_id"]]
        detail = json.loads(r["detail"])
        if r["kind"] == "record":
            assert {"source_row": r["source_row"], **detail} == raw[r["source_row"]]
        else:
            assert detail["code"] == "price_fx_mismatch" and detail["field"] == "amount" and detail["difference_usd_cents"]
    every = audit.invoice_audit(ledger.rows, ledger.groups, ledger.raw)
    assert [r[1] for r in rows(every, "source_row")] == [11, 12]


def test_changed_identity_is_marked(make_raw):
    records = golden_records()
    records[3].update(account_name="Changed", churned="Yes")
    built = Ledger(make_raw(records))
    a1 = built.marked.filter("account_id = 'A1'").head()
    assert (a1["snapshot_uncertain"], a1["churned"], a1["mrr_usd_cents"]) == (1, 1, 0)
    assert a1["changed_fields"] == ["account_name", "churned"]


def test_ties_and_quarantined_history(make_raw):
    records = [record("J2"), record("J1"), record("J3", account_id="A2"), record("J4", account_id="A2", amount="x1")]
    marked = {r["account_id"]: r for r in Ledger(make_raw(records)).marked.collect()}
    assert marked["A1"]["snapshot_invoice_id"] == "J1" and marked["A1"]["latest_date_tie"]
    assert marked["A2"]["quarantined_history"] and not marked["A2"]["latest_date_tie"]


def test_invalid_variant_quarantines_group_with_unknown_bounds(make_raw):
    records = golden_records()
    records[1].update(amount="unknown")
    built = Ledger(make_raw(records))
    assert built.invoices.filter("invoice_id = 'I1'").count() == 0
    r = built.coverage.head()
    assert r["excluded_unknown_groups"] == 1 and r["total_max_cents"] is None


def test_bad_date_keeps_known_bounds(make_raw):
    built = Ledger(make_raw([record("I1", invoice_date="soon"), record("I2")]))
    assert rows(built.quarantine) == [("I1", "invalid_variant", 1, 49000, 49000)]


def test_blank_ids_never_group(make_raw):
    built = Ledger(make_raw([record(" "), record(""), record("I2")]))
    assert sorted(r["invoice_id"] for r in built.quarantine.collect()) == ["__missing_row_2", "__missing_row_3"]


def test_hot_groups_give_the_same_verdicts(make_raw):
    records = [record("HOT")] * 40 + [record("BAD", seats=str(n)) for n in range(30)] + golden_records()
    built = Ledger(make_raw(records))
    thin = built.rows.select("invoice_group", "invoice_id", "source_row", "account_id", "errors")
    plain = dedup.rows_with_verdict(thin, built.groups)
    split = dedup.rows_with_verdict(thin, built.groups, hot_group_rows=5)
    assert rows(split.select(*sorted(split.columns)), "source_row") == rows(
        plain.select(*sorted(plain.columns)), "source_row"
    )
    assert split.count() == len(records)


def test_every_record_is_accounted_for(ledger):
    r = ledger.coverage.head()
    assert r["accepted_invoices"] + r["equivalent_duplicate_copies"] + r["quarantined_source_records"] == 11
    assert ledger.verdicts.select(F.count_distinct("source_row")).head()[0] == 11
