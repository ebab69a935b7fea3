import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerwise.policies import LEDGER_COLUMNS  # noqa: E402
from ledgerwise.session import local_session, prepare  # noqa: E402

DEFAULTS = {
    "account_id": "A1", "account_name": "Alpha", "contact_email": "pay@alpha.example", "region": "NA",
    "industry": "Software", "plan": "Starter", "billing_cycle": "monthly", "seats": "10",
    "currency": "USD", "amount": "490", "discount_pct": "0", "status": "paid",
    "payment_method": "ach", "signup_date": "2023-01-01", "invoice_date": "2024-01-15",
    "churned": "No", "csat_score": "2", "support_tickets": "0",
}


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session("4", shuffle_partitions=4))
    session.sparkContext.setLogLevel("ERROR")
    return session


def record(invoice_id, **changes):
    return {"invoice_id": invoice_id, **DEFAULTS, **changes}


@pytest.fixture(scope="session")
def make_raw(spark):
    """Raw ledger from records, numbered from 2 in the given order."""

    def make(records):
        rows = [(n, *[r[c] for c in LEDGER_COLUMNS]) for n, r in enumerate(records, 2)]
        schema = "source_row bigint, " + ", ".join(f"{c} string" for c in LEDGER_COLUMNS)
        return spark.createDataFrame(rows, schema)

    return make


def golden_records():
    """The eleven records behind the published golden answers, contact addresses changed.

    They must match those answers: 9 invoices, one equivalent copy, one conflicting pair.
    """
    beta = {"account_id": "A2", "account_name": "Beta", "region": "EMEA"}
    gamma = {"account_id": "A3", "account_name": "Gamma", "region": "EMEA"}
    eta = {"account_id": "A7", "account_name": "Eta", "invoice_date": "2024-01-21"}
    return [
        record("I1", amount="$490.00", status="Complete", billing_cycle="Monthly"),
        record("I1", plan="starter", invoice_date="2024/01/15", signup_date="2023/01/01", churned="FALSE"),
        record("I2", invoice_date="2024-02-15"),
        record("I3", invoice_date="2024-03-15", amount="-49", status="REFUND"),
        record("I4", **beta, plan="Enterprise", seats="1", amount="299", invoice_date="2024-01-16",
               churned="Yes", csat_score="3"),
        record("I5", **gamma, plan="Pro", seats="2", amount="198", status="pending",
               invoice_date="2024-01-17", csat_score="4"),
        record("I6", account_id="A4", account_name="Delta", seats="1", amount="49", status="failed",
               invoice_date="2024-01-18"),
        record("I7", account_id="A5", account_name="Epsilon", region="APAC", seats="1", currency="EUR",
               amount="100 EUR", invoice_date="2024-01-19", csat_score="", contact_email=""),
        record("I8", account_id="A6", account_name="Zeta", region="LATAM", billing_cycle="annual", seats="3",
               amount="1,323.00 USD", discount_pct="10", invoice_date="2024-01-20", csat_score="5"),
        record("I9", **eta),
        record("I9", **eta, status="void"),
    ]
