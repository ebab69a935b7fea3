"""Row rules: dates, money, numbers, categories; compared with plain Python where it helps."""

import random
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import pytest
from conftest import record

from ledgerwise.operators.date_resolution import evidence_table, resolve_dates
from ledgerwise.operators.dedup import invoice_groups
from ledgerwise.operators.normalize import normalize


@pytest.fixture(scope="module")
def dates(spark):
    def run(*pairs):
        df = spark.createDataFrame(list(pairs), "signup_date string, invoice_date string")
        return [r.asDict(recursive=True) for r in resolve_dates(df.coalesce(1)).collect()]

    return run


def test_cohort_evidence(dates):
    first = dates(("2023-01-01", "02-04-2024"), ("2023-01-01", "18-07-2024"))[0]
    assert first["invoice_date"] == date(2024, 4, 2)
    issue = first["issues"][0]
    assert issue["code"] == "date_inferred" and issue["evidence"].endswith("DMY")
    assert issue["candidates"] == [date(2024, 2, 4), date(2024, 4, 2)]


def test_contradictory_evidence_never_votes(dates):
    first = dates(("2023-01-01", "02-04-2024"), ("2023-01-01", "18-07-2024"), ("2023-01-01", "07-18-2024"))[0]
    assert first["invoice_date"] is None and first["issues"][0]["code"] == "date_unresolved"


def test_chronology(dates):
    first = dates(("2024-03-01", "02-04-2024"))[0]
    assert first["invoice_date"] == date(2024, 4, 2) and "chronology" in first["issues"][0]["evidence"]
    first = dates(("02-04-2024", "2024-03-01"))[0]
    assert first["signup_date"] == date(2024, 2, 4)


def test_no_circular_inference(dates):
    first = dates(("01-02-2024", "02-04-2024"))[0]
    assert (first["signup_date"], first["invoice_date"]) == (None, None)


def test_equal_readings_need_no_inference_and_give_no_evidence(dates, spark):
    first = dates(("2024-01-01", "05-05-2024"))[0]
    assert first["invoice_date"] == date(2024, 5, 5) and first["issues"] == []
    df = spark.createDataFrame([("2024-01-01", "05-05-2024")], "signup_date string, invoice_date string")
    assert evidence_table(df).collect() == []


def test_conflicting_order_is_flagged_not_changed(dates):
    first = dates(("2024-05-01", "2024-04-01"))[0]
    assert first["invoice_date"] == date(2024, 4, 1)
    assert [i["code"] for i in first["issues"]] == ["date_chronology_conflict"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-1-5", date(2024, 1, 5)), (" 2024/01/05 ", date(2024, 1, 5)), ("Jan 5 2024", date(2024, 1, 5)),
        ("FEB  29 2024", date(2024, 2, 29)), ("Feb 29 2023", None), ("January 5 2024", None), ("2024-13-01", None),
        ("31/12/2023", date(2023, 12, 31)), ("12/31/2023", date(2023, 12, 31)), ("31-04-2024", None),
        ("0000-01-01", None), ("01/02-2024", None), ("2024-01- 5", date(2024, 1, 5)), ("", None), ("29-02-1900", None),
    ],
)
def test_date_forms(dates, text, expected):
    got = dates(("2020-01-01", text))[0]
    assert got["invoice_date"] == expected
    assert (expected is None) == ([i["code"] for i in got["issues"]] == ["date_invalid"])


def test_readings_against_the_calendar(dates):
    """Random day/month/year texts against Python's own date type."""
    rng = random.Random(7)
    texts = [f"{rng.randint(0, 33)}/{rng.randint(0, 14)}/{rng.choice([1900, 2000, 2023, 2024])}" for _ in range(300)]

    def reading(text, form):
        try:
            return datetime.strptime(text, form).date()
        except ValueError:
            return None

    got = dates(*[("", t) for t in texts])
    both = [(reading(t, "%d/%m/%Y"), reading(t, "%m/%d/%Y")) for t in texts]
    proved = {"DMY" if b is None else "MDY" for a, b in both if (a is None) != (b is None)}
    for (a, b), row in zip(both, got):
        if a and b and a != b:
            expected = {("DMY",): a, ("MDY",): b}.get(tuple(sorted(proved)))
        else:
            expected = a or b
        assert row["invoice_date"] == expected


def one(make_raw, **changes):
    return normalize(make_raw([record("I1", **changes)])).head().asDict(recursive=True)


def many(make_raw, cases):
    rows = normalize(make_raw([record(f"I{n}", **c) for n, c in enumerate(cases)])).orderBy("source_row")
    return [r.asDict(recursive=True) for r in rows.collect()]


def test_amounts(make_raw):
    good = {
        ("1,200.00 EUR", "EUR"): "1200.00", ("$490.00", "usd"): "490", ("$-5", "USD"): None, (" 490 ", "USD"): "490",
        ("1,323.00 usd", "USD"): "1323", ("+7.5", "GBP"): "7.5", ("£ 7", "GBP"): "7", ("$ 12,345,678.9 USD", "USD"): "12345678.9",
        ("1000000000000", "USD"): "1000000000000",
    }
    got = many(make_raw, [{"amount": a, "currency": c} for a, c in good])
    for (amount, _), expected, row in zip(good, good.values(), got):
        if expected is None:
            assert row["errors"] == ["amount sign contradicts status"], amount
        else:
            assert row["errors"] == [] and row["amount_local"] == format(Decimal(expected).normalize(), "f"), amount
    bad = {
        ("1,20.00", "USD"): "invalid amount format", ("£49", "USD"): "invalid currency symbol",
        ("NaN", "USD"): "currency marker conflicts with currency column", ("100", "CAD"): "unknown currency",
        ("-$5", "USD"): "invalid currency symbol", ("$$5", "USD"): "invalid currency symbol",
        ("$€5", "USD"): "invalid currency symbol", ("1e3", "USD"): "invalid amount format", ("", "USD"): "invalid amount format",
        ("5.", "USD"): "invalid amount format", ("1000000000001", "USD"): "non-finite or out-of-range decimal",
        ("9" * 40, "USD"): "non-finite or out-of-range decimal", ("100 EUR", "USD"): "currency marker conflicts with currency column",
        ("1,0000", "USD"): "invalid amount format", ("1000000000000.1", "USD"): "non-finite or out-of-range decimal",
        ("1_000", "USD"): "invalid amount format",
    }
    for (case, expected), row in zip(bad.items(), many(make_raw, [{"amount": a, "currency": c} for a, c in bad])):
        assert row["errors"] == [expected] and row["amount_usd_cents"] is None, case


def test_cents_round_half_up_once(make_raw):
    cases = [("0.005", "USD", "paid", 1), ("-0.005", "USD", "refunded", -1), ("1.25", "EUR", "paid", 135),
             ("0.5", "GBP", "paid", 64), ("-0.5", "GBP", "refunded", -64)]
    got = many(make_raw, [{"amount": a, "currency": c, "status": s} for a, c, s, _ in cases])
    assert [r["amount_usd_cents"] for r in got] == [c[3] for c in cases]


def test_signs(make_raw):
    assert one(make_raw, amount="-490")["errors"] == ["amount sign contradicts status"]
    assert one(make_raw, status="refund")["errors"] == ["amount sign contradicts status"]
    assert one(make_raw, status="refund", amount="0")["errors"] == ["amount sign contradicts status"]
    assert one(make_raw, amount="0")["errors"] == []


def test_one_error_from_the_shared_block_in_fixed_order(make_raw):
    row = one(make_raw, status="?", currency="X", amount="?", seats="?", discount_pct="?")
    assert row["errors"] == ["unknown status"]
    assert one(make_raw, currency="X", seats="0")["errors"] == ["unknown currency"]
    assert one(make_raw, seats="0", discount_pct="101")["errors"] == ["invalid integer/range"]
    row = one(make_raw, invoice_date="?", account_id=" ", region="XX", plan="?", churned="maybe", discount_pct="101")
    assert row["errors"] == [
        "invoice_date is invalid or unresolved", "account_id is required", "unknown region", "unknown plan",
        "unknown churned", "discount outside 0..100",
    ]


def python_decimal(text):
    """A finite number within the limits, or None; only sizes are compared with 28 digits."""
    try:
        value = Decimal(text.strip())
    except InvalidOperation:
        return None
    return value if value.is_finite() and abs(value) <= 10**12 else None


def python_text(value):
    text = format(value.normalize(), "f")
    if len(text.partition(".")[2]) <= 60:
        return text
    sign, digits, exponent = value.normalize().as_tuple()
    return ("-" if sign else "") + "".join(map(str, digits)) + f"E-{-exponent}"


NUMBERS = [
    "1", "10.0", "1e1", " 7 ", "2.5", "0", "-1", "NaN", "inf", "", "1.", ".5", "5e-1", "1e400", "1e-400", "abc",
    "2147483647", "2147483648", "1e99999", "1E+2", "0x1", "--1", "1e", "12.50", "100", "100.0000000000001",
    "0e99999", "-0", "-0.0", "0e-99999", "1e-99999", "33.33333333333333", "19.989999999999998", "1_0", "_5_", "_", "1e1_0",
    "0.1234567890123456789012345678901234567890", "9.9999999999999999999999999999999999", "99.99999999999999999999999999999",
    "0" * 50 + "7", "5." + "0" * 40, "5." + "0" * 40 + "1", "1" + "0" * 12, "1" + "0" * 12 + "." + "0" * 30 + "1", "1" + "0" * 30 + "e-30",
    "0." + "0" * 59 + "7", "0." + "0" * 60 + "7", "12345678901234567890e-18", "1234567890123456789012345678.5e-27",
    "1234567890123456789012345677.5e-27", "1e0000000000000000000001", "1e00000000000000000000000000000000000000000000000000002",
]


def test_plain_numbers_against_decimal(make_raw):
    texts = NUMBERS
    for text, row in zip(texts, many(make_raw, [{"seats": t} for t in texts])):
        value = python_decimal(text)
        fine = value is not None and value == value.to_integral_value() and 1 <= value <= 2**31 - 1
        assert (row["errors"] == []) == fine, text
        assert row["seats"] == (int(value) if fine else None), text
    for text, row in zip(texts, many(make_raw, [{"support_tickets": t} for t in texts])):
        value = python_decimal(text)
        fine = value is not None and value == value.to_integral_value() and 0 <= value <= 2**31 - 1
        assert row["support_tickets"] == (int(value) if fine else None), text
    for text, row in zip(texts, many(make_raw, [{"discount_pct": t, "amount": "1"} for t in texts])):
        value = python_decimal(text)
        fine = value is not None and 0 <= value <= 100
        assert (row["errors"] == []) == fine, text
        assert row["discount_pct"] == (python_text(value) if fine else None), text


def python_cents(value):
    return int((value * 100).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def test_amounts_of_any_length(make_raw):
    rng = random.Random(5)
    texts = ["0.005", "0.00499999999999999999999999999999999999999", "0.005" + "0" * 40, "0.005" + "0" * 20 + "1", "-0.005" + "0" * 20 + "1",
             "0" * 40 + "12.5", "-0.00", "0." + "0" * 70 + "1", "19.989999999999998", "1" * 12 + "." + "4" * 40, "999999999999." + "9" * 30]
    texts += ["".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 12))) + "." +
              "".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 45))) for _ in range(60)]
    for currency, rate in [("USD", Decimal(1)), ("EUR", Decimal("1.08")), ("GBP", Decimal("1.27"))]:
        cases = [{"amount": t, "currency": currency, "status": "refund" if Decimal(t) < 0 else "paid"} for t in texts]
        for text, row in zip(texts, many(make_raw, cases)):
            value = Decimal(text)
            assert row["errors"] == [], text
            assert row["amount_local"] == python_text(value), text
            assert row["amount_usd_cents"] == python_cents(value * rate), (text, currency)


def test_list_price_with_long_discounts(make_raw):
    texts = ["33.33333333333333", "12.345678901234567890123", "0." + "0" * 30 + "1", "99.99999999999999999999", "50", "1e-99999"]
    cases = [{"discount_pct": t, "amount": "5000", "seats": s} for t in texts for s in ("1", "999999")]
    for case, row in zip(cases, many(make_raw, cases)):
        want = python_cents(Decimal(49) * int(case["seats"]) * (1 - Decimal(case["discount_pct"]) / 100))
        assert [i["difference_usd_cents"] for i in row["issues"] if i["code"] == "price_fx_mismatch"] == [500000 - want], case


def test_variants_differ_in_any_digit(make_raw):
    def verdict(first, second):
        rows = normalize(make_raw([record("I1", amount=first), record("I1", amount=second)]))
        return invoice_groups(rows).head()["accepted"]

    assert verdict("490.00", "490." + "0" * 30)
    assert verdict("1.5", "1.5" + "0" * 20 + "0")
    assert not verdict("1.50000000000000000001", "1.50000000000000000002")
    assert not verdict("0", "-0")
    assert verdict("1.5" + "0" * 26 + "4", "1.5" + "0" * 26 + "3")


def test_optional_fields_become_null_with_an_issue(make_raw):
    row = one(make_raw, contact_email="pay_at_alpha", csat_score="99", support_tickets="-1", payment_method="barter")
    assert [row[c] for c in ("contact_email", "csat_score", "support_tickets", "payment_method")] == [None] * 4
    assert row["errors"] == []
    assert sorted((i["code"], i["field"]) for i in row["issues"]) == [
        ("email_invalid", "contact_email"), ("optional_invalid", "csat_score"),
        ("optional_invalid", "payment_method"), ("optional_invalid", "support_tickets"),
    ]
    blank = one(make_raw, contact_email=" ", csat_score="", support_tickets=" ", payment_method="", industry=" ")
    assert blank["issues"] == [] and blank["industry"] is None


def test_price_mismatch_keeps_the_amount(make_raw):
    row = one(make_raw, amount="490.03")
    assert row["amount_usd_cents"] == 49003
    assert [(i["code"], i["difference_usd_cents"]) for i in row["issues"]] == [("price_fx_mismatch", 3)]
    assert one(make_raw, amount="490.02")["issues"] == []
    assert one(make_raw, amount="-480", status="refund")["issues"][0]["difference_usd_cents"] == -1000


def test_unicode_white_space_is_cut(make_raw):
    row = one(make_raw, region=" na ", account_name="　Alpha\x1f", plan="\tTier 1\n", seats=" 10 ")
    assert (row["region"], row["account_name"], row["plan"], row["seats"]) == ("NA", "Alpha", "starter", 10)
