"""Raw text records to typed rows with their errors and issues; no row is dropped or merged."""

from decimal import Decimal
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policies as P
from ..functions import money
from ..functions.dates import apply_layers
from ..functions.text import (
    SPACE_CLASS, alias_key, blank_to_null, canonical, collect_where, strip,
)
from .date_resolution import (
    DATE_FIELDS, ISSUE_TYPE, date_issues, date_layers, format_evidence, issue,
)

# Fixed value: the accepted form of an address.
EMAIL = r"^[^{0}@]+@[^{0}@]+\.[^{0}@]+\z".format(SPACE_CLASS)
REQUIRED = ["invoice_id", "account_id", "account_name"]
ALIASED = {
    "plan": P.PLAN_ALIASES, "billing_cycle": P.CYCLE_ALIASES, "churned": P.CHURN_ALIASES,
    "payment_method": P.PAYMENT_ALIASES,
}
MISSING_GROUP = "__missing_row_"


LONG = ["seats", "csat_score", "support_tickets", "discount_pct", "amount"]


def _part(name: str, part: str) -> Column:
    """A part of a number beyond the short form; NULL for a short one."""
    return F.get(F.col("_parts"), F.lit(LONG.index(name)))[part]


@cache
def financial_layers() -> list[dict[str, Column]]:
    """Layers ending in currency, status, amount_local, amount_usd_cents and financial_error.

    The values are NULL together when the error is set.
    """
    amount, code, body, digits = (F.col(f"_{n}") for n in ("amount", "code", "body", "digits"))
    currency, status, cents = (F.col(f"_{n}") for n in ("currency", "status", "cents"))
    short, long = F.col("_amount_short"), F.col("_amount_long")
    coded = amount.rlike(r"[A-Za-z]{3}\z")
    symbol = None
    for name, mark in P.CURRENCY_SYMBOL.items():
        hit = currency == name
        symbol = F.when(hit, F.lit(mark)) if symbol is None else symbol.when(hit, F.lit(mark))
    # The sign is read from the text: an amount below half a cent rounds to zero.
    minus = F.startswith(digits, F.lit("-"))
    negative = minus & digits.rlike("[1-9]")
    sign_error = (status == "refunded") != negative
    zero = F.when(minus, F.lit("-0")).otherwise(F.lit("0"))
    usable = F.col("financial_error").isNull()
    return [
        {
            "_currency": F.upper(strip(F.col("currency"))),
            "_status_key": alias_key(F.col("status")),
            "_amount": strip(F.col("amount")),
        },
        {
            "_status": canonical(F.col("_status_key"), P.STATUS_ALIASES),
            "_code": F.when(coded, F.upper(F.right(amount, F.lit(3)))),
            "_body": F.when(coded, strip(F.substring(amount, F.lit(1), F.length(amount) - 3))).otherwise(amount),
        },
        {"_digits": F.when(F.startswith(body, symbol), strip(F.substring(body, 2, 2**31 - 1))).otherwise(body)},
        {"_amount_long": money.long_amount(digits)},
        {"_amount_short": F.when(long.isNull(), money.local_amount(digits)), "_parts": money.parts([F.col(f"_{n}_long") for n in LONG])},
        {
            "_amount_text": _part("amount", "text"),
            "_in_range": F.when(long.isNull(), F.abs(short) <= F.lit(Decimal(P.MAX_AMOUNT))).otherwise(
                ~money.beyond_range(*(_part("amount", p) for p in ("sig", "scale", "kept")))),
        },
        {"_cents": F.when(F.col("_in_range"), money.to_usd_cents(short, F.col("_amount_text"), currency))},
        {
            "financial_error": F.when(status.isNull(), F.lit(P.ERR_UNKNOWN.format("status"))).otherwise(
                F.coalesce(
                    money.amount_error(currency, code, digits, F.col("_in_range")),
                    F.when(sign_error, F.lit(P.ERR_SIGN)),
                    F.when(F.abs(cents) > P.MAX_CENTS, F.lit(P.ERR_CENTS)),
                )
            )
        },
        {
            "currency": F.when(usable, currency),
            "status": F.when(usable, status),
            "amount_usd_cents": F.when(usable, cents),
            "amount_local": F.when(usable, F.coalesce("_amount_text", F.when(short == 0, zero).otherwise(money.short_text(short)))),
        },
    ]


@cache
def number_layers() -> list[dict[str, Column]]:
    """Layers that type seats, discount_pct, csat_score and support_tickets."""
    whole = {"seats": 1, "csat_score": 1, "support_tickets": 0}
    text = {n: F.col(f"_{n}_text") for n in (*whole, "discount_pct")}
    value = {n: F.col(f"_{n}_value") for n in text}

    def apart(name: str) -> tuple[Column, Column, Column]:
        return F.col(f"_{name}_long"), _part(name, "sig"), _part(name, "scale")

    def bad(name: str) -> Column:
        error = money.whole_number_error(text[name], value[name], whole[name], *apart(name))
        return (text[name] != "") & error.isNotNull()

    discount = F.coalesce(_part("discount_pct", "text"), money.short_text(value["discount_pct"]))
    # Two empty layers: all long numbers are taken apart in the amount's fifth.
    return [
        {},
        {},
        {f"_{n}_text": strip(F.col(n)) for n in text},
        {
            **{f"_{n}_long": money.long_integer(text[n]) for n in whole},
            "_discount_pct_long": money.long_percentage(text["discount_pct"]),
        },
        {},
        {
            **{f"_{n}_value": money.whole_number(text[n], *apart(n)) for n in whole},
            "_discount_pct_value": money.short_percentage(text["discount_pct"]),
        },
        {
            "_seats_error": money.whole_number_error(text["seats"], value["seats"], whole["seats"], *apart("seats")),
            "_discount_error": money.percentage_error(text["discount_pct"], value["discount_pct"], *apart("discount_pct")),
            "_csat_bad": bad("csat_score") | F.coalesce(value["csat_score"] > 5, F.lit(False)),
            "_tickets_bad": bad("support_tickets"),
        },
        {
            "seats": F.when(F.col("_seats_error").isNull(), value["seats"]),
            "discount_pct": F.when(F.col("_discount_error").isNull(), discount),
            "csat_score": F.when(~F.col("_csat_bad"), value["csat_score"]),
            "support_tickets": F.when(~F.col("_tickets_bad"), value["support_tickets"]),
            "_terms_error": F.coalesce("_seats_error", "_discount_error"),
        },
    ]


@cache
def text_layers() -> list[dict[str, Column]]:
    email = F.col("_email")
    return [
        {
            "raw_invoice_id": F.col("invoice_id"),
            **{c: strip(F.col(c)) for c in REQUIRED},
            "region": F.upper(strip(F.col("region"))),
            "industry": blank_to_null(strip(F.col("industry"))),
            "_email": blank_to_null(strip(F.col("contact_email"))),
            **{f"_{c}_key": alias_key(F.col(c)) for c in ALIASED},
        },
        {
            "contact_email": F.when(email.rlike(EMAIL), email),
            **{c: canonical(F.col(f"_{c}_key"), table) for c, table in ALIASED.items()},
        },
    ]


@cache
def _check_columns() -> dict[str, Column]:
    shared_error = F.coalesce("financial_error", "_terms_error")
    errors = [
        (F.col("invoice_date").isNull(), F.lit(P.ERR_INVOICE_DATE)),
        *[(F.col(c) == "", F.lit(P.ERR_REQUIRED.format(c))) for c in REQUIRED],
        (~F.col("region").isin(P.REGIONS), F.lit(P.ERR_UNKNOWN.format("region"))),
        *[
            (F.col(c).isNull(), F.lit(P.ERR_UNKNOWN.format(c)))
            for c in ("plan", "billing_cycle", "churned")
        ],
        (shared_error.isNotNull(), shared_error),
    ]
    expected = money.list_price_cents(
        F.col("plan"), F.col("seats"), F.col("discount_pct"),
        money.lookup(F.col("billing_cycle"), P.BILLED_MONTHS, 2),
    )
    return {
        "errors": collect_where(errors, "string"),
        "_difference": F.abs("amount_usd_cents") - expected,
    }


@cache
def _result_columns() -> list:
    difference = F.col("_difference")
    issues = [
        *date_issues(),
        (F.col("_csat_bad"), issue("optional_invalid", "csat_score")),
        (F.col("_tickets_bad"), issue("optional_invalid", "support_tickets")),
        (
            F.col("_email").isNotNull() & F.col("contact_email").isNull(),
            issue("email_invalid", "contact_email"),
        ),
        (
            (F.col("_payment_method_key") != "") & F.col("payment_method").isNull(),
            issue("optional_invalid", "payment_method"),
        ),
        (
            (F.size("errors") == 0) & (F.abs(difference) > P.PRICE_TOLERANCE_CENTS),
            issue("price_fx_mismatch", "amount", difference_usd_cents=difference),
        ),
    ]
    # A record without an id is a group of its own.
    own_group = F.concat(F.lit(MISSING_GROUP), F.col("source_row").cast("string"))
    group = F.when(F.col("invoice_id") == "", own_group).otherwise(F.col("invoice_id"))
    return [
        "source_row",
        group.alias("invoice_group"),
        "raw_invoice_id",
        *P.INVOICE_COLUMNS,
        "financial_error",
        "errors",
        collect_where(issues, ISSUE_TYPE).alias("issues"),
    ]


def normalize(raw: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One typed row per raw record.

    ``raw`` has ``source_row`` and the 19 text columns; NULL counts as blank. The result has the canonical
    columns, ``invoice_group``, ``raw_invoice_id``, ``financial_error``, ``errors`` and ``issues``.
    ``evidence`` may come from a wider set of records.
    """
    if evidence is None:
        evidence = format_evidence(raw)
    raw = raw.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in P.LEDGER_COLUMNS})
    df = raw.withColumnsRenamed({f: f"raw_{f}" for f in DATE_FIELDS})
    df = apply_layers(df, text_layers(), date_layers(evidence), financial_layers(), number_layers())
    return df.withColumns(_check_columns()).select(*_result_columns())


def row_errors(rows: DataFrame) -> DataFrame:
    """Long form, one row per error. The outer explode keeps the optimizer from pushing a copy of
    the whole normalization below itself as a size filter."""
    return rows.select(
        "source_row", "invoice_group", F.explode_outer("errors").alias("error")
    ).filter(F.col("error").isNotNull())


def row_issues(rows: DataFrame) -> DataFrame:
    """Long form, one row per issue, with the invoice id as written in the source."""
    return rows.select(
        "source_row", F.col("raw_invoice_id").alias("invoice_id"), F.inline_outer("issues")
    ).filter(F.col("code").isNotNull())
