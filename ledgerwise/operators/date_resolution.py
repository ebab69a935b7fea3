"""Data-dependent date interpretation: evidence over all records, then one row at a time."""

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policies as P
from ..functions.dates import apply_layers, reading_layers
from ..functions.text import collect_where

DATE_FIELDS = ["signup_date", "invoice_date"]
SEPARATORS = {"dash": "-", "slash": "/"}

ISSUE_TYPE = (
    "struct<code:string,field:string,raw:string,candidates:array<date>,evidence:string,"
    "difference_usd_cents:bigint>"
)


def issue(code: str, field: str, **details: Column) -> Column:
    """One issue as a struct of ISSUE_TYPE; details left out are NULL."""
    kinds = {
        "raw": "string", "candidates": "array<date>", "evidence": "string",
        "difference_usd_cents": "bigint",
    }
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(field).alias("field"),
        *[details.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()],
    )


@cache
def _evidence_columns() -> tuple[list[Column], list[Column]]:
    flags, orders = [], []
    for f in DATE_FIELDS:
        form, dmy, mdy = (F.col(f"_{f}_{part}") for part in ("form", "dmy", "mdy"))
        for name, mark in SEPARATORS.items():
            key = f"{f}_{name}"
            seen = form == mark
            flags.append(F.bool_or(seen & dmy.isNotNull() & mdy.isNull()).alias(f"{key}_dmy"))
            flags.append(F.bool_or(seen & mdy.isNotNull() & dmy.isNull()).alias(f"{key}_mdy"))
            entries = [(F.col(f"{key}_{o.lower()}"), F.lit(o)) for o in ("DMY", "MDY")]
            orders.append(collect_where(entries, "string").alias(key))
    return flags, orders


def format_evidence(raw: DataFrame) -> DataFrame:
    """One row: for each field and separator the array of day/month orders that records proved.

    A record proves an order when its text has exactly one valid reading. Every task reduces its
    rows to eight booleans before the shuffle.
    """
    texts = raw.select(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in DATE_FIELDS])
    readings = apply_layers(texts, *[reading_layers(f"_{f}", f) for f in DATE_FIELDS])
    flags, orders = _evidence_columns()
    return readings.agg(*flags).select(*orders)


def evidence_table(raw: DataFrame) -> DataFrame:
    """The evidence in long form: field, sep and the proved orders; no row without evidence."""
    entries = [
        F.struct(F.lit(f).alias("field"), F.lit(mark).alias("sep"), F.col(f"{f}_{name}").alias("orders"))
        for f in DATE_FIELDS
        for name, mark in SEPARATORS.items()
    ]
    return format_evidence(raw).select(F.inline(F.array(*entries))).filter(F.size("orders") > 0)


@cache
def _resolution_layers() -> list[dict[str, Column]]:
    firsts, resolved = {}, {}
    for f in DATE_FIELDS:
        dmy, mdy, order, first = (F.col(f"_{f}_{part}") for part in ("dmy", "mdy", "order", "first"))
        # First phase: explicit dates, single readings, and pairs settled by evidence.
        firsts[f"_{f}_first"] = (
            F.when(order.isNull(), F.coalesce(F.col(f"_{f}_explicit"), dmy, mdy))
            .when(order == "DMY", dmy)
            .when(order == "MDY", mdy)
        )
        # Second phase: an open pair looks at the other date, if the first phase resolved it.
        # It is settled when exactly one of its readings respects signup <= invoice.
        low, high = F.least(dmy, mdy), F.greatest(dmy, mdy)
        if f == "invoice_date":
            other = F.col("_signup_date_first")
            settled = F.when((low < other) & (high >= other), high)
        else:
            other = F.col("_invoice_date_first")
            settled = F.when((low <= other) & (high > other), low)
        resolved[f] = F.when(order == "open", settled).otherwise(first)
    return [firsts, resolved]


def date_layers(evidence: DataFrame) -> list[dict[str, Column]]:
    """Layers that turn raw_signup_date and raw_invoice_date into signup_date and invoice_date.

    The evidence is one row of four short arrays, read through one scalar subquery, so no join is
    needed. ``_<field>_order`` is NULL where there was nothing to choose, the trusted order, or
    'open'.
    """
    trusted = evidence.select(
        F.struct(*[
            F.when(F.size(key) == 1, F.get(key, 0)).alias(key)
            for key in (f"{f}_{name}" for f in DATE_FIELDS for name in SEPARATORS)
        ])
    ).scalar()
    orders = {}
    for f in DATE_FIELDS:
        form, dmy, mdy = (F.col(f"_{f}_{part}") for part in ("form", "dmy", "mdy"))
        order = F.when(form == "-", F.col("_trusted")[f"{f}_dash"]).otherwise(F.col("_trusted")[f"{f}_slash"])
        orders[f"_{f}_order"] = F.when(dmy != mdy, F.coalesce(order, F.lit("open")))
    readings = [
        {name: column for layer in pair for name, column in layer.items()}
        for pair in zip(*[reading_layers(f"_{f}", f"raw_{f}") for f in DATE_FIELDS])
    ]
    # A column of its own, so that the plan holds the subquery once.
    readings[-1]["_trusted"] = trusted
    return [*readings, orders, *_resolution_layers()]


@cache
def date_issues() -> list[tuple[Column, Column]]:
    """Condition and issue pairs over the columns of ``date_layers``."""
    found = []
    for f in DATE_FIELDS:
        order, dmy, mdy = (F.col(f"_{f}_{part}") for part in ("order", "dmy", "mdy"))
        raw, resolved = F.col(f"raw_{f}"), F.col(f).isNotNull()
        pair = F.array(F.least(dmy, mdy), F.greatest(dmy, mdy))
        evidence = F.when(order == "open", F.lit(P.EVIDENCE_CHRONOLOGY)).otherwise(
            F.concat(F.lit(P.EVIDENCE_FORMAT), order)
        )
        found += [
            (order.isNull() & ~resolved, issue("date_invalid", f, raw=raw)),
            (
                order.isNotNull() & resolved,
                issue("date_inferred", f, raw=raw, candidates=pair, evidence=evidence),
            ),
            (order.isNotNull() & ~resolved, issue("date_unresolved", f, raw=raw, candidates=pair)),
        ]
    late = F.col("signup_date") > F.col("invoice_date")
    return [*found, (late, issue("date_chronology_conflict", "invoice_date"))]


def resolve_dates(raw: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The two resolved dates and their issues for records with signup_date and invoice_date."""
    if evidence is None:
        evidence = format_evidence(raw)
    df = raw.withColumnsRenamed({f: f"raw_{f}" for f in DATE_FIELDS})
    df = apply_layers(df, date_layers(evidence))
    df = df.withColumn("issues", collect_where(date_issues(), ISSUE_TYPE))
    return df.drop(*[c for c in df.columns if c.startswith("_")])
