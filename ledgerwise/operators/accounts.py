"""One as-of snapshot per account, with recurring revenue, net revenue and uncertainty marks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policies as P
from ..functions import money


def account_snapshots(invoices: DataFrame, as_of: str | None = None) -> DataFrame:
    """Latest invoice per account, ties by smallest invoice id, plus totals over its history.

    One aggregation with one-row buffers; no window and no second shuffle for ties: invoice ids are
    unique, so the latest date is tied exactly when its smallest and largest ids differ. Without
    ``as_of`` the latest accepted date counts, which excludes nothing.
    """
    if as_of is None:
        day = invoices.agg(F.max("invoice_date")).scalar()
        history = invoices
    else:
        day = F.to_date(F.lit(as_of))
        history = invoices.filter(F.col("invoice_date") <= day)
    age = -F.unix_date("invoice_date")
    snapshot = F.struct(
        *P.SNAPSHOT_ATTRIBUTES,
        "csat_score",
        F.col("invoice_id").alias("snapshot_invoice_id"),
        F.col("invoice_date").alias("snapshot_date"),
        "source_row",
    )
    df = history.groupBy("account_id").agg(
        F.min_by(snapshot, F.struct(age, "invoice_id")).alias("s"),
        F.max_by("invoice_id", F.struct(-age, "invoice_id")).alias("last_id"),
        F.sum(money.revenue_cents(F.col("status"), F.col("amount_usd_cents"))).alias("net"),
        *[
            (F.min(c) != F.max(c)).alias(f"changed_{c}") for c in P.SNAPSHOT_ATTRIBUTES
        ],
    )
    changed = F.array_compact(
        F.array(*[F.when(F.col(f"changed_{c}"), F.lit(c)) for c in P.SNAPSHOT_ATTRIBUTES])
    )
    return df.select(
        "account_id",
        "s.*",
        day.alias("as_of"),
        money.monthly_revenue_cents(
            F.col("s.plan"), F.col("s.seats"), F.col("s.discount_pct"), F.col("s.churned")
        ).alias("mrr_usd_cents"),
        F.col("net").alias("net_revenue_usd_cents"),
        changed.alias("changed_fields"),
        (F.col("last_id") != F.col("s.snapshot_invoice_id")).alias("latest_date_tie"),
    )


def snapshot_intervals(invoices: DataFrame) -> DataFrame:
    """Per account the intervals ``valid_from <= day < valid_to`` in which its snapshot holds; the last one is open.

    A snapshot changes only on days with invoices, so invoices are first summed per account and day,
    partially before the shuffle. What a window sees of an account is at most one row per calendar
    day, however many invoices it has.
    """
    snapshot = F.struct(
        *P.SNAPSHOT_ATTRIBUTES, "csat_score", F.col("invoice_id").alias("snapshot_invoice_id"), F.col("invoice_date").alias("snapshot_date")
    )
    daily = invoices.groupBy("account_id", F.col("invoice_date").alias("valid_from")).agg(
        F.min_by(snapshot, "invoice_id").alias("s"),
        (F.min("invoice_id") != F.max("invoice_id")).alias("latest_date_tie"),
        F.sum(money.revenue_cents(F.col("status"), F.col("amount_usd_cents"))).alias("net"),
        *[f(c).alias(f"{name}_{c}") for c in P.SNAPSHOT_ATTRIBUTES for name, f in (("low", F.min), ("high", F.max))],
    )
    following = Window.partitionBy("account_id").orderBy("valid_from")
    so_far = following.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = F.array(*[
        F.when(F.min(f"low_{c}").over(so_far) != F.max(f"high_{c}").over(so_far), F.lit(c)) for c in P.SNAPSHOT_ATTRIBUTES
    ])
    return daily.select(
        "account_id",
        "valid_from",
        F.lead("valid_from").over(following).alias("valid_to"),
        "s.*",
        money.monthly_revenue_cents(
            F.col("s.plan"), F.col("s.seats"), F.col("s.discount_pct"), F.col("s.churned")
        ).alias("mrr_usd_cents"),
        F.sum("net").over(so_far).alias("net_revenue_usd_cents"),
        F.array_compact(changed).alias("changed_fields"),
        "latest_date_tie",
    )


def snapshots_at(intervals: DataFrame, days: Column) -> DataFrame:
    """The snapshots on each of many ``days`` (an array of distinct dates, so it is bounded by the calendar).

    Each interval is repeated for the days in it: one row per account and day, and no join or shuffle.
    """
    held = F.filter("days", lambda d: (d >= F.col("valid_from")) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))))
    # The days may come from a subquery, which must stand outside of the lambda.
    given = intervals.withColumn("days", days)
    return given.select(F.explode(held).alias("as_of"), *intervals.columns).drop("valid_from", "valid_to")


def month_ends(invoices: DataFrame) -> Column:
    """The last days of all months from the first invoice to the last one."""
    first, last = (F.trunc(f("invoice_date"), "month") for f in (F.min, F.max))
    months = F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))
    return invoices.agg(F.transform(months, F.last_day)).scalar()


def mark_uncertainty(snapshots: DataFrame, excluded: DataFrame) -> DataFrame:
    """Add quarantined_history and snapshot_uncertain; ``excluded`` has distinct account ids."""
    marks = excluded.select("account_id", F.lit(True).alias("hit"))
    df = snapshots.join(marks, "account_id", "left")
    df = df.withColumn("quarantined_history", F.coalesce("hit", F.lit(False))).drop("hit")
    uncertain = (
        (F.size("changed_fields") > 0) | F.col("latest_date_tie") | F.col("quarantined_history")
    )
    return df.withColumn("snapshot_uncertain", uncertain.cast("int"))


def accounts_table(marked: DataFrame) -> DataFrame:
    return marked.select(*P.CURATED_ACCOUNT_COLUMNS)


def account_issues(marked: DataFrame) -> DataFrame:
    return marked.filter("snapshot_uncertain = 1").select(
        "source_row",
        "account_id",
        F.lit("account_snapshot_uncertain").alias("code"),
        "changed_fields",
        "latest_date_tie",
        "quarantined_history",
    )
