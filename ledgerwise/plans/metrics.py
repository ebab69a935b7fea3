"""Business metrics over accepted invoices and account snapshots; money in whole USD cents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policies as P
from ..functions import money


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def _when(held: Column, value: str = "amount_usd_cents") -> Column:
    return F.when(held, F.col(value)).otherwise(0)


def in_period(start: str, end: str) -> Column:
    """Half-open: start <= invoice_date < end."""
    day = F.col("invoice_date")
    return (day >= F.to_date(F.lit(start))) & (day < F.to_date(F.lit(end)))


def paid_revenue(invoices: DataFrame, start: str, end: str) -> DataFrame:
    paid = invoices.filter((F.col("status") == "paid") & in_period(start, end))
    return paid.agg(_sum(F.col("amount_usd_cents")).alias("paid_cents"))


def paid_revenue_by_year(invoices: DataFrame) -> DataFrame:
    paid = invoices.filter(F.col("status") == "paid")
    return paid.groupBy(F.year("invoice_date").alias("year")).agg(
        _sum(F.col("amount_usd_cents")).alias("paid_cents"), F.count("*").alias("invoices")
    )


def refunds_and_net(invoices: DataFrame) -> DataFrame:
    """Refunds as a positive amount, and revenue net of them: two different measures."""
    status = F.col("status")
    return invoices.agg(
        (-_sum(_when(status == "refunded"))).alias("refunds_cents"),
        _sum(_when(status.isin(P.REVENUE_STATUSES))).alias("net_cents"),
    )


def open_exposure(invoices: DataFrame) -> DataFrame:
    waiting = invoices.filter(F.col("status").isin(P.EXPOSURE_STATUSES))
    return waiting.agg(
        F.count("*").alias("invoices"), _sum(F.col("amount_usd_cents")).alias("exposure_cents")
    )


def local_currency_totals(invoices: DataFrame) -> DataFrame:
    """Local amounts are never added across currencies; each counts with its first 15 decimal places."""
    amount = F.col("amount_local").cast("decimal(38,15)")
    return invoices.groupBy("currency").agg(
        F.sum(amount).alias("amount_local"), F.count("*").alias("invoices")
    )


def mean_mrr(snapshots: DataFrame, by: str = "region") -> DataFrame:
    """Mean recurring revenue per account, churned accounts counted with zero; cents half up."""
    df = snapshots.groupBy(by).agg(
        F.sum("mrr_usd_cents").alias("mrr_cents"), F.count("*").alias("accounts")
    )
    mean = F.expr("(2 * mrr_cents + accounts) div (2 * accounts)")
    return df.select(by, "mrr_cents", "accounts", mean.alias("mean_mrr_cents"))


def top_region(snapshots: DataFrame) -> DataFrame:
    """The region with the highest exact mean; equal means fall to the first name."""
    exact = F.col("mrr_cents").cast("decimal(38,10)") / F.col("accounts")
    return (
        mean_mrr(snapshots)
        .orderBy(exact.desc(), "region")
        .limit(1)
        .select("region", "mean_mrr_cents", "accounts")
    )


def segment_mean_mrr(snapshots: DataFrame, region: str) -> DataFrame:
    """One segment of ``mean_mrr``, with the number of accounts behind it."""
    return mean_mrr(snapshots.filter(F.col("region") == region)).select(
        "region", "mean_mrr_cents", "accounts"
    )


def plan_churn(snapshots: DataFrame) -> DataFrame:
    """Churned share of each plan's accounts in the snapshot: a state, not a rate over a period."""
    df = snapshots.groupBy("plan").agg(
        F.sum("churned").alias("churned_accounts"), F.count("*").alias("accounts")
    )
    share = F.expr("(20000 * churned_accounts + accounts) div (2 * accounts)")
    return df.withColumn("churn_basis_points", share)


def csat_flag(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unknown").when(score <= P.LOW_CSAT, "low").otherwise("not_low")
    )


def top_accounts(snapshots: DataFrame, n: int = 5) -> DataFrame:
    """The n accounts with most net revenue, ties by account id; keeps n rows per task."""
    return (
        snapshots.orderBy(F.desc("net_revenue_usd_cents"), "account_id")
        .limit(n)
        .select(
            "account_id",
            "account_name",
            F.col("net_revenue_usd_cents").alias("net_cents"),
            csat_flag(F.col("csat_score")).alias("csat_flag"),
        )
    )


def account_ranking(snapshots: DataFrame) -> DataFrame:
    """All accounts with net revenue and satisfaction flag."""
    return snapshots.select(
        "account_id",
        F.col("net_revenue_usd_cents").alias("net_cents"),
        csat_flag(F.col("csat_score")).alias("csat_flag"),
    )


def period_revenue(invoices: DataFrame, snapshots: DataFrame, by: str = "region") -> DataFrame:
    """Net revenue per month and account attribute of the snapshot.

    Invoices are summed per account and month first, so each account is joined once and a busy
    account reaches the join as a few rows.
    """
    monthly = invoices.groupBy(
        "account_id", F.date_format("invoice_date", "yyyy-MM").alias("month")
    ).agg(F.sum(money.revenue_cents(F.col("status"), F.col("amount_usd_cents"))).alias("cents"))
    joined = monthly.join(snapshots.select("account_id", by), "account_id")
    return joined.groupBy(by, "month").agg(_sum(F.col("cents")).alias("net_cents"))
