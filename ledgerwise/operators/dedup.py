"""Invoice groups: equivalent copies collapse, anything else is quarantined as a whole."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import policies as P
from ..functions import money

# A group with more rows than this is joined apart from the others. There are at most
# (total rows / HOT_GROUP_ROWS) such groups, which bounds what is broadcast.
HOT_GROUP_ROWS = 1_000_000


def invoice_groups(rows: DataFrame) -> DataFrame:
    """One row per invoice group with the verdict and the all-dates revenue bounds.

    A group is accepted when no row has errors and all canonical values agree; the smallest and
    the largest variant are then equal, NULLs included. Every aggregate has a buffer of one row, so
    even a group with a large part of all rows shrinks to one row per task before the shuffle.
    """
    clean = F.size("errors") == 0
    variant = F.when(clean, F.struct(*P.INVOICE_COLUMNS))
    contribution = F.when(
        F.col("financial_error").isNull(),
        money.revenue_cents(F.col("status"), F.col("amount_usd_cents")),
    )
    df = rows.groupBy("invoice_group").agg(
        F.count("*").alias("n_rows"),
        F.min("source_row").alias("first_row"),
        F.bool_and(clean).alias("clean"),
        F.min(variant).alias("invoice"),
        F.max(variant).alias("last_variant"),
        F.count(contribution).alias("n_known"),
        F.min(contribution).alias("low"),
        F.max(contribution).alias("high"),
    )
    known = F.col("n_known") == F.col("n_rows")
    accepted = F.col("clean") & F.col("invoice").eqNullSafe(F.col("last_variant"))
    df = df.withColumn("accepted", accepted)
    return df.select(
        "invoice_group",
        "n_rows",
        "first_row",
        "accepted",
        F.when(~F.col("clean"), F.lit("invalid_variant"))
        .when(~F.col("accepted"), F.lit("conflicting_variants"))
        .alias("reason"),
        F.when(known, F.col("low")).alias("min_cents"),
        F.when(known, F.col("high")).alias("max_cents"),
        F.when(F.col("accepted"), F.col("invoice")).alias("invoice"),
    )


def accepted_invoices(groups: DataFrame) -> DataFrame:
    return groups.filter("accepted").select("invoice.*", F.col("first_row").alias("source_row"))


def quarantine(groups: DataFrame) -> DataFrame:
    """Excluded groups; the bounds are NULL when any variant's money cannot be read."""
    return groups.filter(~F.col("accepted")).select(
        F.col("invoice_group").alias("invoice_id"),
        "reason",
        "n_rows",
        F.col("min_cents").alias("alternative_net_revenue_min_cents"),
        F.col("max_cents").alias("alternative_net_revenue_max_cents"),
    )


def rows_with_verdict(
    rows: DataFrame, groups: DataFrame, hot_group_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Rows joined to their group's verdict, robust to groups with very many rows.

    The few groups above ``hot_group_rows`` are broadcast and their rows never shuffled; the rest
    is a plain join in which no key has more rows than that.
    """
    verdict = groups.select("invoice_group", "n_rows", "accepted", "reason", "min_cents", "max_cents")
    hot = F.broadcast(verdict.filter(F.col("n_rows") > hot_group_rows))
    cold = verdict.filter(F.col("n_rows") <= hot_group_rows)
    hot_rows = rows.join(hot, "invoice_group")
    cold_rows = rows.join(hot.select("invoice_group"), "invoice_group", "left_anti").join(
        cold, "invoice_group"
    )
    return hot_rows.unionByName(cold_rows)


def invoice_sources(judged: DataFrame) -> DataFrame:
    """One row per record behind an accepted invoice, copies included."""
    return judged.filter("accepted").select("invoice_id", "source_row")


def quarantine_rows(judged: DataFrame) -> DataFrame:
    """One row per record of an excluded group, with its errors; never one array per group."""
    return judged.filter(~F.col("accepted")).select(
        F.col("invoice_group").alias("invoice_id"), "source_row", "account_id", "reason", "errors"
    )


def excluded_accounts(quarantined: DataFrame) -> DataFrame:
    return quarantined.select("account_id").distinct()
