"""Issue log, warning counts, coverage report and constraint checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policies as P
from ..functions import money
from .normalize import row_issues


def issue_log(rows: DataFrame, account_issues: DataFrame) -> DataFrame:
    """Row issues and account issues in one long table, one row per issue."""
    return row_issues(rows).unionByName(account_issues, allowMissingColumns=True)


def warning_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count("*").alias("n"))


def coverage_report(groups: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row of counts and the all-dates net revenue bounds.

    Groups are first summed per modeled account, then over all, so one pass over the groups also
    counts the accounts. A total is NULL when the money of any excluded group is unknown.
    """
    accepted, date = F.col("accepted"), F.col("invoice.invoice_date")
    in_scope = accepted if as_of is None else accepted & (date <= F.to_date(F.lit(as_of)))
    unknown = F.col("min_cents").isNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    sums = {
        "source_records": F.col("n_rows"),
        "invoice_groups": F.lit(1),
        "accepted_invoices": accepted.cast("int"),
        "equivalent_duplicate_copies": F.when(accepted, F.col("n_rows") - 1),
        "quarantined_invoice_groups": (~accepted).cast("int"),
        "quarantined_source_records": F.when(~accepted, F.col("n_rows")),
        "invoices_after_as_of": (accepted & ~in_scope).cast("int"),
        "accepted_subtotal_cents": F.when(
            accepted, money.revenue_cents(F.col("invoice.status"), F.col("invoice.amount_usd_cents"))
        ),
        "excluded_known_min_cents": F.when(~accepted, F.col("min_cents")),
        "excluded_known_max_cents": F.when(~accepted, F.col("max_cents")),
        "excluded_unknown_groups": (~accepted & unknown).cast("int"),
    }
    per_account = groups.groupBy(
        F.when(in_scope, F.col("invoice.account_id")).alias("account_id")
    ).agg(
        F.max(F.when(accepted, date)).alias("latest"),
        *[F.sum(value).alias(name) for name, value in sums.items()],
    )
    df = per_account.agg(
        F.count("account_id").alias("modeled_accounts"),
        (F.max("latest") if as_of is None else F.max(F.to_date(F.lit(as_of)))).alias("as_of"),
        *[total(F.col(name)).alias(name) for name in sums],
    )
    complete = F.col("excluded_unknown_groups") == 0
    subtotal = F.col("accepted_subtotal_cents")
    return df.withColumns({
        "total_min_cents": F.when(complete, subtotal + F.col("excluded_known_min_cents")),
        "total_max_cents": F.when(complete, subtotal + F.col("excluded_known_max_cents")),
    })


def full_report(coverage: DataFrame, warnings: DataFrame, source_sha256: Column | None = None) -> DataFrame:
    """The coverage row with policy texts and the warning counts as a map of at most eight codes."""
    counts = warnings.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n"))))
    ).scalar()
    digest = F.lit(None).cast("string") if source_sha256 is None else source_sha256
    return coverage.withColumns({
        "policy_version": F.lit(P.POLICY_VERSION),
        "provisional_policies": F.array(*[F.lit(text) for text in P.PROVISIONAL_POLICIES]),
        "warning_counts": counts,
        "source_sha256": digest,
    })


def coverage_evidence(report: DataFrame) -> DataFrame:
    """The only report fields that may accompany an answer."""
    return report.select(
        "as_of", "accepted_invoices", "modeled_accounts", "quarantined_invoice_groups",
        "warning_counts", "provisional_policies",
    )


def _bad_values(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n for predicates that every row must satisfy; a NULL predicate is a violation."""
    counts = df.agg(*[
        F.sum(F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(1)).alias(name)
        for name, rule in rules.items()
    ])
    entries = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"`{name}`"), F.lit(0)).cast("bigint").alias("n"))
        for name in rules
    ])
    return counts.select(F.inline(entries))


def _repeated(df: DataFrame, rule: str, *key: str) -> DataFrame:
    """Number of key values that occur more than once."""
    copies = df.groupBy(*key).agg(F.count("*").alias("copies"))
    return copies.agg(
        F.lit(rule).alias("rule"), F.count(F.when(F.col("copies") > 1, 1)).alias("n")
    ).select("rule", "n")


def _orphans(df: DataFrame, rule: str, parent: DataFrame, on: str) -> DataFrame:
    lost = df.join(parent.select(on), on, "left_anti")
    return lost.agg(F.lit(rule).alias("rule"), F.count("*").alias("n")).select("rule", "n")


def invoice_rules() -> dict[str, Column]:
    optional = {
        "csat_score": F.col("csat_score").between(1, 5),
        "support_tickets": F.col("support_tickets") >= 0,
    }
    required = ["account_id", "account_name", "amount_local", "amount_usd_cents", "discount_pct",
                "invoice_date", "source_row"]
    return {
        "invoices.region": F.col("region").isin(P.REGIONS),
        "invoices.plan": F.col("plan").isin(list(P.PLAN_ALIASES)),
        "invoices.billing_cycle": F.col("billing_cycle").isin(list(P.CYCLE_ALIASES)),
        "invoices.seats": F.col("seats") > 0,
        "invoices.currency": F.col("currency").isin(list(P.USD_CENTS_PER_UNIT)),
        "invoices.status": F.col("status").isin(list(P.STATUS_ALIASES)),
        "invoices.churned": F.col("churned").isin(0, 1),
        **{f"invoices.{c}": F.col(c).isNull() | rule for c, rule in optional.items()},
        **{f"invoices.{c} required": F.col(c).isNotNull() for c in required},
    }


def constraint_violations(
    raw_rows: DataFrame, invoices: DataFrame, sources: DataFrame, accounts: DataFrame, quarantined: DataFrame
) -> DataFrame:
    """One row per rule with its number of violations; a publishable ledger has only zeros."""
    required = ["account_name", "region", "plan", "seats", "discount_pct", "snapshot_date", "as_of", "net_revenue_usd_cents"]
    account_rules = {
        **{f"accounts.{c} required": F.col(c).isNotNull() for c in required},
        "accounts.churned": F.col("churned").isin(0, 1),
        "accounts.snapshot_uncertain": F.col("snapshot_uncertain").isin(0, 1),
        "accounts.mrr_usd_cents": F.col("mrr_usd_cents") >= 0,
    }
    checks = [
        _bad_values(invoices, invoice_rules()),
        _bad_values(accounts, account_rules),
        _repeated(raw_rows, "raw_records.source_row unique", "source_row"),
        _repeated(invoices, "invoices.invoice_id unique", "invoice_id"),
        _repeated(sources, "invoice_sources unique", "invoice_id", "source_row"),
        _repeated(accounts, "accounts.account_id unique", "account_id"),
        _repeated(quarantined, "quarantine.invoice_id unique", "invoice_id"),
        _orphans(sources, "invoice_sources.invoice_id known", invoices, "invoice_id"),
        _orphans(sources, "invoice_sources.source_row known", raw_rows, "source_row"),
        _orphans(
            accounts.select(F.col("snapshot_invoice_id").alias("invoice_id")),
            "accounts.snapshot_invoice_id known", invoices, "invoice_id",
        ),
    ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result


def violations_without_dedup(rows: DataFrame) -> DataFrame:
    """The invoice rules over all normalized rows: what publishing them undeduplicated would break."""
    return _bad_values(rows, invoice_rules()).unionByName(
        _repeated(rows, "invoices.invoice_id unique", "invoice_id")
    )
