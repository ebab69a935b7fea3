"""The registered queries: every operator, over whole tables, from the given Parquet files."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import policies as P
from ..functions.text import decimal_text
from ..operators import accounts as A
from ..operators import audit, dedup, history, quality, screening, serving
from ..operators.answers import same_rows
from ..operators.date_resolution import evidence_table
from ..operators.normalize import row_errors, row_issues
from ..session import new_folder, prepare, stage
from ..sources import ledger_csv
from ..sources.tables import derived_ledger, derived_prompts, table
from . import metrics as M
from .ledger import Ledger, stage_shared
from .publish import PUBLISHED, current_run, digest_of, publish, read_published

AS_OF = "1998-06-30"
PERIOD = ("1997-01-01", "1998-01-01")

Query = Callable[[SparkSession, str], DataFrame]


def _lazy(spark: SparkSession, folder: str, as_of: str | None = None) -> Ledger:
    return Ledger(derived_ledger(prepare(spark), folder), as_of)


def _staged(spark: SparkSession, folder: str, as_of: str | None = None) -> Ledger:
    return Ledger(derived_ledger(prepare(spark), folder), as_of, stage_shared)


def _texts(df: DataFrame) -> DataFrame:
    """Decimals as canonical text, so that engines with other scales compare equal."""
    names = [f.name for f in df.schema if f.dataType.typeName() == "decimal"]
    return df.withColumns({n: decimal_text(F.col(n)) for n in names}) if names else df


def raw_records(spark, folder):
    """The raw table, written and read back."""
    ledger = Ledger(derived_ledger(prepare(spark), folder), save=lambda label, df: stage(df, label))
    return ledger.raw.withColumn("invoice_id", F.col("record_id")).drop("record_id")


def money_cents(spark, folder):
    return _lazy(spark, folder).rows.select("source_row", "amount_usd_cents")


def row_error_log(spark, folder):
    return row_errors(_lazy(spark, folder).rows).select("source_row", "error")


def canonical_categories(spark, folder):
    return _lazy(spark, folder).rows.select(
        "source_row", "region", "plan", "billing_cycle", "status", "payment_method"
    )


def normalized_terms(spark, folder):
    return _texts(
        _lazy(spark, folder).rows.select(
            "source_row", "seats", "discount_pct", "csat_score", "support_tickets", "churned",
            "contact_email", "industry",
        )
    )


def date_evidence(spark, folder):
    found = evidence_table(derived_ledger(prepare(spark), folder))
    return found.withColumn("orders", F.array_join(F.array_sort("orders"), ","))


def dates_resolved(spark, folder):
    return _lazy(spark, folder).rows.select("source_row", "signup_date", "invoice_date")


def price_mismatch(spark, folder):
    issues = row_issues(_lazy(spark, folder).rows)
    return issues.filter(F.col("code") == "price_fx_mismatch").select("source_row", "difference_usd_cents")


def issue_log(spark, folder):
    shown = F.array_join(F.transform("candidates", lambda d: d.cast("string")), ",")
    return _staged(spark, folder).issues.select(
        "source_row", "invoice_id", "code", "field", "raw", "evidence", shown.alias("candidates"), "difference_usd_cents"
    )


def warning_counts(spark, folder):
    return quality.warning_counts(_staged(spark, folder).issues)


def accepted_invoices(spark, folder):
    return _texts(_lazy(spark, folder).invoices)


def invoice_sources(spark, folder):
    return _staged(spark, folder).sources


def quarantine_groups(spark, folder):
    return _lazy(spark, folder).quarantine.withColumnsRenamed({
        "alternative_net_revenue_min_cents": "min_cents",
        "alternative_net_revenue_max_cents": "max_cents",
    })


def quarantine_rows(spark, folder):
    rows = _staged(spark, folder).quarantine_rows
    return rows.withColumn("errors", F.array_join(F.array_sort("errors"), "; "))


def _accounts(df: DataFrame) -> DataFrame:
    return _texts(df.withColumn("changed_fields", F.array_join(F.array_sort("changed_fields"), ",")))


def account_snapshots(spark, folder):
    return _texts(_staged(spark, folder).accounts)


def account_snapshots_asof(spark, folder):
    return _texts(_staged(spark, folder, AS_OF).accounts)


def account_snapshot_history(spark, folder):
    """The snapshots of all accounts at every month's end, from one pass over the invoices."""
    invoices = _staged(spark, folder).invoices
    history = A.snapshots_at(A.snapshot_intervals(invoices), A.month_ends(invoices))
    return _accounts(history.withColumn("tie", F.col("latest_date_tie").cast("int")).drop("latest_date_tie"))


def account_uncertainty(spark, folder):
    marked = _staged(spark, folder).marked
    return _accounts(marked).select(
        "account_id",
        "changed_fields",
        F.col("latest_date_tie").cast("int").alias("tie"),
        F.col("quarantined_history").cast("int").alias("quarantined"),
        "snapshot_uncertain",
    )


def coverage_report(spark, folder):
    return _lazy(spark, folder).coverage


def coverage_report_asof(spark, folder):
    return _lazy(spark, folder, AS_OF).coverage


def paid_revenue_period(spark, folder):
    return M.paid_revenue(_lazy(spark, folder).invoices, *PERIOD)


def paid_revenue_by_year(spark, folder):
    return M.paid_revenue_by_year(_lazy(spark, folder).invoices)


def refunds_and_net(spark, folder):
    return M.refunds_and_net(_lazy(spark, folder).invoices)


def open_exposure(spark, folder):
    return M.open_exposure(_lazy(spark, folder).invoices)


def local_currency_totals(spark, folder):
    return _texts(M.local_currency_totals(_lazy(spark, folder).invoices))


def region_mean_mrr(spark, folder):
    return M.mean_mrr(_lazy(spark, folder).snapshots)


def top_region(spark, folder):
    return M.top_region(_lazy(spark, folder).snapshots)


def segment_mean_mrr(spark, folder):
    return M.segment_mean_mrr(_lazy(spark, folder).snapshots, "EMEA")


def plan_snapshot_churn(spark, folder):
    return M.plan_churn(_lazy(spark, folder).snapshots)


def plan_snapshot_churn_asof(spark, folder):
    return M.plan_churn(_lazy(spark, folder, AS_OF).snapshots)


def top_accounts(spark, folder):
    return M.top_accounts(_lazy(spark, folder).snapshots)


def account_ranking(spark, folder):
    return M.account_ranking(_lazy(spark, folder).snapshots)


def period_revenue_by_region(spark, folder):
    ledger = _staged(spark, folder)
    return M.period_revenue(ledger.invoices, ledger.snapshots)


def invoice_audit(spark, folder):
    ledger = _staged(spark, folder)
    return audit.invoice_audit(ledger.rows, ledger.groups, ledger.raw)


def invoice_audit_ids(spark, folder):
    """The accepted invoices of the top accounts, back to their records."""
    ledger = _staged(spark, folder)
    wanted = ledger.invoices.join(M.top_accounts(ledger.snapshots), "account_id", "left_semi")
    return audit.invoice_audit(ledger.rows, ledger.groups, ledger.raw, wanted)


def constraint_violations(spark, folder):
    return _staged(spark, folder).violations()


def violations_without_dedup(spark, folder):
    return quality.violations_without_dedup(_staged(spark, folder).rows)


def _published(spark: SparkSession, folder: str) -> str:
    target = new_folder(spark, "published")
    publish(spark, derived_ledger(prepare(spark), folder), target)
    return target


def _ask_curated(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Publish the ledger and put a question through the curated boundary in its own session."""
    run = current_run(spark, _published(spark, folder))
    session = serving.isolated_session(spark, {name: f"{run}/{name}" for name in ("invoices", "accounts")})
    return _texts(serving.curated_query(session, sql))


def curated_invoices(spark, folder):
    return _ask_curated(spark, folder, "SELECT * FROM invoices")


def curated_accounts(spark, folder):
    return _ask_curated(spark, folder, "SELECT * FROM accounts")


def answer_with_coverage(spark, folder):
    ledger = _staged(spark, folder)
    evidence = ledger.coverage.select(
        "as_of", "accepted_invoices", "modeled_accounts", "quarantined_invoice_groups"
    )
    return serving.with_coverage(M.mean_mrr(ledger.snapshots), evidence)


def capped_answer(spark, folder):
    """An answer under the ceiling on rows, with the six coverage fields on each row."""
    ledger = _staged(spark, folder)
    evidence = quality.coverage_evidence(ledger.report)
    shown = serving.with_coverage(serving.capped(M.mean_mrr(ledger.snapshots, "plan")), evidence)
    counts = F.transform(F.array_sort(F.map_entries("coverage_warning_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return shown.withColumns({
        "coverage_warning_counts": F.array_join(counts, ","),
        "coverage_provisional_policies": F.array_join("coverage_provisional_policies", " "),
    })


def display_accounts(spark, folder):
    shown = M.account_ranking(_lazy(spark, folder).snapshots).select(
        "account_id",
        (F.col("net_cents") / 100).cast("decimal(20,2)").alias("net_revenue_usd"),
        F.col("net_cents").alias("net_revenue_usd_cents"),
        "csat_flag",
    )
    return serving.display(shown)


def answer_regression(spark, folder):
    """Each metric function against the same question asked in SQL over the curated tables."""
    ledger = _staged(spark, folder)
    inv, acc = ledger.invoices, ledger.snapshots
    start, end = PERIOD

    def ranked(df: DataFrame, *order) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))

    def ask(sql: str) -> DataFrame:
        return spark.sql(sql, invoices=inv, accounts=acc)

    one = F.lit(1).alias("one")
    mean = "(2 * sum(mrr_usd_cents) + count(*)) div (2 * count(*))"
    cases = [
        same_rows(
            "paid_revenue",
            M.paid_revenue(inv, start, end).select("*", one),
            ask(
                "SELECT coalesce(sum(amount_usd_cents), 0) AS paid_cents, 1 AS one FROM {invoices} "
                f"WHERE status = 'paid' AND invoice_date >= '{start}' AND invoice_date < '{end}'"
            ),
            ["one"],
        ),
        same_rows(
            "refunds_and_net",
            M.refunds_and_net(inv).select("*", one),
            ask(
                "SELECT coalesce(-sum(amount_usd_cents) FILTER (WHERE status = 'refunded'), 0) AS refunds_cents, "
                "coalesce(sum(amount_usd_cents) FILTER (WHERE status IN ('paid', 'refunded')), 0) AS net_cents, "
                "1 AS one FROM {invoices}"
            ),
            ["one"],
        ),
        same_rows(
            "open_exposure",
            M.open_exposure(inv).select("*", one),
            ask(
                "SELECT count(*) AS invoices, coalesce(sum(amount_usd_cents), 0) AS exposure_cents, 1 AS one "
                "FROM {invoices} WHERE status IN ('pending', 'failed')"
            ),
            ["one"],
        ),
        same_rows(
            "top_region",
            M.top_region(acc),
            ask(
                f"SELECT region, {mean} AS mean_mrr_cents, count(*) AS accounts FROM {{accounts}} "
                "GROUP BY region ORDER BY avg(mrr_usd_cents) DESC, region LIMIT 1"
            ),
            ["region"],
        ),
        same_rows(
            "plan_churn",
            M.plan_churn(acc).select("plan", "churned_accounts", "accounts"),
            ask(
                "SELECT plan, sum(churned) AS churned_accounts, count(*) AS accounts FROM {accounts} GROUP BY plan"
            ),
            ["plan"],
        ),
        same_rows(
            "top_accounts",
            ranked(M.top_accounts(acc), F.desc("net_cents"), "account_id"),
            ask(
                "SELECT *, row_number() OVER (ORDER BY net_cents DESC, account_id) AS rank FROM ("
                "SELECT account_id, account_name, net_revenue_usd_cents AS net_cents, "
                "CASE WHEN csat_score IS NULL THEN 'unknown' WHEN csat_score <= 2 THEN 'low' "
                "ELSE 'not_low' END AS csat_flag FROM {accounts} "
                "ORDER BY net_revenue_usd_cents DESC, account_id LIMIT 5)"
            ),
            ["rank"],
        ),
    ]
    result = cases[0]
    for case in cases[1:]:
        result = result.unionByName(case)
    return result


def ledger_csv_rows(spark, folder):
    """Write the whole ledger as CSV in source order, some fields over several lines, read it back, and number its records."""
    raw = derived_ledger(prepare(spark), folder)
    several_lines = F.concat(F.lit('said "a",\n\n'), F.col("status"))
    raw = raw.withColumn("status", F.when(F.col("source_row") % 29 == 0, several_lines).otherwise(F.col("status")))
    path = new_folder(spark, "csv")
    ledger_csv.write_ledger(raw.orderBy("source_row"), path)
    return ledger_csv.read_ledger(spark, path).select(
        "source_row", "invoice_id", "account_id", "amount", "status", "invoice_date"
    )


# The columns a digest covers, where it is not all: those of nested type are left to the manifest.
DIGESTED = {
    "raw_records": None, "invoices": None, "accounts": None, "invoice_sources": None, "quarantine": None,
    "record_verdicts": ["invoice_group", "invoice_id", "source_row", "account_id", "n_rows", "accepted", "reason", "min_cents", "max_cents"],
    "quarantine_rows": ["invoice_id", "source_row", "account_id", "reason"],
}


def published_tables(spark, folder):
    """Publish the ledger and read the current run back; per table its rows, a sum and a digest of the content."""
    tables = read_published(spark, _published(spark, folder))
    summed = {
        "raw_records": "source_row", "normalized": "amount_usd_cents", "groups": "n_rows", "invoices": "amount_usd_cents",
        "record_verdicts": "source_row", "invoice_sources": "source_row",
        "quarantine": "alternative_net_revenue_max_cents", "quarantine_rows": "source_row",
        "account_marks": "mrr_usd_cents", "accounts": "net_revenue_usd_cents", "quality_issues": "source_row",
        "report": "accepted_subtotal_cents",
    }
    counts = []
    for name in PUBLISHED:
        digest = digest_of(tables[name], DIGESTED[name]) if name in DIGESTED else F.lit(None).cast("string").alias("digest")
        counts.append(tables[name].agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.sum(summed[name]).cast("bigint").alias("content"), digest))
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


def screened_turns(spark, folder):
    return screening.screen(derived_prompts(spark, folder)).drop("text", "role")


def bounded_history(spark, folder):
    return history.bounded_history(table(spark, folder, "conversations"))


QUERIES: dict[str, Query] = {
    "raw_records": raw_records,
    "money_cents": money_cents,
    "row_errors": row_error_log,
    "canonical_categories": canonical_categories,
    "normalized_terms": normalized_terms,
    "date_evidence": date_evidence,
    "dates_resolved": dates_resolved,
    "price_mismatch": price_mismatch,
    "issue_log": issue_log,
    "warning_counts": warning_counts,
    "accepted_invoices": accepted_invoices,
    "invoice_sources": invoice_sources,
    "quarantine_groups": quarantine_groups,
    "quarantine_rows": quarantine_rows,
    "account_snapshots": account_snapshots,
    "account_snapshots_asof": account_snapshots_asof,
    "account_snapshot_history": account_snapshot_history,
    "account_uncertainty": account_uncertainty,
    "coverage_report": coverage_report,
    "coverage_report_asof": coverage_report_asof,
    "paid_revenue_period": paid_revenue_period,
    "paid_revenue_by_year": paid_revenue_by_year,
    "refunds_and_net": refunds_and_net,
    "open_exposure": open_exposure,
    "local_currency_totals": local_currency_totals,
    "region_mean_mrr": region_mean_mrr,
    "top_region": top_region,
    "segment_mean_mrr": segment_mean_mrr,
    "plan_snapshot_churn": plan_snapshot_churn,
    "plan_snapshot_churn_asof": plan_snapshot_churn_asof,
    "top_accounts": top_accounts,
    "account_ranking": account_ranking,
    "period_revenue_by_region": period_revenue_by_region,
    "invoice_audit": invoice_audit,
    "invoice_audit_ids": invoice_audit_ids,
    "constraint_violations": constraint_violations,
    "violations_without_dedup": violations_without_dedup,
    "curated_invoices": curated_invoices,
    "curated_accounts": curated_accounts,
    "answer_with_coverage": answer_with_coverage,
    "capped_answer": capped_answer,
    "display_accounts": display_accounts,
    "answer_regression": answer_regression,
    "ledger_csv_rows": ledger_csv_rows,
    "published_tables": published_tables,
    "screened_turns": screened_turns,
    "bounded_history": bounded_history,
}
