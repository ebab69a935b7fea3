"""All tables of one ledger, built from its raw records on demand."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policies as P
from ..functions.text import strip
from ..operators import accounts as A
from ..operators import dedup as D
from ..operators import quality as Q
from ..operators.date_resolution import format_evidence
from ..operators.normalize import normalize
from ..session import stage

Save = Callable[[str, DataFrame], DataFrame]


def keep_lazy(label: str, df: DataFrame) -> DataFrame:
    return df


def stage_shared(label: str, df: DataFrame) -> DataFrame:
    """Materialize the two frames that several tables are built from."""
    return stage(df, label) if label in ("normalized", "groups") else df


class Ledger:
    """``save`` is called with every table and may return a written copy to go on from.

    The default leaves everything lazy, which suits a question that needs one branch; a question
    that needs several passes ``stage_shared``, and publishing writes every table.
    """

    def __init__(
        self,
        raw: DataFrame,
        as_of: str | None = None,
        save: Save = keep_lazy,
        source_sha256: Column | None = None,
    ):
        self._raw, self.as_of, self.save, self._sha256 = raw, as_of, save, source_sha256

    @cached_property
    def raw(self) -> DataFrame:
        # The id as grouped stands beside the record as written.
        return self.save("raw_records", self._raw.withColumn("record_id", F.coalesce(strip(F.col("invoice_id")), F.lit(""))))

    @cached_property
    def rows(self) -> DataFrame:
        return self.save("normalized", normalize(self.raw, format_evidence(self.raw)))

    @cached_property
    def groups(self) -> DataFrame:
        return self.save("groups", D.invoice_groups(self.rows))

    @cached_property
    def invoices(self) -> DataFrame:
        # Sorted files let status and period filters skip row groups.
        ordered = D.accepted_invoices(self.groups)
        if self.save is not keep_lazy:
            ordered = ordered.sortWithinPartitions("status", "invoice_date")
        return self.save("invoices", ordered)

    @cached_property
    def verdicts(self) -> DataFrame:
        """Every record with the verdict on its group."""
        thin = self.rows.select("invoice_group", "invoice_id", "source_row", "account_id", "errors")
        return self.save("record_verdicts", D.rows_with_verdict(thin, self.groups))

    @cached_property
    def sources(self) -> DataFrame:
        return self.save("invoice_sources", D.invoice_sources(self.verdicts))

    @cached_property
    def quarantine(self) -> DataFrame:
        return self.save("quarantine", D.quarantine(self.groups))

    @cached_property
    def quarantine_rows(self) -> DataFrame:
        return self.save("quarantine_rows", D.quarantine_rows(self.verdicts))

    @cached_property
    def snapshots(self) -> DataFrame:
        """Accounts without uncertainty marks: needs the accepted invoices only."""
        return A.account_snapshots(self.invoices, self.as_of)

    @cached_property
    def marked(self) -> DataFrame:
        excluded = D.excluded_accounts(self.quarantine_rows)
        return self.save("account_marks", A.mark_uncertainty(self.snapshots, excluded))

    @cached_property
    def accounts(self) -> DataFrame:
        return self.save("accounts", A.accounts_table(self.marked))

    @cached_property
    def issues(self) -> DataFrame:
        return self.save("quality_issues", Q.issue_log(self.rows, A.account_issues(self.marked)))

    @cached_property
    def coverage(self) -> DataFrame:
        return Q.coverage_report(self.groups, self.as_of)

    @cached_property
    def report(self) -> DataFrame:
        warnings = Q.warning_counts(self.issues)
        return self.save("report", Q.full_report(self.coverage, warnings, self._sha256))

    def violations(self) -> DataFrame:
        return Q.constraint_violations(
            self.raw, self.invoices, self.sources, self.accounts, self.quarantine
        )

    def curated(self) -> dict[str, DataFrame]:
        """The two tables that questions may read; contact addresses and raw records stay out."""
        return {
            "invoices": self.invoices.select(*P.CURATED_INVOICE_COLUMNS),
            "accounts": self.accounts.select(*P.CURATED_ACCOUNT_COLUMNS),
        }
