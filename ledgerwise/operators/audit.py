"""Row-level provenance of invoices: raw records, exclusion reason, errors and issues."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policies import LEDGER_COLUMNS
from .dedup import rows_with_verdict


def invoice_audit(
    rows: DataFrame, groups: DataFrame, raw: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """One row per finding of the wanted invoices: each record, each of its errors and issues.

    A record's detail is all of its raw columns as JSON, an issue's all of its fields; every row has the
    revenue bounds of its group. ``ids`` has an ``invoice_id`` column and may hold any number of ids; without
    it all excluded groups are audited. A blank id stands for every record without one.
    """
    if ids is None:
        groups = groups.filter(~F.col("accepted"))
    else:
        wanted = ids.select(F.col("invoice_id").alias("wanted")).distinct()
        missing = F.startswith(F.col("invoice_group"), F.lit("__missing_row_"))
        named = F.when(missing, F.lit("")).otherwise(F.col("invoice_group"))
        groups = groups.withColumn("wanted", named).join(wanted, "wanted", "left_semi")
    judged = rows_with_verdict(rows.select("invoice_group", "source_row", "errors", "issues"), groups)
    texts = raw.select("source_row", F.to_json(F.struct(*LEDGER_COLUMNS)).alias("record"))
    whole = {"ignoreNullFields": "false"}
    findings = F.concat(
        F.array(F.struct(F.lit("record").alias("kind"), F.col("record").alias("detail"))),
        F.transform("errors", lambda e: F.struct(F.lit("error").alias("kind"), e.alias("detail"))),
        F.transform("issues", lambda i: F.struct(F.lit("issue").alias("kind"), F.to_json(i, whole).alias("detail"))),
    )
    return judged.join(texts, "source_row").select(
        F.col("invoice_group").alias("invoice_id"), "source_row", "reason", "min_cents", "max_cents", F.inline_outer(findings)
    )
