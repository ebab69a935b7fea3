"""Compare an answer with an independently expected one: column names and ordered rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_rows(case: str, actual: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """One row (case, passed, answer) for two answers whose rows are identified by ``key``.

    A key holds the rank for ordered answers. Rows are matched by a full join on the key; NULLs
    compare equal. ``answer`` is the actual rows as text in the order of the key: it is for answers
    of a few rows, as all compared ones are.
    """
    if actual.columns != expected.columns:
        spark = actual.sparkSession
        unknown = F.lit(None).cast("string").alias("answer")
        return spark.range(1).select(F.lit(case).alias("case"), F.lit(0).alias("passed"), unknown)
    left = actual.select(F.struct(*actual.columns).alias("l"), *key)
    right = expected.select(F.struct(*expected.columns).alias("r"), *key)
    joined = left.join(right, key, "full_outer")
    same = F.coalesce(F.col("l").eqNullSafe(F.col("r")) & F.col("l").isNotNull(), F.lit(False))
    cells = [F.coalesce(F.col(f"l.{c}").cast("string"), F.lit("NULL")) for c in actual.columns]
    line = F.struct(*[F.col(f"l.{k}") for k in key], F.concat_ws("|", *cells).alias("line"))
    lines = F.array_sort(F.collect_list(F.when(F.col("l").isNotNull(), line)))
    return joined.agg(
        F.lit(case).alias("case"), F.coalesce(F.bool_and(same), F.lit(True)).cast("int").alias("passed"),
        F.array_join(F.transform(lines, lambda x: x["line"]), ";").alias("answer"),
    )
