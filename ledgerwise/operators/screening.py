"""Question screening: one flag per rule over a table of prompt texts."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .. import policies as P
from ..functions.text import SPACE_CLASS, strip


@pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility form. ASCII text is its own, so only other texts go through Python."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_nfkc(other), text)


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def screen(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Add one 0/1 flag per rule and ``admitted``; whole texts are searched."""
    raw = F.col(text)
    bad_length = (strip(raw) == "") | (F.char_length(raw) > P.MAX_QUESTION_CHARS)
    control = raw.rlike(r"[\p{C}&&[^\n\t]]")
    df = prompts.withColumn("_flat", collapse_whitespace(nfkc(raw)))
    flags = {
        "bad_length": F.coalesce(bad_length, F.lit(True)),
        "control_chars": F.coalesce(control, F.lit(False)),
        **{
            name: F.coalesce(F.col("_flat").rlike(f"(?iU){pattern}"), F.lit(False))
            for name, pattern in P.SCREENING_PATTERNS.items()
        },
    }
    df = df.withColumns({name: flag.cast("int") for name, flag in flags.items()}).drop("_flat")
    return df.withColumn("admitted", (F.greatest(*flags) == 0).cast("int"))
