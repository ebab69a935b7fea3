"""Readings of a date text: one explicit date, or up to two day/month orders."""

from functools import cache
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Year last or year first, with one repeated separator.
NUMERIC = r"^(?:\d{1,2}([-/])\d{1,2}\1\d{4}|\d{4}([-/])\d{1,2}\2(?:\d{1,2}| [1-9]))\z"
MONTH_NAME = r"(?U)^[A-Za-z]{3}\s+[0-9]{1,2}\s+[0-9]{4}\z"

# English month abbreviations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _date(year: Column, month: Column, day: Column) -> Column:
    """A DATE from three whole numbers, or NULL when they name no day; year 0 is none.

    The day is checked first: letting a cast fail costs an exception per row.
    """
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = (
        F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when(leap, 29).otherwise(28)
    )
    valid = (year > 0) & month.between(1, 12) & (day > 0) & (day <= last)
    return F.when(valid, F.make_date(year, month, day))


@cache
def reading_layers(prefix: str, text: str) -> list[dict[str, Column]]:
    """Layers that end in <prefix>_form, _dmy, _mdy and _explicit for one text column.

    ``form`` is the separator of a year-last text, 'Y' and the separator of a year-first one,
    'named' for a month name, else NULL. A layer only reads columns of the layers before it, so
    nothing is computed twice.
    """
    value, form = F.col(f"{prefix}_text"), F.col(f"{prefix}_form")
    a, b, c = (F.col(f"{prefix}_{name}") for name in "abc")
    words = F.split(value, r"(?U)\s+")
    named, numeric = form == "named", form.isNotNull()
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.get(words, 0)))

    def separator(mark: str) -> Column:
        year_first = F.instr(value, mark) == 5
        return F.when(year_first, F.lit("Y" + mark)).otherwise(F.lit(mark))

    def part(n: int) -> Column:
        """The n-th of three numbers; cut out by the plain separator, which builds no array."""

        def cut(mark: str) -> Column:
            head = value if n == 3 else F.substring_index(value, mark, n)
            return head if n == 1 else F.substring_index(head, mark, -1)

        return F.ltrim(F.when(F.endswith(form, F.lit("/")), cut("/")).otherwise(cut("-"))).cast("int")

    year_last, year_first = form.isin("-", "/"), form.isin("Y-", "Y/")
    return [
        {f"{prefix}_text": strip(F.col(text))},
        {
            f"{prefix}_form": F.when(
                value.rlike(NUMERIC),
                F.when(F.contains(value, F.lit("/")), separator("/")).otherwise(separator("-")),
            ).when(value.rlike(MONTH_NAME), F.lit("named"))
        },
        {
            f"{prefix}_a": F.when(named, month.cast("int")).when(numeric, part(1)),
            f"{prefix}_b": F.when(named, F.get(words, 1).cast("int")).when(numeric, part(2)),
            f"{prefix}_c": F.when(named, F.get(words, 2).cast("int")).when(numeric, part(3)),
        },
        {
            f"{prefix}_dmy": F.when(year_last, _date(c, b, a)),
            f"{prefix}_mdy": F.when(year_last, _date(c, a, b)),
            f"{prefix}_explicit": F.when(year_first, _date(a, b, c)).when(named, _date(c, a, b)),
        },
    ]


def apply_layers(df: DataFrame, *branches: list[dict[str, Column]]) -> DataFrame:
    """Add the n-th layers of all branches together: as few projections as the longest branch."""
    for layers in zip_longest(*branches, fillvalue={}):
        df = df.withColumns({name: column for layer in layers for name, column in layer.items()})
    return df
