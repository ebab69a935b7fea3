"""Text cleaning columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters, including the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


ASCII_WHITESPACE = WHITESPACE[:10]
# The same characters inside a pattern.
SPACE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)


def strip(text: Column) -> Column:
    """Cut white space of any kind at both ends; plain ``trim`` only cuts spaces.

    The trim searches the whole set for both end characters, so ASCII texts use the short set.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.trim(text, F.lit(ASCII_WHITESPACE))).otherwise(F.trim(text, F.lit(WHITESPACE)))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def alias_key(text: Column) -> Column:
    return F.lower(strip(text))


def canonical(key: Column, aliases: dict) -> Column:
    """Map an ``alias_key`` to its canonical value; NULL when unknown."""
    result = None
    for value, spellings in aliases.items():
        hit = key.isin(spellings)
        result = F.when(hit, F.lit(value)) if result is None else result.when(hit, F.lit(value))
    return result


def collect_where(entries: list[tuple[Column, Column]], element_type: str) -> Column:
    """ARRAY of the values whose condition holds, in the given order.

    Built by ``concat``, which is compiled; ``array_compact`` is a lambda and would pull all its
    inputs out of generated code.
    """
    empty = F.array().cast(f"array<{element_type}>")
    return F.concat(*[F.when(held, F.array(value)).otherwise(empty) for held, value in entries])


def decimal_text(number: Column) -> Column:
    """Shortest plain text of a decimal: no exponent, no trailing zeros."""
    return F.regexp_replace(number.cast("string"), r"\.?0+$", "")
