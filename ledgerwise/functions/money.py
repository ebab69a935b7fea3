"""Exact numbers from text, of any length, and whole USD cents rounded half up.

A short number is cast at once. Any other is taken apart by ``parts``: ``sig``, its digits without zeros at either end, and
``scale``, the decimal places of the last of them, with the exponent folded in; no zeros are ever written out for an exponent.
From these come whole numbers, range checks and the canonical text, which equal numbers share: at most 28 significant digits
(half even), no exponent up to 60 decimal places, ``-0`` apart from ``0``.
"""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policies as P

MONEY = "decimal(30,12)"
PERCENT = "decimal(15,12)"
# Numbers of more digits are computed with 20 decimal places and a last one that is 1 where anything follows: that
# settles on which side of a half cent they lie.
_LONG_MONEY = "decimal(34,21)"
_LONG_PERCENT = "decimal(24,21)"
_FAR_EXPONENT = 10**15

# The accepted forms of an amount and of a plain number (underscores aside), and the digits kept.
AMOUNT_FORMAT = r"^[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?\z"
_DECIMAL_SYNTAX = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
_NOT_FINITE = r"(?i)^[+-]?(?:inf|infinity|s?nan\d*)\z"
SIGNIFICANT_DIGITS = 28
PLAIN_PLACES = 60

_FEW_DIGITS = r"^\d{1,9}(?:\.0*)?\z"
_FEW_PLACES = r"^\d{1,3}(?:\.\d{1,12})?\z"
_FEW_AMOUNT = r"^[+-]?[\d,]{1,16}(?:\.\d{1,12})?\z"


def constant(value: int, digits: int) -> Column:
    """A literal typed as tightly as possible, so that products keep all fraction digits."""
    return F.lit(Decimal(value)).cast(f"decimal({digits},0)")


def lookup(key: Column, table: dict, digits: int) -> Column:
    result = None
    for name, value in table.items():
        branch = constant(value, digits)
        result = F.when(key == name, branch) if result is None else result.when(key == name, branch)
    return result


def _cents(product: Column) -> Column:
    return F.round(product, 0).cast("bigint")


def few_places(text: Column) -> Column:
    """Whether a canonical text has at most 12 decimal places, told by its length."""
    return (F.length(text) <= 15) & ~F.contains(text, F.lit("E"))


def _twenty_places(text: Column, kind: str) -> Column:
    """A canonical text with more decimal places as DECIMAL: 20 of them, and 1 in the next where more follow."""
    places = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise(F.lit(""))
    rest = F.when(F.length(places) > 20, F.lit("1")).otherwise(F.lit("0"))
    plain = F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(F.left(places, F.lit(20)), 20, "0"), rest)
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    tiny = F.concat(sign, F.lit("0." + "0" * 20 + "1"))
    return F.when(F.contains(text, F.lit("E")), tiny).otherwise(plain).cast(kind)


def to_usd_cents(short: Column, long_text: Column, currency: Column) -> Column:
    """Cents of an amount given as a short number or else as canonical text."""
    rate = lookup(currency, P.USD_CENTS_PER_UNIT, 3)
    return F.when(long_text.isNull(), _cents(short * rate)).otherwise(_cents(_twenty_places(long_text, _LONG_MONEY) * rate))


def list_price_cents(plan: Column, seats: Column, discount_pct: Column, months: Column) -> Column:
    """price x seats x months x (100 - discount) is already in cents: the two factors 100 cancel."""
    full = (lookup(plan, P.PLAN_PRICE, 3) * seats.cast("decimal(10,0)") * months).cast("decimal(13,0)")
    hundred = constant(100, 3)
    short = full * (hundred - discount_pct.cast(PERCENT)).cast(PERCENT)
    long = full * (hundred - _twenty_places(discount_pct, _LONG_PERCENT)).cast(_LONG_PERCENT)
    return F.when(few_places(discount_pct), _cents(short)).otherwise(_cents(long))


def monthly_revenue_cents(plan: Column, seats: Column, discount_pct: Column, churned: Column) -> Column:
    price = list_price_cents(plan, seats, discount_pct, constant(1, 2))
    return F.when(churned == 1, F.lit(0).cast("bigint")).otherwise(price)


def revenue_cents(status: Column, cents: Column) -> Column:
    return F.when(status.isin(P.REVENUE_STATUSES), cents).otherwise(F.lit(0).cast("bigint"))


def long_number(text: Column, short: str) -> Column:
    """A number outside the short form, without underscores; NULL for a short one and for what is no number."""
    plain = F.translate(text, "_", "")
    return F.when(~text.rlike(short), F.when(plain.rlike(_DECIMAL_SYNTAX), plain))


def long_amount(digits: Column) -> Column:
    return F.when((F.length(digits) > 13) & ~digits.rlike(_FEW_AMOUNT) & digits.rlike(AMOUNT_FORMAT), F.translate(digits, ",", ""))


def _digits_and_places(long: Column) -> Column:
    """All digits written, and the decimal places of the last one."""
    mantissa = F.regexp_extract(long, r"^[+-]?([\d.]+)", 1)
    point = F.when(F.contains(mantissa, F.lit(".")), F.length(F.substring_index(mantissa, ".", -1))).otherwise(F.lit(0))
    written = F.regexp_extract(long, r"[eE]([+-]?\d+)\z", 1)
    far = F.when(F.startswith(written, F.lit("-")), F.lit(-_FAR_EXPONENT)).otherwise(F.lit(_FAR_EXPONENT))
    exponent = F.when(written == "", F.lit(0)).otherwise(
        F.greatest(F.lit(-_FAR_EXPONENT), F.least(F.lit(_FAR_EXPONENT), F.coalesce(written.try_cast("bigint"), far))))
    return F.struct(long.alias("long"), F.translate(mantissa, ".", "").alias("digits"), (point - exponent).alias("scale"))


def _without_zeros(x: Column) -> Column:
    sig = F.btrim(x.digits, F.lit("0"))
    scale = x.scale - F.length(x.digits) + F.length(F.rtrim(x.digits, F.lit("0")))
    return F.struct(x.long.alias("long"), sig.alias("sig"), F.when(sig == "", F.lit(0).cast("bigint")).otherwise(scale).alias("scale"))


def _rounded(x: Column) -> Column:
    """With the digits kept: at most 28, half even, without zeros at the end."""
    rest = F.when(F.length(x.sig) > SIGNIFICANT_DIGITS + 9, F.lit("1")).otherwise(F.lit("0"))
    number = F.concat(F.left(x.sig, F.lit(SIGNIFICANT_DIGITS)), F.lit("."), F.substring(x.sig, SIGNIFICANT_DIGITS + 1, 9), rest)
    rounded = F.bround(number.cast("decimal(38,10)"), 0).cast("decimal(29,0)").cast("string")
    kept = F.when(F.length(x.sig) <= SIGNIFICANT_DIGITS, x.sig).otherwise(F.rtrim(rounded, F.lit("0")))
    return F.struct(x.long.alias("long"), x.sig.alias("sig"), x.scale.alias("scale"), kept.alias("kept"))


def _with_text(x: Column) -> Column:
    """With the canonical text. The last kept digit has as many whole digits before it as before rounding, or one more."""
    carried = (x.kept == "1") & (F.length(x.sig) > SIGNIFICANT_DIGITS) & F.startswith(x.sig, F.lit("9"))
    places = F.length(x.kept) - F.length(x.sig) + x.scale - F.when(carried, 1).otherwise(0)
    size, few = F.length(x.kept), F.greatest(F.lit(0), F.least(places, F.lit(PLAIN_PLACES))).cast("int")
    sign = F.when(F.startswith(x.long, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    plain = (
        F.when(x.kept == "", F.lit("0"))
        .when(places <= 0, F.rpad(x.kept, F.least(size - places, F.lit(20)).cast("int"), F.lit("0")))
        .when(places < size, F.concat(F.left(x.kept, size - few), F.lit("."), F.right(x.kept, few)))
        .when(places <= PLAIN_PLACES, F.concat(F.lit("0."), F.lpad(x.kept, few, F.lit("0"))))
        .otherwise(F.concat(x.kept, F.lit("E-"), places.cast("string")))
    )
    return F.struct(x.sig.alias("sig"), x.scale.alias("scale"), x.kept.alias("kept"), F.concat(sign, plain).alias("text"))


def parts(longs: list[Column]) -> Column:
    """ARRAY of the parts of each long number, with its canonical text; NULL where no number is long.

    The steps are lambdas: they are interpreted, for the few rows that need them, and keep the generated code small.
    """
    steps = F.array(*longs)
    for step in (_digits_and_places, _without_zeros, _rounded, _with_text):
        steps = F.transform(steps, step)
    return F.when(F.coalesce(*longs).isNotNull(), steps)


def short_text(value: Column) -> Column:
    """The canonical text of a DECIMAL with decimal places; ``-0`` is unknown to DECIMAL."""
    return F.rtrim(F.rtrim(value.cast("string"), F.lit("0")), F.lit("."))


def beyond_range(sig: Column, scale: Column, kept: Column) -> Column:
    """Whether a long number's size exceeds the largest amount, a one with zeros."""
    whole_digits, most = F.length(sig) - scale, len(str(P.MAX_AMOUNT))
    return (sig != "") & ((whole_digits > most) | ((whole_digits == most) & (kept != "1")))


def number_error(text: Column, long: Column, sig: Column, scale: Column) -> Column:
    """Why a text outside the short form is no usable number, or NULL."""
    return F.when(
        long.isNull(), F.when(text.rlike(_NOT_FINITE), F.lit(P.ERR_DECIMAL_RANGE)).otherwise(F.lit(P.ERR_DECIMAL))
    ).when(beyond_range(sig, scale, sig), F.lit(P.ERR_DECIMAL_RANGE))


def whole_number(text: Column, long: Column, sig: Column, scale: Column) -> Column:
    """Stripped text to INT when its value is whole and fits, else NULL."""
    short = F.when(text.rlike(_FEW_DIGITS), F.substring_index(text, ".", 1).cast("int"))
    size = F.length(sig) - scale
    number = F.when(sig == "", F.lit(0).cast("bigint")).when(
        (scale <= 0) & (size <= 10), F.rpad(sig, F.least(size, F.lit(10)).cast("int"), F.lit("0")).cast("bigint"))
    fitting = F.when(number <= P.MAX_INTEGER, F.when(F.startswith(long, F.lit("-")), -number).otherwise(number))
    return F.when(long.isNull(), short).otherwise(fitting.cast("int"))


def whole_number_error(text: Column, value: Column, low: int, long: Column, sig: Column, scale: Column) -> Column:
    """Why a whole number is unusable, or NULL. ``value`` is ``whole_number`` of the same."""
    reason = F.when(text.rlike(_FEW_DIGITS), F.lit(P.ERR_INTEGER)).otherwise(
        F.coalesce(number_error(text, long, sig, scale), F.lit(P.ERR_INTEGER)))
    return F.when(value.isNull() | (value < low), reason)


def long_integer(text: Column) -> Column:
    return long_number(text, _FEW_DIGITS)


def long_percentage(text: Column) -> Column:
    return long_number(text, _FEW_PLACES)


def short_percentage(text: Column) -> Column:
    """Stripped text of the short form to DECIMAL(15,12)."""
    return F.when(text.rlike(_FEW_PLACES), text.try_cast(PERCENT))


def percentage_error(text: Column, short: Column, long: Column, sig: Column, scale: Column) -> Column:
    """Why a percentage is unusable, or NULL. ``short`` is ``short_percentage`` of the same."""
    whole_digits = F.length(sig) - scale
    inside = (sig == "") | (
        ~F.startswith(long, F.lit("-")) & ((whole_digits < 3) | ((whole_digits == 3) & (sig == "1"))))
    return F.when(short.isNotNull(), F.when(short > 100, F.lit(P.ERR_DISCOUNT))).otherwise(
        F.coalesce(number_error(text, long, sig, scale), F.when(~inside, F.lit(P.ERR_DISCOUNT))))


def local_amount(digits: Column) -> Column:
    """Amount text of the short form to DECIMAL; NULL when its format is wrong."""
    return F.when(digits.rlike(AMOUNT_FORMAT), F.translate(digits, ",", "").try_cast(MONEY))


def amount_error(currency: Column, code: Column, digits: Column, in_range: Column) -> Column:
    """Why the amount text is unusable, or NULL.

    ``code`` is the three-letter suffix (NULL without one), ``digits`` the text left after the suffix and one leading own symbol
    are cut, ``in_range`` whether its value is within bounds (NULL without a value).
    """
    return (
        F.when(~currency.isin(list(P.USD_CENTS_PER_UNIT)), F.lit(P.ERR_CURRENCY))
        .when(code != currency, F.lit(P.ERR_CURRENCY_CODE))
        .when(
            in_range.isNull(),
            F.when(digits.rlike("[$€£]"), F.lit(P.ERR_SYMBOL)).otherwise(F.lit(P.ERR_AMOUNT_FORMAT)),
        )
        .when(~in_range, F.lit(P.ERR_DECIMAL_RANGE))
    )
