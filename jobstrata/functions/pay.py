"""Salary values: from text, from vendor structures and from arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.functions.text import SPACE, WIDE, plain_spaces, strip

# --- Fixed values: the pay range pattern ---------------------------------------
_CURRENCY = r"(\$|usd|eur|€|gbp|£)?"
_AMOUNT = r"(\d{2,3}(?:[,\.]\d{3})?)"
_DASH = "(?:-|–|—|to)"
PAY_RANGE = (
    f"(?i){_CURRENCY}[{SPACE}]*{_AMOUNT}[{SPACE}]*(k)?[{SPACE}]*{_DASH}[{SPACE}]*"
    f"{_CURRENCY}[{SPACE}]*{_AMOUNT}[{SPACE}]*(k)?"
)


def no_pay() -> Column:
    return F.lit(None).cast("struct<min:int,max:int,currency:string>")


def pay(low: Column, high: Column, currency: Column) -> Column:
    return F.struct(
        low.cast("int").alias("min"),
        high.cast("int").alias("max"),
        currency.cast("string").alias("currency"),
    )


def _currency_code(symbol: Column) -> Column:
    code = F.lit(None).cast("string")
    for text, name in C.CURRENCY_CODES.items():
        code = F.when(symbol == text, F.lit(name)).otherwise(code)
    return code


def _read_range(found: Column) -> Column:
    def part(group: int) -> Column:
        return F.regexp_extract(found, PAY_RANGE, group)

    def amount(number: int, thousands: int) -> Column:
        value = F.replace(part(number), F.lit(","), F.lit("")).try_cast("double")
        return (value * F.when(part(thousands) != "", 1000).otherwise(1)).try_cast("int")

    symbol = F.lower(F.when(part(1) != "", part(1)).otherwise(part(4)))
    return pay(amount(2, 3), amount(5, 6), _currency_code(symbol))


def pay_from_text(text: Column) -> Column:
    """The first stated and plausible range as a struct, else null. Nothing is inferred."""
    # Any range has two digits, blanks or a 'k' at most, and a dash word: a cheap first test, on the text as it is.
    blank = SPACE + WIDE
    worth_reading = text.rlike(rf"(?i)\d[k{blank}]*{_DASH}[{blank}]*(?:\$|usd|eur|€|gbp|£)?[{blank}]*\d")
    found = F.when(worth_reading, F.regexp_extract_all(plain_spaces(text), F.lit(PAY_RANGE), F.lit(0)))
    plausible = F.filter(
        F.transform(found, _read_range),
        lambda r: (r["max"] >= r["min"])
        & (r["max"] >= C.PAY_FLOOR)
        & (r["max"] <= C.PAY_CEILING),
    )
    return F.get(plausible, F.lit(0))


def json_int(value: Column) -> Column:
    """A variant as an int: numbers are truncated, text must be a whole number."""
    kind = F.schema_of_variant(value)
    text = strip(F.try_variant_get(value, "$", "string"))
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "STRING", whole.try_cast("int"))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
        .otherwise(number.try_cast("int"))
    )


def json_pay(low: Column, high: Column, currency: Column) -> Column:
    """Two variant bounds as pay; one unreadable bound voids both, never the currency."""

    def read(bound: Column) -> tuple[Column, Column]:
        stated = bound.isNotNull() & ~F.coalesce(F.is_variant_null(bound), F.lit(True))
        value = F.when(stated, json_int(bound))
        return value, ~stated | value.isNotNull()

    (low_value, low_ok), (high_value, high_ok) = read(low), read(high)
    both = low_ok & high_ok
    return pay(F.when(both, low_value), F.when(both, high_value), currency)


_UNITS = {"w": 10_000, "万": 10_000, "k": 1_000, "m": 1_000_000}


def parse_salary_argument(value: Column) -> Column:
    """'600000', '60w', '60万', '600k', '1.5m' as a number; null when unreadable."""
    text = F.translate(F.lower(strip(value)), ",，", "")
    shape = r"^(\d+(?:\.\d+)?)[\t-\r\x1c-\x20]*(w|万|k|m)?$"
    factor = F.lit(1)
    for unit, size in _UNITS.items():
        factor = F.when(F.regexp_extract(text, shape, 2) == unit, size).otherwise(factor)
    number = F.when(text.rlike(shape), F.regexp_extract(text, shape, 1)).try_cast("double")
    return (number * factor).try_cast("bigint")
