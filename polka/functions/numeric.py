"""Number parsing and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PRICE = 10_000_000.0
#: What the strict parser takes as a number; ``try_cast`` alone also takes ``1d`` or ``inf``.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def number_text(x: Column, shape: str) -> Column:
    """A number in a decimal shape such as ``0.00``, rounded half-even from its exact binary value."""
    return F.call_function("format_number", x, F.lit(shape))


def exact_round(x: Column, places: int) -> Column:
    """Half-even rounding of the exact binary value, NULL for NaN and infinities."""
    shape = "0" if places == 0 else "0." + "0" * places
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return number_text(finite, shape).cast("double") + F.lit(0.0)


def strict_double(text: Column) -> Column:
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def localized_text(text: Column) -> Column:
    """White space of any kind is dropped; of comma and point the later one is the decimal mark."""
    t = F.regexp_replace(text, r"(?U)\s+", "")
    t = F.regexp_replace(t, r"\.(?=.*,[^.]*$)", "")  # the last mark is a comma: points group
    t = F.regexp_replace(t, r",(?=.*\.[^,]*$)", "")  # the last mark is a point: commas group
    return F.nullif(F.translate(t, ",", "."), F.lit(""))


def localized_number(text: Column) -> Column:
    return strict_double(localized_text(text))


def positive_price(x: Column) -> Column:
    """A price usable in metrics: finite, above zero, at most ten million; else NULL."""
    return F.when((x > 0) & (x <= MAX_PRICE), x)


def positive_price_text(text: Column) -> Column:
    return positive_price(strict_double(F.replace(F.trim(text), F.lit(","), F.lit("."))))
