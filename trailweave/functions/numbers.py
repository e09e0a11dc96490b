"""Numbers as the street model rounds and parses them; SQL NULL where a value is not there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Nearest multiple of ``10 ** -digits``, halves towards plus infinity (also below zero)."""
    scale = float(10**digits)
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def leading_int(text: Column) -> Column:
    """The integer a text begins with, else null ("2;3" is 2)."""
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def share(part: Column, whole: Column) -> Column:
    """``part / whole``; 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def at_fraction(sorted_values: Column, p: float) -> Column:
    """Of an ascending array the element at ``floor(n * p)``, the last one at most; null if empty."""
    n = F.size(sorted_values)
    place = F.least(F.floor(n * F.lit(p)).cast("int"), n - 1)
    return F.when(n > 0, F.get(sorted_values, place))


def order_place(n: Column, p: float) -> Column:
    """The place ``floor(n * p)``, from 0, of an order statistic among ``n`` values, the last one at most."""
    return F.least(F.floor(n * F.lit(p)), n - 1)
