"""Whole-number arithmetic on long columns, and values that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Quotient of longs, cut towards zero; stays exact where ``/`` would be a double."""
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def ceil_div(a: Column, b: int) -> Column:
    """Quotient of a non-negative long, rounded up."""
    return div(a + (b - 1), b)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
