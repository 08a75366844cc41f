"""Vector columns: arrays of numbers, summed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, left to right in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(ZERO), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` refers to it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scaled(a: Column | str, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(a, lambda x: x.cast("double") * f))


def normalised(a: Column | str, floor: float = 0.0) -> Column:
    """Unit vector; null where the length (plus ``floor``) is zero."""
    return let(norm(a) + F.lit(floor), lambda n: F.when(n != 0, F.transform(a, lambda x: x.cast("double") / n)))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def project_out(a: Column | str, direction: Column | str) -> Column:
    """``a`` without its part along a unit ``direction``."""
    return let(dot(a, direction), lambda along: F.zip_with(a, direction, lambda x, d: x.cast("double") - along * d.cast("double")))
