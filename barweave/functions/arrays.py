"""Numeric arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT = 1e-9  # a shape with less spread than this has no direction


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def spread(values: Column, center: Column) -> Column:
    """Population standard deviation around a given mean."""
    squares = F.aggregate(
        values, F.lit(0.0),
        lambda acc, v: acc + (v - center) * (v - center))
    return F.sqrt(squares / F.size(values))


def standardize(values: Column, center: Column, width: Column) -> Column:
    """z-scores, or NULL for a flat shape."""
    return F.when(
        width >= FLAT, F.transform(values, lambda v: (v - center) / width))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def resample(values: Column, n: int) -> Column:
    """Linear interpolation at n evenly spaced positions of the array."""
    last = F.size(values) - 1

    def at(i: Column) -> Column:
        x = (F.lit(0.0) if n == 1
             else i.cast("double") * last.cast("double") / F.lit(float(n - 1)))
        low = F.least(F.floor(x).cast("int"), last)
        high = F.least(low + 1, last)
        part = x - low
        left = F.element_at(values, low + 1)
        right = F.element_at(values, high + 1)
        return F.when(part == 0, left).otherwise(left + (right - left) * part)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def relative_path(values: Column, base: Column) -> Column:
    """Change of each value against the base."""
    return F.transform(values, lambda v: v / base - F.lit(1.0))
