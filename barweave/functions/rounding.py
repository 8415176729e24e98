"""Rounding as the price tools of the Python world do it.

Spark's `round` works on the decimal text of a double and rounds halves up.
Two other rules occur in the results to match:

* `round_scaled`: scale, round half to even, scale back (arrays and tables);
* `round_exact`: half to even on the exact binary value (single numbers), so
  9.85, stored as 9.8499..., gives 9.8.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # 2**27 + 1 cuts a double into two halves of 26 bits


def round_scaled(value: Column, digits: int) -> Column:
    scale = F.lit(float(10 ** digits))
    return F.rint(value * scale) / scale


def round_exact(value: Column, digits: int) -> Column:
    scale = F.lit(float(10 ** digits))
    scaled = value * scale
    # The rounding error of the product, exact: only it can break a tie.
    wide = value * F.lit(SPLIT)
    high = wide - (wide - value)
    error = (high * scale - scaled) + (value - high) * scale
    floor = F.floor(scaled).cast("double")
    tie = (scaled - floor) == F.lit(0.5)
    nearest = (
        F.when(tie & (error > 0), floor + 1.0)
        .when(tie & (error < 0), floor)
        .otherwise(F.rint(scaled))
    )
    return nearest / scale


def round_columns(df, digits: int, skip: tuple[str, ...] = ()):
    """Round every floating-point column of a table."""
    kinds = {"double", "float"}
    return df.select(*[
        round_scaled(F.col(f"`{name}`"), digits).alias(name)
        if kind in kinds and name not in skip else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])
