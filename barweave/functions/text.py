"""Display strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from barweave.functions.rounding import round_exact


def option_label(symbol: Column, name: Column) -> Column:
    return F.concat_ws("  ", symbol, name)


def option_symbol(label: Column) -> Column:
    """The symbol back out of an option label."""
    return F.split(F.trim(label), r"\s+")[0]


def currency(symbol: Column, value: Column) -> Column:
    """Yen without decimals for `.T` symbols, else dollars with two."""
    return F.when(
        symbol.endswith(".T"), F.concat(F.lit("¥"), F.format_number(value, 0))
    ).otherwise(F.concat(F.lit("$"), F.format_number(value, 2)))


def signed_percent(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f%%", round_exact(value, digits))


def percent_of(path: Column) -> Column:
    """A price relative to its base, as a percent change."""
    return (path - F.lit(1.0)) * F.lit(100.0)
