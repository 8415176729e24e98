"""Calendar functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(date: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(date)


def next_business_days(date: Column, n: int) -> Column:
    """Array of the n weekdays that follow `date`.

    A weekend date first rolls to Monday, and that Monday counts as the start,
    so the first day returned is Tuesday. Holidays are not known.
    """
    start = F.date_add(
        date, F.when(F.weekday(date) >= 5, 7 - F.weekday(date)).otherwise(0))
    reach = n + 2 * (n // 5 + 1)
    days = F.sequence(F.date_add(start, 1), F.date_add(start, reach))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, n)


def iso_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")
