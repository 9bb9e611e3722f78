"""Column helpers for time, missing values and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def month_index(ts: Column | str) -> Column:
    """year * 12 + month - 1."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def month_label(index: Column | str) -> Column:
    """'YYYY-MM' of a month index."""
    i = F.col(index) if isinstance(index, str) else index
    return F.concat_ws("-", F.lpad(F.floor(i / 12).cast("string"), 4, "0"), F.lpad((i % 12 + 1).cast("string"), 2, "0"))


def last_complete_month(latest: Column) -> Column:
    """Month index before the latest timestamp's: a month ends with its last microsecond, which no sale reaches."""
    return (month_index(latest) - 1).cast("int")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods between two timestamps, rounded down."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY)).cast("long")


def week_ending(ts: Column | str) -> Column:
    """The Sunday that ends the Monday-to-Sunday week of a timestamp."""
    return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)


def known(value: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(value), value)


def close(a: Column, b: Column) -> Column:
    """Equality within 1e-8 + 1e-5 * |b|."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def exact(value: Column | str) -> Column:
    """A double as a decimal, so that sums don't depend on row order."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(18,6)")


def total(value: Column | str) -> Column:
    """Order-independent sum of doubles."""
    return F.sum(exact(value)).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero or null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))
