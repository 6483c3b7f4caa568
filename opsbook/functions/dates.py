"""Whole-month and week arithmetic on date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def month_add(m: Column, n: Column | int) -> Column:
    return F.add_months(m, n)


def month_diff(a: Column, b: Column) -> Column:
    """Whole months from a to b by their year and month."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def day_of_month(m: Column, d: Column | int) -> Column:
    """Day d of m's month, or its last day."""
    d = F.lit(d) if isinstance(d, int) else d
    return F.make_date(F.year(m), F.month(m), F.least(d, F.dayofmonth(F.last_day(m))))


def week_start(d: Column) -> Column:
    """Monday of the week that ends with the following Sunday."""
    return F.date_trunc("week", d).cast("date")


def _ordinal(d: Column) -> Column:
    day = F.dayofmonth(d)
    end = F.when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), end, F.lit(" "), F.upper(F.date_format(d, "MMM yyyy")))


def week_label(d: Column) -> Column:
    """`17th AUG 2026 to 23rd AUG 2026` for any day of the week."""
    start = week_start(d)
    return F.concat(_ordinal(start), F.lit(" to "), _ordinal(F.date_add(start, 6)))
