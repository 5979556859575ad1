"""Calendar expressions in closed form (no generated date series)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a Monday used as origin for week counting.
_MONDAY = dt.date(1970, 1, 5)


def nth_weekday_after(d: Column, n: int = 10) -> Column:
    """The n-th Monday-to-Friday day strictly after ``d``."""
    wd = F.weekday(d)
    # Saturday and Sunday count from the Friday before.
    days = F.when(wd == 5, n + 2 * ((4 + n) // 5) - 1).when(wd == 6, n + 2 * ((4 + n) // 5) - 2)
    for day in range(5):
        days = days.when(wd == day, n + 2 * ((day + n) // 5))
    return F.date_add(d, days)


def _weekdays_through(d: Column) -> Column:
    days = F.datediff(d, F.lit(_MONDAY))
    return 5 * F.floor(days / 7) + F.least(F.weekday(d) + 1, F.lit(5))


def weekdays_between(a: Column, b: Column) -> Column:
    """Monday-to-Friday days in (a, b]; 0 when b is not after a."""
    return F.greatest(_weekdays_through(b) - _weekdays_through(a), F.lit(0)).cast("int")


def month_key(d: Column) -> Column:
    return F.year(d) * 100 + F.month(d)


def month_label(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "MM/yyyy"), F.lit("Sem data"))


def month_urgency(d: Column, as_of: dt.date) -> Column:
    """Urgency of a whole month, read from its 15th day."""
    left = F.datediff(F.date_add(F.trunc(d, "month"), 14), F.lit(as_of))
    return (
        F.when(d.isNull(), "Sem data")
        .when(left < 0, "Vencida")
        .when(left <= 30, "Próximos 30 dias")
        .when(left <= 90, "31–90 dias")
        .otherwise("Mais de 90 dias")
    )
