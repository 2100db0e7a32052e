"""Month ranges in the Gregorian and the Jalali calendar."""

from __future__ import annotations

from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The first day of Jalali year 1 as a proleptic Gregorian ordinal, and the leap years of its 33-year cycle.
EPOCH = date(622, 3, 21).toordinal()
LEAPS = frozenset((1, 5, 9, 13, 17, 22, 26, 30))


def _new_year(year: int) -> int:
    """Ordinal of the first day of a Jalali year by the 33-year rule."""
    cycles, rest = divmod(year - 1, 33)
    return EPOCH + cycles * 12053 + rest * 365 + sum(1 for leap in LEAPS if leap <= rest)


def to_jalali(day: date) -> tuple[int, int, int]:
    number = day.toordinal()
    year = (number - EPOCH) * 33 // 12053 + 1
    while _new_year(year + 1) <= number:
        year += 1
    while _new_year(year) > number:
        year -= 1
    rest = number - _new_year(year)
    month = rest // 31 if rest < 186 else 6 + (rest - 186) // 30
    return year, month + 1, rest - (month * 31 if month < 6 else 186 + (month - 6) * 30) + 1


def from_jalali(year: int, month: int, day: int) -> date:
    passed = (month - 1) * 31 if month <= 7 else 186 + (month - 7) * 30
    return date.fromordinal(_new_year(year) + passed + day - 1)


def jalali_month(day: date) -> tuple[date, date]:
    """First day of the Jalali month and of the next one."""
    year, month, _ = to_jalali(day)
    return from_jalali(year, month, 1), from_jalali(year + month // 12, month % 12 + 1, 1)


def previous_equal(start: date, end: date) -> tuple[date, date]:
    """The range of equal length before [start, end)."""
    return start - (end - start), start


def inclusive_end(end: date) -> date:
    return end - timedelta(days=1)


def gregorian_month(day: Column, shift: int = 0) -> tuple[Column, Column]:
    first = F.add_months(F.date_trunc("month", day).cast("date"), shift)
    return first, F.add_months(first, 1)


@F.pandas_udf(StringType())
def jalali_text(days: pd.Series) -> pd.Series:
    """Jalali dates as yyyy-mm-dd."""
    return days.map(lambda d: "{:04d}-{:02d}-{:02d}".format(*to_jalali(d)), na_action="ignore")
