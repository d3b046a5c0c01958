"""Fiscal calendar as columns: a fiscal year is named after the calendar year in which it ends; it starts in month `start`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted(date: Column, start: int = 10) -> Column:
    """The date moved so that the fiscal year is its calendar year."""
    return F.add_months(date.cast("date"), (13 - start) % 12)


def fiscal_year(date: Column, start: int = 10) -> Column:
    return F.year(shifted(date, start))


def fiscal_quarter(date: Column, start: int = 10) -> Column:
    return F.quarter(shifted(date, start))


def year_start(year: Column, start: int = 10) -> Column:
    return F.make_date(year - (1 if start > 1 else 0), F.lit(start), F.lit(1))


def bounds(year: Column, first_month: Column | int, months: int, start: int = 10) -> tuple[Column, Column]:
    begin = F.add_months(year_start(year, start), first_month)
    return begin, F.last_day(F.add_months(begin, months - 1))


def quarter_bounds(year: Column, quarter: Column, start: int = 10) -> tuple[Column, Column]:
    return bounds(year, (quarter - 1) * 3, 3, start)


def half_bounds(year: Column, half: Column, start: int = 10) -> tuple[Column, Column]:
    return bounds(year, (half - 1) * 6, 6, start)


def year_bounds(year: Column, start: int = 10) -> tuple[Column, Column]:
    return bounds(year, 0, 12, start)


def overlaps(start: Column, end: Column, low: Column | str, high: Column | str) -> Column:
    """Closed intervals of ISO strings overlap; a missing end overlaps nothing."""
    low, high = (F.lit(x) if isinstance(x, str) else x for x in (low, high))
    return start.isNotNull() & end.isNotNull() & (end >= low) & (start <= high)
