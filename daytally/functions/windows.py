"""Date windows. Every window is a half-open pair [lo, hi) of Python dates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Window = tuple[date, date]
WHOLE: Window = (date.min, date.max)  # for facts that come with their window


def add_months(day: date, n: int) -> date:
    """Shift by whole months, keeping to the last day of a shorter month."""
    index = day.year * 12 + day.month - 1 + n
    year, month = divmod(index, 12)
    last = (date(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(year, month + 1, min(day.day, last))


def month_of(year: int, month: int) -> Window:
    start = date(year, month, 1)
    return start, add_months(start, 1)


def quarter_of(year: int, quarter: int) -> Window:
    start = date(year, 3 * quarter - 2, 1)
    return start, add_months(start, 3)


def year_of(year: int) -> Window:
    return date(year, 1, 1), date(year + 1, 1, 1)


def inclusive(first: date, last: date) -> Window:
    return first, last + timedelta(days=1)


def trailing_days(as_of: date, days: int) -> Window:
    return as_of - timedelta(days=days), as_of + timedelta(days=1)


def trailing_years(as_of: date, years: int) -> Window:
    return add_months(as_of, -12 * years), as_of + timedelta(days=1)


def date_window(name: str, as_of: date) -> Window:
    """The named window relative to as_of."""
    tomorrow = as_of + timedelta(days=1)
    month = as_of.replace(day=1)
    windows = {
        "today": (as_of, tomorrow),
        "yesterday": (as_of - timedelta(days=1), as_of),
        "this_week": (as_of - timedelta(days=as_of.weekday()), tomorrow),
        "this_month": (month, tomorrow),
        "this_year": (as_of.replace(month=1, day=1), tomorrow),
        "last_month": (add_months(month, -1), month),
        "last_year": year_of(as_of.year - 1),
    }
    return windows[name]


WINDOW_NAMES = ("today", "yesterday", "this_week", "this_month", "this_year", "last_month", "last_year")


def in_window(window: Window, column: str = "date") -> str:
    """SQL condition."""
    lo, hi = window
    return f"({column} >= DATE'{lo}' AND {column} < DATE'{hi}')"


def clip(df: DataFrame, window: Window | None) -> DataFrame:
    """Rows dated inside the window.

    A predicate on `date` alone does not prune directories, so the implied
    predicates on the `year` and `month` partition columns are added when the
    table has them.
    """
    if window is None:
        return df
    lo, last = window[0], window[1] - timedelta(days=1)
    keep = [in_window(window)]
    parts = set(df.columns) & {"year", "month"}
    if "year" in parts:
        keep.append(f"year BETWEEN {lo.year} AND {last.year}")
    if "month" in parts:
        keep.append(f"(year > {lo.year} OR month >= {lo.month}) AND (year < {last.year} OR month <= {last.month})")
    return df.filter(" AND ".join(keep))


def trailing(df: DataFrame, as_of: date | Column | None, days: int) -> DataFrame:
    """The last `days` days up to as_of, or up to the newest date of the table.

    as_of may be a scalar subquery, which Spark runs once and whose value the
    scan then filters on. Pass a date where directories should be pruned.
    """
    if isinstance(as_of, date):
        return clip(df, trailing_days(as_of, days))
    if as_of is None:
        as_of = df.agg(F.max("date")).scalar()
    return df.filter((F.col("date") >= F.date_sub(as_of, days)) & (F.col("date") <= as_of))
