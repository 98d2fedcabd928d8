"""Date-range filters. Global dates are scalar subqueries, so nothing runs early."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_date(df: DataFrame, date: str) -> Column:
    """The newest date of ``df`` as a lazy scalar."""
    return df.agg(F.max(F.col(date).cast("date"))).scalar()


def period_start(latest: Column, months: int, floor=None) -> Column:
    """First day of the month ``months`` before ``latest``, not before ``floor``."""
    start = F.trunc(F.add_months(latest, -months), "MM")
    return start if floor is None else F.greatest(start, F.to_date(F.lit(floor)))


def period_bounds(df: DataFrame, date: str, months: int, floor=None) -> DataFrame:
    """First and last day of the trailing period, and whether it holds any rows.

    It holds none when ``floor`` (a launch date) is later than the newest row.
    """
    newest = df.agg(F.max(F.col(date).cast("date")).alias("last_day"))
    start = period_start(F.col("last_day"), months, floor)
    return newest.select(start.alias("first_day"), "last_day",
                         F.coalesce(start <= F.col("last_day"), F.lit(False)).alias("has_rows"))


def trailing_period(df: DataFrame, date: str, months: int, latest: Column | None = None,
                    floor=None) -> DataFrame:
    """Rows of the last ``months`` months, snapped to a month start.

    Pass ``latest`` when the newest date is known or cheaper to read elsewhere.
    """
    latest = latest_date(df, date) if latest is None else latest
    return date_range(df, date, period_start(latest, months, floor), latest)


def date_range(df: DataFrame, date: str, start, end) -> DataFrame:
    """Rows from ``start`` to ``end``, both days included."""
    lo = start if isinstance(start, Column) else F.to_date(F.lit(start))
    hi = end if isinstance(end, Column) else F.to_date(F.lit(end))
    return df.where((F.col(date) >= lo) & (F.col(date) < F.date_add(hi, 1)))


def last_months(df: DataFrame, date: str, months: int,
                latest: Column | None = None) -> DataFrame:
    """Rows not older than ``months`` months before the newest, day kept."""
    latest = latest_date(df, date) if latest is None else latest
    return df.where(F.col(date) >= F.add_months(latest, -months))


def latest_snapshot(df: DataFrame, date: str, latest: Column | None = None) -> DataFrame:
    """Rows of the newest date of the whole table (not the newest per key)."""
    latest = df.agg(F.max(date)).scalar() if latest is None else latest
    return df.where(F.col(date) == latest)
