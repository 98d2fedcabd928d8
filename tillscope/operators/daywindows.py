"""Range joins of dated facts to date windows, as equi-joins on the day.

Facts must be summed per day first, so raw fact rows never meet a range condition. Where every
day of a window is wanted, windows are unfolded to one row per day; where only their sums are,
a window needs the running totals of two days, however long it is.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(daily: DataFrame, first: Column, last: Column, value: str = "amount",
                   day: str = "day") -> DataFrame:
    """``day`` and ``upto``, the sum of ``value`` from ``first`` to it, for every day until
    ``last``; no rows if a bound is NULL.

    One row per day of the calendar, over which the window function runs. Sums are exact for
    whole numbers and decimals, so their differences are the windows' sums.
    """
    calendar = daily.sparkSession.range(0, 1, 1, 1).select(
        F.explode(F.when(first <= last, F.sequence(first, last))).alias(day))
    run = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (calendar.join(daily.groupBy(day).agg(F.sum(value).alias("__sum")), day, "left")
            .select(day, F.sum("__sum").over(run).alias("upto")))


def window_sums(windows: DataFrame, totals: DataFrame, key: str, bounds: dict,
                day: str = "day") -> DataFrame:
    """``windows`` with the sum of each window in ``bounds``: name -> (first, last) day.

    Both days are included. A window without days, or with a NULL bound, has NULL, and so
    has one before the first fact. A row of ``windows``, told apart by ``key``, becomes two
    small ones for each of its windows, not one for each of its days.
    """
    asked = F.array(*[F.struct(F.lit(name).alias("name"), at.alias(day), F.lit(sign).alias("sign"))
                      for name, (first, last) in bounds.items()
                      for at, sign in ((F.when(first <= last, last), 1),
                                       (F.when(first <= last, F.date_sub(first, 1)), -1))])
    found = (windows.select(key, F.inline(asked)).where(F.col(day).isNotNull())
             .join(totals, day)
             .groupBy(key).agg(*[F.sum(F.when(F.col("name") == name, F.col("upto") * F.col("sign")))
                                 .alias(name) for name in bounds]))
    return windows.join(found, key, "left")


def unfold_days(windows: DataFrame, first: Column, last: Column,
                day: str = "day") -> DataFrame:
    """One row per window and day from ``first`` to ``last``, both included.

    A window without days keeps one row with a NULL day.
    """
    return windows.withColumn(day, F.explode_outer(
        F.when(first <= last, F.sequence(first, last))))
