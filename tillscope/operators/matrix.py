"""Tables with months as columns, by position, so that no month need be known beforehand."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, label: str, window: int, start: int | None = None) -> DataFrame:
    """Rows of ``window`` labels in a row, with ``place`` 0, 1, ...; lazy.

    The newest labels, or those from position ``start`` of all labels on; near the end the
    window moves back so that it stays full. The window function runs over the list of labels.
    """
    spot = Window.orderBy(label)
    labels = (df.select(label).where(F.col(label).isNotNull()).distinct()
              .select(label, (F.row_number().over(spot) - 1).alias("__position"),
                      F.count("*").over(Window.partitionBy()).alias("__labels")))
    last = F.greatest(F.lit(0), F.col("__labels") - window)
    first = last if start is None else F.least(F.lit(start), last)
    place = F.col("__position") - first
    kept = labels.where((place >= 0) & (place < window)).select(label, place.alias("place"))
    return df.join(kept, label)


def places_as_columns(cells: DataFrame, keys, value: Column, width: int) -> DataFrame:
    """One row per ``keys`` and a column ``p0``, ``p1``, ... with ``value``, an aggregate, of
    each ``place``."""
    wide = cells.groupBy(*keys).pivot("place", list(range(width))).agg(value)
    return wide.withColumnsRenamed({str(i): f"p{i}" for i in range(width)})


def with_header(cells: DataFrame, keys, value: Column, head: Column, width: int,
                name: str = "month") -> DataFrame:
    """:func:`places_as_columns` and a row that says what the places are.

    In that row the first key is ``name``, other keys are NULL, and each place has ``head``, an
    aggregate over the place's rows of the same type as ``value``.
    """
    body = places_as_columns(cells, keys, value, width)
    named = cells.withColumns({k: F.lit(None).cast(cells.schema[k].dataType) for k in keys[1:]}
                              | {keys[0]: F.lit(name)})
    return places_as_columns(named, keys, head, width).unionByName(body)


def month_number(month: Column) -> Column:
    """2026-03 (a label or a date) as 202603."""
    return F.regexp_replace(F.substring(month.cast("string"), 1, 7), "[-/]", "").cast("long")
