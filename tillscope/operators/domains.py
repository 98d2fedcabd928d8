"""Small fixed domains, so that a value without data still gets its row."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def domain(spark: SparkSession, name: str, values) -> DataFrame:
    """Columns ``name`` and ``position`` for a list of parameter values."""
    rows = F.array(*[F.struct(F.lit(v).alias(name), F.lit(i).alias("position"))
                     for i, v in enumerate(values)])
    return spark.range(0, 1, 1, 1).select(F.inline(rows))


def month_domain(spark: SparkSession, first, last) -> DataFrame:
    """Column ``month``: every month start from ``first`` to ``last``, texts or columns."""
    first, last = (F.trunc(d if isinstance(d, Column) else F.to_date(F.lit(d)), "MM")
                   for d in (first, last))
    return spark.range(0, 1, 1, 1).select(F.explode(F.sequence(
        first, last, F.expr("interval 1 month"))).alias("month"))


def fill_domain(values: DataFrame, df: DataFrame, on: str, zeros=()) -> DataFrame:
    """Left join a fixed domain to ``df``; columns in ``zeros`` become 0 if absent."""
    filled = values.join(df, on, "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zeros})
