"""Tables stored by month and bucketed by a key: months are pruned, joins on the key need no shuffle."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.columns import month_start
from tillscope.operators.periods import date_range

MONTH = "stored_month"


def store_by_month(df: DataFrame, name: str, folder: str, date: str, key: str,
                   buckets: int = 64) -> DataFrame:
    """Writes ``df`` to ``folder`` as table ``name``; returns the stored rows.

    One file a month and bucket: rows are dealt by both before they are written, so a month
    that holds much of the table is written by as many tasks as it has buckets. Rows without a
    date are in a month of their own; equal keys lie in one bucket of every month. Tables that
    are joined on the key need the same number of buckets. An existing folder is not
    overwritten.
    """
    dealt = df.withColumn(MONTH, month_start(date)).repartition(
        F.col(MONTH), F.pmod(F.hash(key), F.lit(buckets)))
    (dealt.write.partitionBy(MONTH).bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", folder).saveAsTable(name))
    return df.sparkSession.table(name)


def attach_store(spark: SparkSession, name: str, folder: str, schema: str, key: str,
                 buckets: int = 64) -> DataFrame:
    """Makes a folder that another session stored known under ``name``, buckets included.

    ``schema``: of the stored columns, as in DDL; ``key`` and ``buckets`` as when it was stored.
    """
    spark.sql(f"create table {name} ({schema}, {MONTH} date) using parquet "
              f"partitioned by ({MONTH}) clustered by (`{key}`) sorted by (`{key}`) "
              f"into {int(buckets)} buckets location '{folder}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def stored_between(stored: DataFrame, date: str, first, last) -> DataFrame:
    """Rows from ``first`` to ``last``, both days included; other months' files are not read."""
    lo, hi = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    months = stored.where(F.col(MONTH).between(F.trunc(lo, "MM"), F.trunc(hi, "MM")))
    return date_range(months, date, first, last).drop(MONTH)
