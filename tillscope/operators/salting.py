"""Joining many rows to a few, where the few keys would crowd the rows on few tasks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def join_to_few(many: DataFrame, few: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join on ``key``; ``few`` has one row a key and is repeated ``SALTS`` times.

    Rows of ``many`` are dealt over the copies by ``spread``, so a key with a third of the
    rows is joined by several tasks, whichever side the planner would move.
    """
    salted = many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = few.withColumn("__salt", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "__salt"]).drop("__salt")
