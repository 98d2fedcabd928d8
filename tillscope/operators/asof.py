"""Backward as-of join by key: the latest right row at or before each left row.

One lazy plan serves all keys, and both sides are read once. Left rows and touches are dealt
by key and slice of time together; a window within the slice carries the latest touch on. The
last touch before a slice comes from one row per key and slice, summed from the same exchange.
So no key, however many rows it has, puts its whole history on one task, and no pairs are made.
Left rows without key or time take part in the exchange under salts of their own, so they meet
no touch.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_MINUTES = 1440
SALTS = 256  # ways to deal left rows that have no key or time


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str,
              payload, tie=(), slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """``left`` plus the ``payload`` columns of its latest earlier ``right`` row.

    Equal times match. Right rows at one instant are ordered by ``tie``. Left rows
    without key, time or earlier touch keep NULLs; a touch whose payload is NULL still
    counts as the touch. ``slice_minutes`` bounds the time that one window group spans.
    """
    columns, payload = left.columns, list(payload)
    at = F.col(left_on).cast("timestamp_ntz")
    known = F.col(by).isNotNull() & at.isNotNull()
    rows = left.select(
        F.struct(by).alias("__key"), at.alias("__at"), F.struct(*columns).alias("__row"),
        F.coalesce(F.when(~known, F.pmod(F.hash(*columns), F.lit(SALTS)) + 1), F.lit(0))
        .alias("__salt"))
    touches = (right.where(F.col(by).isNotNull() & F.col(right_on).isNotNull())
               .withColumn("__at", F.col(right_on).cast("timestamp_ntz"))
               .select(F.struct(by).alias("__key"), "__at", F.lit(0).alias("__salt"),
                       F.struct("__at", *tie, *payload).alias("__touch")))
    found = _latest(rows.unionByName(touches, allowMissingColumns=True), slice_minutes)
    return found.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in payload])


def _latest(both, slice_minutes):
    """The left rows among ``both`` with ``__found``, the largest touch up to each."""
    # Date, hour and minute of a zone-less timestamp: no time zone shift can reorder it.
    minutes = F.expr("unix_date(to_date(__at)) * 1440L + hour(__at) * 60 + minute(__at)")
    group = ["__key", "__slice", "__salt"]
    dealt = (both.withColumn("__slice", F.coalesce(F.floor(minutes / slice_minutes), F.lit(0)))
             .repartition(*group))  # serves all that follows within a slice
    # Spark runs the exchange once if both its readers ask for the same rows and columns: so
    # rows are counted here, and no group column is NULL, for else the join would filter them
    lasts = dealt.groupBy(*group).agg(F.max("__touch").alias("__last"),
                                      F.count("__row").alias("__rows"), F.max("__at").alias("__to"))
    before = (Window.partitionBy("__key", "__salt").orderBy("__slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    seeds = (lasts.withColumn("__seed", F.max("__last").over(before))
             .where("__rows > 0 and __to is not null").select(*group, "__seed"))
    upto = (Window.partitionBy(*group).orderBy("__at")
            .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (dealt.withColumn("__in", F.max("__touch").over(upto)).where("__row is not null")
            .join(seeds, group, "left")
            .select("__row", F.coalesce("__in", "__seed").alias("__found")))
