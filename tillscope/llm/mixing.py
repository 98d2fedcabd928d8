"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. Words are summed by source and hash bucket; the bucket in
which a source's running sum crosses its budget is split into finer buckets, once. What then
decides on a document is a comparison of its hash with its source's threshold: no sort, no
window over documents, and the same choice in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.base import WORD, fresh, written

BUCKET_BITS = 12  # buckets of the histogram, and of the split of one bucket


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: Column) -> Column:
    """48 uniform bits of a key; rows with equal keys are taken or left together."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def cycled_weights(source: str = "source", cycle=(5, 2, 1)):
    """Weights by the sources' order (code points, null last), repeating ``cycle``."""
    def add(sources: DataFrame) -> DataFrame:
        order = Window.orderBy(F.col(source).asc_nulls_last())
        place = (F.row_number().over(order) - 1) % len(cycle) + 1
        return sources.withColumn(
            "weight", F.element_at(F.array(*map(F.lit, cycle)), place).cast("double"))
    return add


def targets(sizes: DataFrame, weigh, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Budget of each source: ``share`` of all words by weight, at most ``most`` times its own.

    The excess of capped sources goes to the others by weight. Sources in ascending order of
    cap over weight are capped until the level of the rest lies below the next one's cap.
    ``sizes`` has one row per source with ``source_size``; the windows run over those rows.
    """
    weighed = weigh(sizes).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = weighed.select(
        "*",
        ((F.sum("source_size").over(everything) * F.lit(share)
          - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         # weights from here on: a running sum taken from the whole, as sums that run to the
         # end would be added up anew for every source
         / (F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"))
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    free = level.withColumn(
        "free", F.max(F.when(open_, F.col("level"))).over(everything))
    return free.select(
        "source", "source_size",
        F.when(F.col("free").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("free") * F.col("weight"))).alias("target"))


def _crossing(cells: DataFrame, room: str) -> DataFrame:
    """Of each source the cell in which the running sum crosses ``room``, and the sum before.

    ``cells``: source, cell, words, room. A source has at most 2**BUCKET_BITS cells.
    """
    order = Window.partitionBy("source").orderBy("cell")
    running = cells.withColumn("upto", F.sum("words").over(order))
    return (running.filter(F.col("upto") > F.col(room))
            .groupBy("source").agg(F.min_by(F.struct("cell", "words", "upto"), "cell").alias("x"))
            .select("source", F.col("x.cell").alias("cell"), F.col("x.words").alias("cell_words"),
                    (F.col("x.upto") - F.col("x.words")).alias("below")))


def thresholds(docs: DataFrame, weigh, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per source: its size, target, whole passes and the hash threshold of one more.

    ``docs``: source, size, hash. A document is taken ``passes`` times, and once more if its
    hash lies below ``threshold``. Nested budgets: a larger share only raises the two.
    """
    step, top = 2 ** BUCKET_BITS, 48 - BUCKET_BITS
    low = top - BUCKET_BITS
    histogram = written(docs.groupBy("source", F.shiftright("hash", top).alias("cell"))
                        .agg(F.sum("size").alias("words")))
    sizes = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, weigh, share, most).withColumn(
        "passes", F.when(F.col("source_size") > 0,
                         F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = written(plan.withColumn(
        "room", F.col("target") - F.col("passes") * F.col("source_size")))
    same = F.col("p.source").eqNullSafe(F.col("c.source"))
    coarse = written(_crossing(
        plan.alias("p").join(histogram.alias("c"), same)
        .select("p.source", "cell", "words", "room"), "room"))
    # documents of the boundary buckets only, by the next bits of their hash
    edge = (docs.alias("p").join(coarse.select("source", F.col("cell").alias("at")).alias("c"),
                                 same & (F.shiftright("hash", top) == F.col("at")))
            .groupBy("p.source", F.shiftright("hash", low).bitwiseAND(step - 1).alias("cell"))
            .agg(F.sum("size").alias("words")))
    left = (plan.alias("p").join(coarse.alias("c"), same)
            .select("p.source", (F.col("room") - F.col("below")).alias("left")))
    fine = _crossing(left.alias("p").join(edge.alias("c"), same)
                     .select("p.source", "cell", "words", "left"), "left")
    # the last cell goes in if the sum comes nearer to the budget with it
    nearer = (F.col("f.below") + F.col("f.cell_words") - F.col("left")) < \
        (F.col("left") - F.col("f.below"))
    cut = (coarse.alias("c").join(left.alias("p"), same)
           .join(fine.alias("f"), F.col("c.source").eqNullSafe(F.col("f.source")))
           .select("c.source", (F.col("c.cell") * (1 << top) + (
               F.col("f.cell") + nearer.cast("long")) * (1 << low)).alias("threshold")))
    return written(
        plan.alias("p").join(cut.alias("c"), same, "left")
        .select("p.source", "source_size", "target", "passes",
                # no crossing: the room is all there is of the source, or there is none
                F.when(F.col("room") > 0, F.coalesce("threshold", F.lit(1 << 48)))
                .otherwise(F.lit(0)).alias("threshold")))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          weigh=None, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """``docs`` with size, source_size, target and times (how often the mix takes the row).

    A null text has no words; null sources are one source; rows with equal or null keys go
    together; an empty table gives no rows. Columns of those names are replaced.
    """
    slim = docs.select(F.col(source).alias("source"), words(F.col(text)).alias("size"),
                       hash_of(F.col(key)).alias("hash"))
    plan = thresholds(slim, weigh or cycled_weights(), share, most)
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "times")]
    own = docs.select(*kept, words(F.col(text)).alias("size"))
    joined = own.alias("d").join(
        plan.alias("p"), F.col(f"d.{source}").eqNullSafe(F.col("p.source")))
    extra = (hash_of(F.col(f"d.{key}")) < F.col("p.threshold")).cast("long")
    return joined.select(
        *[F.col(f"d.{c}") for c in kept], F.col("d.size"), F.col("p.source_size"),
        F.col("p.target"), (F.col("p.passes") + extra).alias("times"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``docs``."""
    taken = mixed(docs, **options).filter("times > 0")
    copy = fresh("copy", docs)
    return (taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias(copy))
            .drop(copy))
