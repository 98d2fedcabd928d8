"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.base import written


def _state(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of every node in ``a`` or ``b``.

    Only sums and minima per node and joins on nodes move; each round is written to the shared
    folder, until one changes nothing. Two rounds suffice for stars, a chain of n nodes takes about
    log n. Loops, repeated
    and null-free edges in either direction are fine; an edge to itself gives no node.
    """
    edges = written(edges.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while True:
        # large star: larger neighbours of a node move to its smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")) \
            .select("a", F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"),
                                                              F.col("m").alias("b"))
                 .distinct())
        # small star: smaller neighbours of a node move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").filter("a != b").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
