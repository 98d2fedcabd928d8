"""Top-k with a unique tie-break, so equal values never make the result vary."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, value: str, tie, k: int | None = 15,
          descending: bool = True) -> DataFrame:
    ties = [tie] if isinstance(tie, str) else list(tie)
    order = F.col(value).desc() if descending else F.col(value).asc()
    ordered = df.orderBy(order, *ties)
    return ordered if k is None else ordered.limit(k)


def top_k_per_group(df: DataFrame, group, value: str, tie, k: int = 15) -> DataFrame:
    """``k`` best rows per group; map tasks keep only ``k`` rows per group."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
