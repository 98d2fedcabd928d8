"""Three-step replenishment: shipping warehouse, EC warehouse, core warehouse."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope import schemas as S
from tillscope.functions.columns import zero_if_null
from tillscope.operators.periods import latest_snapshot
from tillscope.operators.salting import join_to_few


def stock_by_sku(inventory: DataFrame, latest: Column | None = None) -> DataFrame:
    """Stock of the newest snapshot per SKU in both kinds of warehouse."""
    def stock(kind):
        return zero_if_null(F.sum(F.when(F.col("warehouse_type") == kind,
                                         F.col("stock_quantity"))))
    return (latest_snapshot(inventory, "date", latest)
            .where(F.col("sku_id").isNotNull()).groupBy("sku_id")
            .agg(stock(S.SHIPPING_WAREHOUSE).alias("ship_stock"),
                 stock(S.EC_WAREHOUSE).alias("ec_stock")))


def replenishment_plan(projection: DataFrame, products: DataFrame, inventory: DataFrame,
                       as_of, lead_days: int = 7, latest: Column | None = None) -> DataFrame:
    """Shortage, transfer and core move per SKU for the first projected month.

    Demand of a category is spread evenly over its SKUs, at least 1 each. The deadline
    is the day the stock runs out at the daily demand, less the lead time.
    """
    next_month = projection.groupBy("category").agg(F.min_by("qty", "month").alias("qty"))
    skus = products.select("sku_id", "category", "product_name", "color", "size")
    sizes = skus.groupBy("category").agg(F.count("*").alias("skus"))
    demand = next_month.join(sizes, "category").select(
        "category",
        F.greatest(F.lit(1), (F.col("qty") / F.col("skus")).cast("long")).alias("demand"))
    rows = (join_to_few(skus, demand, "category", "sku_id")
            .join(stock_by_sku(inventory, latest), "sku_id", "left")
            .withColumns({"ship_stock": zero_if_null("ship_stock"),
                          "ec_stock": zero_if_null("ec_stock")}))

    stock = F.col("ship_stock") + F.col("ec_stock")
    need, none = F.col("demand"), F.lit(0)
    rows = rows.withColumns({
        "shortage": F.greatest(none, need - F.col("ship_stock")),
        "core_move": F.greatest(none, need - stock)})
    rows = rows.withColumn("transfer", F.least("shortage", "ec_stock"))
    daily = F.greatest(F.lit(1), F.floor(need / 30))
    days_left = F.greatest(none, F.floor(stock / daily)).cast("int")
    deadline = F.date_add(F.to_date(F.lit(as_of)), days_left - lead_days)
    status = (F.when(F.col("core_move") > 0, S.MOVE_FROM_CORE)
              .when(F.col("shortage") > 0, S.MOVE_FROM_EC).otherwise(S.ENOUGH))
    return rows.select(
        "sku_id", "product_name", "category", "color", "size", "demand", "ship_stock",
        "ec_stock", "shortage", "transfer", "core_move",
        F.when(F.col("core_move") > 0, deadline).alias("deadline"), status.alias("status"))


def replenishment_kpis(plan: DataFrame) -> DataFrame:
    def count(status):
        return F.count_if(F.col("status") == status)
    return plan.agg(
        count(S.ENOUGH).alias("enough_skus"), count(S.MOVE_FROM_EC).alias("transfer_skus"),
        count(S.MOVE_FROM_CORE).alias("core_skus"),
        zero_if_null(F.sum("core_move")).alias("core_units"),
        F.count_if(F.col("shortage") > 0).alias("short_skus"),
        zero_if_null(F.sum("shortage")).alias("short_units"))


def replenishment_alerts(plan: DataFrame, as_of) -> DataFrame:
    """Core moves by category with the earliest deadline and its urgency."""
    left = F.datediff("deadline", F.to_date(F.lit(as_of)))
    level = F.when(left <= 14, "critical").when(left <= 30, "warning").otherwise("info")
    return (plan.where(F.col("status") == S.MOVE_FROM_CORE).groupBy("category")
            .agg(F.count("*").alias("skus"), F.sum("core_move").alias("units"),
                 F.min("deadline").alias("deadline"))
            .withColumn("level", level).orderBy("deadline", "category"))


def shipping_shortages(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("shortage") > 0).orderBy(F.desc("shortage"), "sku_id")


def ec_transfers(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("status") == S.MOVE_FROM_EC).orderBy("category", "sku_id")


def core_moves(plan: DataFrame) -> DataFrame:
    return (plan.where(F.col("status") == S.MOVE_FROM_CORE)
            .orderBy("deadline", "sku_id"))
