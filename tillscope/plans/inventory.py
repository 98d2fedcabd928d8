"""Inventory flow, turnover and low-stock list."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope import schemas as S
from tillscope.functions.columns import open_ratio, zero_if_null
from tillscope.operators.periods import last_months, latest_snapshot
from tillscope.operators.ranking import top_k


def _categories(per_sku: DataFrame, products: DataFrame) -> DataFrame:
    return (per_sku.join(products.select("sku_id", "category"), "sku_id")
            .where(F.col("category").isNotNull()))


def of_warehouse(inventory: DataFrame, warehouse_type: str | None) -> DataFrame:
    if warehouse_type is None:
        return inventory
    return inventory.where(F.col("warehouse_type") == warehouse_type)


def inventory_flow(inventory: DataFrame, products: DataFrame,
                   warehouse_type: str | None = None) -> DataFrame:
    """Stock, inbound and outbound by date and category; outbound also negated."""
    per_sku = (of_warehouse(inventory, warehouse_type).where(F.col("date").isNotNull())
               .groupBy("date", "sku_id")
               .agg(F.sum("stock_quantity").alias("stock"), F.sum("inbound").alias("inbound"),
                    F.sum("outbound").alias("outbound")))
    return (_categories(per_sku, products).groupBy("date", "category")
            .agg(*[zero_if_null(F.sum(c)).alias(c)
                   for c in ("stock", "inbound", "outbound")])
            .withColumn("outbound_shown", -F.col("outbound"))
            .orderBy("date", "category"))


def inventory_turnover(inventory: DataFrame, products: DataFrame,
                       warehouse_type: str | None = None, months: int = 6,
                       latest: Column | None = None) -> DataFrame:
    """Outbound over mean stock per category in the last ``months`` months.

    The mean is per row, that is per SKU, warehouse and snapshot. Halves round to even.
    """
    recent = last_months(of_warehouse(inventory, warehouse_type), "date", months - 1, latest)
    per_sku = recent.groupBy("sku_id").agg(
        F.sum("stock_quantity").alias("stock"), F.count("stock_quantity").alias("rows"),
        F.sum("outbound").alias("outbound"))
    return (_categories(per_sku, products).groupBy("category")
            .agg(open_ratio(F.sum("stock"), F.sum("rows")).alias("mean_stock_per_row"),
                 zero_if_null(F.sum("outbound")).alias("outbound"))
            .withColumn("turnover",
                        F.bround(open_ratio("outbound", "mean_stock_per_row"), 2))
            .orderBy("category"))


def _scarce(inventory, warehouse_type, below, latest):
    newest = latest_snapshot(inventory, "date", latest)
    return (of_warehouse(newest, warehouse_type)
            .where(F.col("stock_quantity") < below))


def low_stock_count(inventory: DataFrame, warehouse_type: str = S.SHIPPING_WAREHOUSE,
                    below: int = 15, latest: Column | None = None) -> DataFrame:
    """How many rows of the newest snapshot are scarce, listed or not."""
    return _scarce(inventory, warehouse_type, below, latest).agg(
        F.count("*").alias("low_stock"))


def low_stock(inventory: DataFrame, products: DataFrame,
              warehouse_type: str = S.SHIPPING_WAREHOUSE, below: int = 15,
              k: int | None = 15, latest: Column | None = None) -> DataFrame:
    """Scarcest stock of the newest snapshot in one kind of warehouse."""
    scarce = (_scarce(inventory, warehouse_type, below, latest)
              .select("sku_id", "warehouse_name", "stock_quantity"))
    details = products.select("sku_id", "product_name", "category", "color", "size")
    order = ("sku_id", "warehouse_name")
    listed = top_k(scarce, "stock_quantity", order, k, descending=False)
    return top_k(listed.join(details, "sku_id", "left"), "stock_quantity", order, k,
                 descending=False)
