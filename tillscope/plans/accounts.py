"""Monitoring of corporate accounts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope import schemas as S
from tillscope.functions.columns import account_name, safe_ratio, zero_if_null
from tillscope.operators.periods import trailing_period
from tillscope.plans.sales import exact_kpis

# Sort choices: column and whether it ascends.
SORTS = {"last_order": False, "total_amount": False, "order_count": False,
         "account_name": True}


def account_lines(orders: DataFrame, customers: DataFrame, months: int = 6,
                  launch=S.LAUNCH_DATE, corporate: str = S.CORPORATE, done: str = S.DONE,
                  latest: Column | None = None) -> DataFrame:
    """Completed lines of corporate customers in the trailing period since ``launch``.

    ``orders`` holds every status: the period ends at the newest order of any. No rows
    come out when nothing was sold since the launch.
    """
    recent = trailing_period(orders, "order_date", months, latest, floor=launch)
    accounts = customers.where(F.col("customer_type") == corporate)
    return (recent.where(F.col("status") == done)
            .join(accounts.select("customer_id"), "customer_id", "left_semi"))


def account_kpis(lines: DataFrame) -> DataFrame:
    return (exact_kpis(lines).withColumnRenamed("customers", "accounts")
            .withColumn("revenue_per_account", safe_ratio("revenue", "accounts"))
            .withColumn("orders_per_account", safe_ratio("orders", "accounts")))


def account_summary(lines: DataFrame, search: str = "",
                    sort_by: str = "last_order") -> DataFrame:
    """Last order, orders, pieces and revenue per account.

    ``search`` is a regular expression on the account name.
    """
    accounts = (lines.groupBy("customer_id")
                .agg(F.max("order_date").alias("last_order"),
                     F.count_distinct("order_id").alias("order_count"),
                     zero_if_null(F.sum("quantity")).alias("total_quantity"),
                     zero_if_null(F.sum("total_amount")).alias("total_amount"))
                .withColumn("account_name", account_name("customer_id")))
    if search.strip():
        accounts = accounts.where(
            F.coalesce(F.col("account_name").rlike(search.strip()), F.lit(False)))
    key = F.col(sort_by)
    return accounts.orderBy(key.asc() if SORTS[sort_by] else key.desc(), "customer_id")


def account_category_summary(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Pieces and revenue by account and category, for all accounts at once."""
    per_sku = (lines.groupBy("customer_id", "sku_id")
               .agg(F.sum("quantity").alias("quantity"), F.sum("total_amount").alias("amount")))
    return (per_sku.join(products.select("sku_id", "category"), "sku_id")
            .where(F.col("category").isNotNull()).groupBy("customer_id", "category")
            .agg(zero_if_null(F.sum("quantity")).alias("quantity"),
                 zero_if_null(F.sum("amount")).alias("amount"))
            .orderBy("customer_id", F.desc("amount"), "category"))


def account_order_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines per account, newest first."""
    details = products.select("sku_id", "product_name", "category")
    return (lines.join(details, "sku_id", "left")
            .select("customer_id", "order_date", "order_id", "sku_id", "product_name",
                    "category", "quantity", "unit_price", "total_amount")
            .orderBy("customer_id", F.desc("order_date"), "order_id", "sku_id"))
