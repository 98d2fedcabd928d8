"""Last-touch attribution of sales to the channel of the latest earlier session."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope import schemas as S
from tillscope.functions.columns import month_label, safe_ratio, sku_label, zero_if_null
from tillscope.operators.asof import asof_join
from tillscope.operators.ranking import top_k
from tillscope.plans.ads import ad_monthly_cost_revenue
from tillscope.plans.sales import channel_bucket
from tillscope.sources.tables import empty


def attributed_sales(orders: DataFrame, sessions: DataFrame, keys=(), tie=()) -> DataFrame:
    """Sales per customer, order time and ``keys`` with the last-touch ``channel``.

    The touch depends on customer and time alone, so lines are summed to that grain
    before the as-of join. ``amount_costed`` and ``quantity_costed`` leave out lines
    lacking the other value, as a profit needs both.
    """
    both = F.col("quantity").isNotNull() & F.col("total_amount").isNotNull()
    sales = (orders.groupBy("customer_id", "order_date", *keys).agg(
        zero_if_null(F.sum("total_amount")).alias("amount"),
        F.sum(F.when(both, F.col("total_amount"))).alias("amount_costed"),
        F.sum(F.when(both, F.col("quantity"))).alias("quantity_costed")))
    return asof_join(sales, sessions, "customer_id", "order_date", "date", ["channel"],
                     tie=tie)


def sales_by_channel(orders: DataFrame, sessions: DataFrame | None, buckets=None,
                     default: str = S.DIRECT, tie=()) -> DataFrame:
    """Revenue by channel bucket; sales without a touch count as ``default``."""
    if sessions is None:
        return empty(orders.sparkSession, "channel string, revenue double")
    bucket = channel_bucket("channel", buckets, default)
    return (attributed_sales(orders, sessions, tie=tie)
            .groupBy(bucket.alias("channel")).agg(F.sum("amount").alias("revenue"))
            .orderBy(F.desc("revenue"), "channel"))


def _ad_sales(orders, sessions, keys, ad_channels, tie):
    return (attributed_sales(orders, sessions, keys, tie)
            .where(F.col("channel").isin(*ad_channels)))


def ad_attributed_sku_revenue(orders: DataFrame, sessions: DataFrame | None,
                              products: DataFrame, ad_channels=S.AD_CHANNELS,
                              k: int | None = 15, tie=()) -> DataFrame:
    """Best SKUs by revenue of orders whose last touch was an advertisement."""
    if sessions is None:
        return empty(orders.sparkSession, "sku_id string, revenue double, label string")
    by_sku = (_ad_sales(orders, sessions, ["sku_id"], ad_channels, tie)
              .groupBy("sku_id").agg(F.sum("amount").alias("revenue")))
    labels = products.select("sku_id", sku_label().alias("label")).dropna()
    return top_k(by_sku.join(labels, "sku_id"), "revenue", "sku_id", k)


def _ad_profit(orders, sessions, products, keys, ad_channels, tie):
    """Profit (amount less unit cost times quantity) of advertised sales per keys."""
    sold = (_ad_sales(orders, sessions, ["sku_id", *keys], ad_channels, tie)
            .groupBy("sku_id", *keys).agg(F.sum("amount_costed").alias("amount"),
                                          F.sum("quantity_costed").alias("quantity")))
    costs = products.select("sku_id", "cost_price", sku_label().alias("label"))
    return sold.join(costs, "sku_id", "left").withColumn(
        "profit", F.col("amount") - F.col("cost_price") * F.col("quantity"))


def ad_attributed_sku_profit(orders: DataFrame, sessions: DataFrame | None,
                             products: DataFrame, ad_channels=S.AD_CHANNELS,
                             k: int | None = 15, tie=()) -> DataFrame:
    """Best SKUs by profit of orders whose last touch was an advertisement."""
    if sessions is None:
        return empty(orders.sparkSession, "sku_id string, profit double, label string")
    profit = _ad_profit(orders, sessions, products, [], ad_channels, tie)
    rows = profit.where(F.col("label").isNotNull()).select(
        "sku_id", zero_if_null("profit").alias("profit"), "label")
    return top_k(rows, "profit", "sku_id", k)


def ad_cost_vs_profit_monthly(orders: DataFrame, sessions: DataFrame | None,
                              products: DataFrame, ads: DataFrame,
                              ad_channels=S.AD_CHANNELS, tie=()) -> DataFrame:
    """Advertising cost and profit of advertised sales by month, 0 where one is absent."""
    if sessions is None:
        return empty(orders.sparkSession, "month string, cost double, profit double")
    dated = orders.withColumn("month", month_label("order_date"))
    profit = (_ad_profit(dated, sessions, products, ["month"], ad_channels, tie)
              .groupBy("month").agg(F.sum("profit").alias("profit")))
    cost = ad_monthly_cost_revenue(ads).select("month", "cost")
    return (cost.join(profit, "month", "full")
            .select("month", zero_if_null("cost").alias("cost"),
                    zero_if_null("profit").alias("profit")).orderBy("month"))


def channel_shares(channel_sales: DataFrame) -> DataFrame:
    """Share of each channel bucket in the revenue of all of them."""
    total = Window.partitionBy()  # one row per bucket
    return channel_sales.withColumn(
        "share", safe_ratio("revenue", F.sum("revenue").over(total)))
