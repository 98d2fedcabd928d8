"""Revenue per logged-in visitor, by customer segment."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope import schemas as S
from tillscope.functions.columns import month_start, safe_ratio, zero_if_null
from tillscope.operators.domains import domain, fill_domain
from tillscope.operators.periods import date_range
from tillscope.plans.daily import order_count
from tillscope.sources.tables import empty

VALUE_SCHEMA = ("segment string, uu long, sales double, orders long, uu_unit_price double,"
                " cvr double, aov double, sales_ratio double, uu_ratio double")
MONTHLY_SCHEMA = "month date, segment string, uu long, sales double, uu_unit_price double"


def logged_in_visitors(sessions: DataFrame) -> DataFrame:
    return sessions.where("is_logged_in")


def _by_segment(per_customer: DataFrame, customers: DataFrame) -> DataFrame:
    kinds = customers.select("customer_id", F.col("customer_type").alias("segment"))
    return per_customer.join(kinds, "customer_id")


def segment_visitor_value(sessions: DataFrame | None, orders: DataFrame,
                          customers: DataFrame, start, end,
                          segments=S.SEGMENTS, rsd: float | None = None) -> DataFrame:
    """Visitors, sales, orders and their ratios per segment, and both shares.

    Visitors are distinct logged-in customers. Orders are summed per customer before
    they meet the customer table. Every segment has a row. ``rsd`` estimates visitors.
    """
    if sessions is None:
        return empty(orders.sparkSession, VALUE_SCHEMA)
    distinct = (F.count_distinct("customer_id") if rsd is None
                else F.approx_count_distinct("customer_id", rsd))
    visitors = (date_range(logged_in_visitors(sessions), "date", start, end)
                .groupBy(F.col("customer_type").alias("segment"))
                .agg(distinct.alias("uu")))
    per_customer = (date_range(orders, "order_date", start, end)
                    .where(F.col("customer_id").isNotNull())
                    .groupBy("customer_id")
                    .agg(F.sum("total_amount").alias("sales"),
                         order_count(orders).alias("orders")))
    bought = (_by_segment(per_customer, customers).groupBy("segment")
              .agg(F.sum("sales").alias("sales"), F.sum("orders").alias("orders")))
    table = domain(sessions.sparkSession, "segment", segments)
    table = fill_domain(table, visitors, "segment", zeros=("uu",))
    table = fill_domain(table, bought, "segment", zeros=("sales", "orders"))
    total = Window.partitionBy()  # the table has one row per segment
    return table.select(
        "segment", "uu", "sales", "orders",
        safe_ratio("sales", "uu").alias("uu_unit_price"),
        safe_ratio("orders", "uu").alias("cvr"),
        safe_ratio("sales", "orders").alias("aov"),
        safe_ratio("sales", F.sum("sales").over(total)).alias("sales_ratio"),
        safe_ratio("uu", F.sum("uu").over(total)).alias("uu_ratio"))


def overall_visitor_value(segment_values: DataFrame) -> DataFrame:
    """Sales per visitor over all segments, i.e. their mean weighted by visitors."""
    return (segment_values.agg(zero_if_null(F.sum("sales")).alias("total_sales"),
                               zero_if_null(F.sum("uu")).alias("total_uu"))
            .withColumn("overall_uu_unit_price", safe_ratio("total_sales", "total_uu")))


def segment_visitor_value_monthly(sessions: DataFrame | None, orders: DataFrame,
                                  customers: DataFrame,
                                  segments=S.SEGMENTS) -> DataFrame:
    """Visitors, sales and sales per visitor by month and segment."""
    if sessions is None:
        return empty(orders.sparkSession, MONTHLY_SCHEMA)
    visitors = (logged_in_visitors(sessions)
                .where(F.col("customer_type").isin(*segments))
                .groupBy(month_start("date").alias("month"),
                         F.col("customer_type").alias("segment"))
                .agg(F.count_distinct("customer_id").alias("uu")))
    per_customer = (orders.where(F.col("customer_id").isNotNull())
                    .groupBy("customer_id", month_start("order_date").alias("month"))
                    .agg(F.sum("total_amount").alias("sales")))
    bought = (_by_segment(per_customer, customers)
              .where(F.col("segment").isin(*segments))
              .groupBy("month", "segment").agg(F.sum("sales").alias("sales")))
    return (visitors.join(bought, ["month", "segment"], "full")
            .select("month", "segment", zero_if_null("uu").alias("uu"),
                    zero_if_null(F.col("sales").cast("double")).alias("sales"))
            .withColumn("uu_unit_price", safe_ratio("sales", "uu"))
            .where(F.col("month").isNotNull()).orderBy("month", "segment"))
