"""Completed lines summed by day, SKU and customer, kept so that analyses read lines once.

The analyses of ``plans.sales`` and ``plans.visitors`` take these rows in place of lines and
give the same results. All measures add up over rows, distinct orders too: ``orders`` counts an
order in one row only, that of its least SKU, so sums over whole orders count every order once.
What divides an order, as a SKU or category does, has no number of orders here; neither has
``order_size_segment``, which needs the order itself.
"""

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.functions.columns import zero_if_null

KEYS = ["order_date", "sku_id", "customer_id"]


def daily_sales(orders: DataFrame) -> DataFrame:
    """One row for each day, SKU and customer of ``orders``, null keys included.

    An order has one customer and one date. Lines without an order id count as lines, not as an
    order; they are dealt by their other keys, so that they do not meet in one task.
    """
    known = F.col("order_id").isNotNull()
    apart = F.when(~known, F.xxhash64("sku_id", "customer_id", "order_date"))
    place = F.row_number().over(Window.partitionBy("order_id", "customer_id", apart)
                                .orderBy("order_date", "sku_id"))
    return (orders.withColumn("order_date", F.col("order_date").cast("date"))
            .withColumn("leads", (known & (place == 1)).cast("long"))
            .groupBy(*KEYS).agg(
                F.count(F.lit(1)).alias("lines"), F.sum("leads").alias("orders"),
                F.sum("total_amount").alias("total_amount"),
                F.count("total_amount").alias("amounts"),
                F.sum("quantity").alias("quantity"),
                F.sum(F.when(known, F.col("quantity"))).alias("pieces"),
                F.sum("unit_price").alias("unit_price_sum"),
                F.count("unit_price").alias("unit_prices")))


def is_daily(orders: DataFrame) -> bool:
    """Whether these are rows of :func:`daily_sales` rather than lines."""
    return "order_id" not in orders.columns and "orders" in orders.columns


def order_count(orders: DataFrame) -> Column:
    """Number of orders, from lines or daily rows."""
    return (zero_if_null(F.sum("orders")) if is_daily(orders)
            else F.count_distinct("order_id"))


def summed(orders: DataFrame, total: str, lines: Column) -> Column:
    """Sum of a daily row's ``total``; ``lines`` is the same over lines."""
    return F.sum(total) if is_daily(orders) else lines


class DailySales:
    """Daily rows in a folder, a part for each batch, and each part's dates beside it.

    A batch holds whole orders, as one cut by days does. It may come again: its part is written
    anew under its name. Reading needs no shuffle, because parts add up. A part's first and last
    day are observed while it is written, so the newest date of the whole table is read from as
    many rows as there are batches. A delivery that breaks off is to be repeated.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, batch: str, orders: DataFrame) -> None:
        """Takes in completed lines; days are sorted within files, so that readers skip some."""
        seen = Observation()
        rows = daily_sales(orders).observe(
            seen, F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"),
            F.sum("lines").alias("lines"))
        (rows.sortWithinPartitions("order_date").write.mode("overwrite")
         .parquet(f"{self.folder}/rows/batch={batch}"))
        fact = [(seen.get["first_date"], seen.get["last_date"], seen.get["lines"] or 0)]
        (self.spark.createDataFrame(fact, "first_date date, last_date date, lines long")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/dates/batch={batch}"))

    def rows(self) -> DataFrame:
        path = f"{self.folder}/rows"
        return (self.spark.read.option("basePath", path).parquet(f"{path}/batch=*")
                .drop("batch"))

    def dates(self) -> DataFrame:
        """First and last day and number of lines of all batches; no daily row is read."""
        facts = self.spark.read.schema("first_date date, last_date date, lines long").parquet(
            f"{self.folder}/dates/batch=*")
        return facts.agg(F.min("first_date").alias("first_date"),
                         F.max("last_date").alias("last_date"),
                         zero_if_null(F.sum("lines")).alias("lines"))

    def latest(self) -> Column:
        """The newest date as a lazy scalar, for ``latest=`` of the analyses."""
        return self.dates().select("last_date").scalar()
