"""Driver tables as retail tables.

Every function reads parquet from ``d`` and maps columns to the roles of
``tillscope.schemas``; the SQL twins are in ``tillscope.bindings.oracle``. Values the
tables do not have (stock, cost items, plan, campaigns) are fixed arithmetic on rows.
Money is decimal until all sums are done.
"""

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.columns import month_start
from tillscope.sources.tables import rename_warehouses

DONE = "F"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CORPORATE = "BUILDING"
EVENT_BUCKETS = {"view": "organic", "click": "paid", "signup": "paid", "error": "direct"}
EVENT_ADS = ("click", "signup")
VISIT_BUCKETS = {"1-URGENT": "paid", "2-HIGH": "paid", "3-MEDIUM": "organic",
                 "4-NOT SPECIFIED": "mail"}
VISIT_ADS = ("1-URGENT", "2-HIGH")


# Declared, so that opening a table reads no file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
                " c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
            " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
              " o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
                " l_quantity double, l_extendedprice double, l_discount double,"
                " l_tax double, l_returnflag string, l_linestatus string,"
                " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
              " value double, props string",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def cents(amount: str):
    """A double holding exact cents as a whole number, cheaper than a decimal cast."""
    return F.floor(F.col(amount) * 100 + 0.5)


def money(amount: str):
    return cents(amount).cast("decimal(13,0)") * F.lit(Decimal("0.01"))


def order_heads(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderstatus").alias("status"))


def line_items(spark, d):
    """Lines without their order: enough where no customer or date is asked for."""
    net = (cents("l_extendedprice") * (100 - cents("l_discount"))).cast("decimal(13,0)")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).alias("unit_price"),
        (net * F.lit(Decimal("0.0001"))).alias("total_amount"))


def order_lines(spark, d):
    return line_items(spark, d).join(order_heads(spark, d), "order_id")


def customers(spark, d):
    """Customers without their region: no join where it is not asked for."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("customer_type"))


def customers_with_region(spark, d):
    nations = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("prefecture"))
    return (table(spark, d, "customer").join(nations, "c_nationkey", "left")
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_mktsegment").alias("customer_type"), "prefecture"))


def products(spark, d):
    """``cost_price`` is 60 % of the retail price, in whole money."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("sku_id"), F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("color"),
        F.col("p_size").alias("size"),
        F.floor(F.col("p_retailprice") * 0.6).alias("cost_price"))


def sessions(spark, d):
    """Web events other than purchases, as sessions with time of day."""
    return (table(spark, d, "events").where(F.col("event_type") != "purchase")
            .select(F.col("event_id").alias("session_id"), F.col("ts").alias("date"),
                    F.col("user_id").alias("customer_id"),
                    F.col("event_type").alias("channel"),
                    (F.col("event_type") != "error").alias("is_logged_in"))
            .join(customers(spark, d), "customer_id", "left"))


def touches(spark, d):
    """Sessions without the customer type, all that attribution needs."""
    return (table(spark, d, "events").where(F.col("event_type") != "purchase")
            .select(F.col("event_id").alias("session_id"), F.col("ts").alias("date"),
                    F.col("user_id").alias("customer_id"),
                    F.col("event_type").alias("channel")))


def purchases(spark, d):
    """Purchase events as order lines; SKU and quantity are arithmetic on the id."""
    parts = table(spark, d, "part").agg(F.count("*")).scalar()
    return (table(spark, d, "events").where(F.col("event_type") == "purchase")
            .select(F.col("event_id").alias("order_id"),
                    F.col("user_id").alias("customer_id"), F.col("ts").alias("order_date"),
                    (F.col("event_id") * 7 % parts).alias("sku_id"),
                    (1 + F.col("event_id") % 3).alias("quantity"),
                    money("value").alias("total_amount")))


def visits(spark, d):
    """Orders of any status as logged-in or anonymous visits some days earlier."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("customer_id"),
        F.date_sub(F.col("o_orderdate").cast("date"),
                   (F.col("o_orderkey") % 10).cast("int")).alias("date"),
        F.col("o_orderpriority").alias("channel"),
        (F.col("o_orderkey") % 4 != 0).alias("is_logged_in"))


def visits_with_type(spark, d):
    return visits(spark, d).join(customers(spark, d), "customer_id", "left")


def behavior(spark, d):
    """Daily site totals, derived from the orders of each day."""
    key = F.col("o_orderkey")
    bounce = F.floor(F.sum(key % 5) * 1000 / F.count("*")).cast("decimal(10,0)")
    return (table(spark, d, "orders")
            .groupBy(F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.sum(30 + key % 40).alias("sessions"),
                 F.sum(15 + key % 20).alias("product_page_views"),
                 F.sum(1 + key % 6).alias("add_to_cart"),
                 (bounce * F.lit(Decimal("0.0001"))).alias("bounce_rate")))


def ad_performance(spark, d):
    """Events by day, channel and type as advertising results."""
    kind, value = F.col("event_type"), money("value")
    return (table(spark, d, "events")
            .groupBy(F.col("ts").cast("date").alias("date"),
                     F.concat(F.lit("ch"), (F.col("user_id") % 4).cast("string"))
                     .alias("channel"), kind.alias("cv_type"))
            .agg(F.sum(F.when(kind == "click", value).otherwise(0)).alias("cost"),
                 F.count_if(kind == "click").alias("clicks"),
                 F.count_if(kind == "purchase").alias("conversions"),
                 F.sum(F.when(kind == "purchase", value).otherwise(0)).alias("revenue")))


def order_ads(spark, d):
    """Advertising results over the years of the orders, by day and channel."""
    return (table(spark, d, "orders")
            .groupBy(F.col("o_orderdate").cast("date").alias("date"),
                     F.col("o_orderpriority").alias("channel"))
            .agg(F.sum(F.floor(F.col("o_totalprice") / 20)).alias("cost"),
                 F.sum(F.floor("o_totalprice")).alias("revenue")))


def ad_plan(spark, d):
    """Spending plan by month and channel."""
    channel = F.col("o_orderpriority")
    return (table(spark, d, "orders")
            .groupBy(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM")
                     .alias("month"), channel.alias("channel"))
            .agg(F.sum(F.floor(F.col("o_totalprice") / 25)).alias("planned_cost")))


def inventory(spark, d, grain="MM", since=None):
    """Shipped lines as stock movements by period, SKU and warehouse.

    ``since``, the first day of a period, keeps older lines from being read.
    """
    day = F.col("l_shipdate").cast("date")
    quantity = F.col("l_quantity").cast("int")
    returned = F.col("l_returnflag") == "R"
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    date = F.trunc(day, grain)
    lines = table(spark, d, "lineitem")
    if since is not None:
        lines = lines.where(F.col("l_shipdate") >= since.cast("timestamp_ntz"))
    moved = (lines.groupBy(date.alias("date"), part, supp)
             .agg(F.sum(F.when(returned, quantity).otherwise(0)).alias("inbound"),
                  F.sum(F.when(returned, 0).otherwise(quantity)).alias("outbound")))
    kind = F.when(supp % 2 == 0, "発送倉庫").otherwise("マザー倉庫")
    name = F.when(supp % 2 == 0, "関東発送倉庫").otherwise("関東マザー倉庫")
    return rename_warehouses(moved.select(
        "date", part.alias("sku_id"), kind.alias("warehouse_type"),
        name.alias("warehouse_name"),
        ((part * 7 + supp * 13 + F.month("date") * 5) % 120).alias("stock_quantity"),
        "inbound", "outbound"))


def ship_month(spark, d, grain="MM"):
    """Newest inventory date, read from the ship dates without building inventory."""
    return table(spark, d, "lineitem").agg(
        F.trunc(F.max(F.col("l_shipdate").cast("date")), grain)).scalar()


def campaigns(spark, d):
    """One campaign per nation, so their number stays fixed while orders grow."""
    nation = F.col("c_nationkey")
    per_nation = (table(spark, d, "customer").groupBy("c_nationkey")
                  .agg(F.count("*").alias("customers"),
                       F.sum(F.floor("c_acctbal")).alias("balance")))
    start = F.date_add(F.to_date(F.lit("1995-02-01")), (nation * 91 + 17).cast("int"))
    return per_nation.select(
        F.format_string("CMP%03d", nation).alias("campaign_id"),
        F.concat(F.lit("campaign "), nation.cast("string")).alias("campaign_name"),
        start.alias("start_date"),
        F.date_add(start, (nation * 7 % 45).cast("int")).alias("end_date"),
        (nation % 5 * 10).alias("discount_rate"),
        F.when(nation % 2 == 0, "割引").otherwise("クーポン").alias("coupon_type"),
        F.when(nation % 3 == 0, "全カテゴリ").otherwise("PROMO").alias("target_category"),
        F.col("balance").alias("budget"), (F.col("customers") * 1000).alias("actual_spend"))


def monthly_expenses(spark, d):
    """Shipped lines by month as a P&L; cost items are fixed shares of rows and pieces."""
    quantity = F.col("l_quantity").cast("int")
    sums = (table(spark, d, "lineitem")
            .groupBy(month_start(F.col("l_shipdate").cast("date")).alias("m"))
            .agg(F.sum(cents("l_extendedprice")).alias("cents"),
                 F.sum(quantity).alias("pieces"), F.count("*").alias("lines")))
    return sums.select(
        F.date_format("m", "yyyy-MM").alias("month"), F.expr("cents div 100").alias("売上"),
        (F.col("pieces") * 900).alias("原価"), (F.col("lines") * 150).alias("広告費"),
        (F.col("pieces") * 20).alias("倉庫代"), (F.col("lines") * 500).alias("外注費"),
        (F.col("pieces") * 35).alias("物流費"),
        F.expr("cents div 5000").alias("決済手数料"),
        F.lit(400000).cast("long").alias("システム費"))
