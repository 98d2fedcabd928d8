"""Sales KPIs, new and repeat customers, funnel and sales breakdowns.

All functions take completed order lines (see :func:`completed`); those that do not say
otherwise also take their daily rows (``plans.daily``). Lines are summed per SKU,
customer, order or day before any join, so a key holding much of the table is reduced on the
map side and never shuffled row by row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope import schemas as S
from tillscope.functions.columns import (
    lookup, month_start, percent_change, safe_ratio, sku_label, zero_if_null)
from tillscope.operators.domains import domain, fill_domain
from tillscope.operators.periods import (
    date_range, latest_date, period_start, trailing_period)
from tillscope.operators.ranking import top_k
from tillscope.plans.daily import is_daily, order_count, summed


def completed(orders: DataFrame, done: str = S.DONE) -> DataFrame:
    return orders.where(F.col("status") == done)


def data_range(orders: DataFrame) -> DataFrame:
    return orders.agg(F.min("order_date").alias("first_date"),
                      F.max("order_date").alias("last_date"))


def _estimated_kpis(orders, rsd):
    def distinct(column):
        return F.approx_count_distinct(column, rsd)
    number = order_count(orders) if is_daily(orders) else distinct("order_id")
    return [zero_if_null(F.sum("total_amount")).alias("revenue"), number.alias("orders"),
            distinct("customer_id").alias("customers")]


def revenue_kpis(orders: DataFrame, rsd: float | None = None) -> DataFrame:
    """Revenue, orders, buyers and average order value in one row.

    Counts are exact; with ``rsd`` they are estimates with that relative error.
    """
    sums = (exact_kpis(orders) if rsd is None
            else orders.agg(*_estimated_kpis(orders, rsd)))
    return sums.withColumn("aov", safe_ratio("revenue", "orders"))


def exact_kpis(orders: DataFrame, *keys) -> DataFrame:
    """Revenue, orders and customers by ``keys``, in sums per order, then per customer.

    An order has one customer, so orders add up over customers and no row is counted
    twice for two distinct counts.
    """
    if is_daily(orders):
        parts = orders.withColumnRenamed("total_amount", "amount")
    else:
        parts = (orders.groupBy(*keys, "customer_id", "order_id")
                 .agg(F.sum("total_amount").alias("amount")))
    per_customer = (parts.groupBy(*keys, "customer_id")
                    .agg(F.sum("amount").alias("amount"),
                         summed(orders, "orders", F.count("order_id")).alias("n")))
    return per_customer.groupBy(*keys).agg(
        zero_if_null(F.sum("amount")).alias("revenue"),
        zero_if_null(F.sum("n")).alias("orders"),
        F.count("customer_id").alias("customers"))


def trailing_kpis(orders: DataFrame, months=(1, 3, 6, 12),
                  latest: Column | None = None) -> DataFrame:
    """KPIs of several trailing periods from one scan.

    Lines are summed per order first; each order then joins the periods it is in.
    """
    latest = latest_date(orders, "order_date") if latest is None else latest
    recent = trailing_period(orders, "order_date", max(months), latest)
    if is_daily(orders):
        recent = (recent.groupBy("customer_id", "order_date")
                  .agg(F.sum("total_amount").alias("total_amount"),
                       F.sum("orders").alias("orders")))
    else:
        recent = (recent.groupBy("order_id", "customer_id", "order_date")
                  .agg(F.sum("total_amount").alias("total_amount")))
    inside = F.array_compact(F.array(*[
        F.when(F.col("order_date") >= period_start(latest, m), m) for m in months]))
    return (exact_kpis(recent.withColumn("months", F.explode(inside)), "months")
            .withColumn("aov", safe_ratio("revenue", "orders")).orderBy("months"))


def period_comparison(orders: DataFrame, base: str | None = "previous_month",
                      like_for_like: bool | None = None,
                      latest: Column | None = None) -> DataFrame:
    """KPIs of the newest month against the month before or the same month last year.

    ``orders`` must be uncut by period, or the base has no rows. ``like_for_like`` cuts
    the base month to the days elapsed in the current one; if not given, the month
    before is taken whole and last year's month is cut.
    """
    latest = latest_date(orders, "order_date") if latest is None else latest
    day = F.col("order_date").cast("date")
    this = month_start(latest)
    back = {"previous_month": -1, "previous_year": -12, None: None}[base]
    period = F.when((day >= this) & (day <= latest), F.lit("current"))
    if like_for_like is None:
        like_for_like = base == "previous_year"
    if back is not None:
        start = F.add_months(this, back)
        end = F.add_months(latest, back) if like_for_like else F.last_day(start)
        period = period.when((day >= start) & (day <= end), F.lit("base"))
    lines = date_range(orders, "order_date", this if back is None else start, latest)
    stats = (exact_kpis(lines.withColumn("period", period)
                        .where(F.col("period").isNotNull()), "period")
             .withColumn("aov", safe_ratio("revenue", "orders")))

    measures = ["revenue", "orders", "aov", "customers"]
    sides = stats.agg(*[
        zero_if_null(F.max(F.when(F.col("period") == p, F.col(m)))).alias(f"{p}_{m}")
        for p in ("current", "base") for m in measures])
    return sides.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"),
                 F.col(f"current_{m}").cast("double").alias("current"),
                 F.col(f"base_{m}").cast("double").alias("base"),
                 percent_change(f"current_{m}", f"base_{m}").alias("change_pct"),
                 F.coalesce(percent_change(f"current_{m}", f"base_{m}") >= 0,
                            F.lit(True)).alias("is_up"))
        for m in measures])))


def order_size_segment(orders: DataFrame,
                       threshold: int = S.BUSINESS_THRESHOLD) -> DataFrame:
    """Estimated segment of each order by its number of pieces; takes lines."""
    return (orders.where(F.col("order_id").isNotNull())
            .groupBy("order_id").agg(zero_if_null(F.sum("quantity")).alias("pieces"))
            .select("order_id",
                    F.when(F.col("pieces") >= threshold, S.ESTIMATED_BUSINESS)
                    .otherwise(S.ESTIMATED_INDIVIDUAL).alias("estimated_segment")))


# ── new and repeat customers ────────────────────────────────────────────────


def customer_months(orders: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Sums per customer and month, flagged new or repeat.

    A month is new when it is the customer's first one in ``orders``, or in
    ``history`` when the uncut lines are given, or first months kept from them
    (``customer_id``, ``first_month``; see ``first_purchase`` and ``plans.lifetime``). Lines without a customer count as
    repeat. ``leads`` marks the first row of a customer under a flag, so counting it
    counts customers. Only these compact rows are sorted per customer.
    """
    month = month_start("order_date").alias("month")
    known_order = F.col("order_id").isNotNull()
    cube = (orders.groupBy("customer_id", month).agg(
        F.sum("total_amount").alias("revenue"), order_count(orders).alias("orders"),
        summed(orders, "pieces", F.sum(F.when(known_order, F.col("quantity"))))
        .alias("pieces"),
        summed(orders, "unit_price_sum", F.sum("unit_price")).alias("unit_price_sum"),
        summed(orders, "unit_prices", F.count("unit_price")).alias("unit_prices")))
    by_customer = Window.partitionBy("customer_id")
    if history is None:
        cube = cube.withColumn("first_month", F.min("month").over(by_customer))
    else:
        first = history if "first_month" in history.columns else first_purchase(history)
        cube = cube.join(first.select("customer_id", "first_month"), "customer_id", "left")
    is_new = F.col("customer_id").isNotNull() & (F.col("month") == F.col("first_month"))
    leads = F.row_number().over(Window.partitionBy("customer_id", "flag").orderBy("month"))
    return (cube.withColumn("flag", F.when(is_new, S.NEW).otherwise(S.REPEAT))
            .withColumn("leads", (F.col("customer_id").isNotNull() & (leads == 1))
                        .cast("long")))


def new_repeat_monthly(orders: DataFrame, history: DataFrame | None = None,
                       since: Column | None = None) -> DataFrame:
    """Revenue by month: total, from new and from repeat customers.

    ``since``: shows the months from that day on only; ``orders`` before it still tell who
    is new, and are read in the same pass.
    """
    def of(flag):
        return zero_if_null(F.sum(F.when(F.col("flag") == flag, F.col("revenue"))))
    shown = F.col("month").isNotNull() if since is None else F.col("month") >= since
    return (customer_months(orders, history).where(shown)
            .groupBy("month")
            .agg(zero_if_null(F.sum("revenue")).alias("total"),
                 of(S.NEW).alias("new"), of(S.REPEAT).alias("repeat"))
            .orderBy("month"))


def _by_flag(orders, history):
    """One row with every sum of :func:`customer_months` for both flags."""
    sums = ("revenue", "orders", "pieces", "unit_price_sum", "unit_prices", "leads")
    return customer_months(orders, history).agg(*[
        zero_if_null(F.sum(F.when(F.col("flag") == flag, F.col(c)))).alias(f"{side}_{c}")
        for flag, side in ((S.NEW, "new"), (S.REPEAT, "repeat")) for c in sums])


def new_repeat_share(orders: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Revenue of both flags and their share of the total in percent."""
    total = F.col("new_revenue") + F.col("repeat_revenue")
    return _by_flag(orders, history).select(F.inline(F.array(*[
        F.struct(F.lit(flag).alias("flag"), F.col(f"{side}_revenue").alias("revenue"),
                 (safe_ratio(f"{side}_revenue", total) * 100).alias("share_pct"))
        for flag, side in ((S.NEW, "new"), (S.REPEAT, "repeat"))])))


def revenue_tree(orders: DataFrame, behavior: DataFrame,
                 history: DataFrame | None = None) -> DataFrame:
    """Revenue split into sessions, conversion, order value and frequency per flag.

    Sessions carry no flag, so new sessions are estimated by the new share of orders,
    cut to a whole number, and repeat sessions are the rest.
    """
    sessions = behavior.agg(zero_if_null(F.sum("sessions"))).scalar()
    all_orders = F.col("new_orders") + F.col("repeat_orders")
    split = (_by_flag(orders, history).withColumn("sessions", sessions)
             .withColumn("new_sessions",
                         (F.col("sessions") * safe_ratio("new_orders", all_orders))
                         .cast("long"))
             .withColumn("repeat_sessions", F.col("sessions") - F.col("new_sessions")))
    return split.select(F.inline(F.array(*[
        F.struct(F.lit(flag).alias("flag"),
                 F.col(f"{side}_revenue").alias("revenue"),
                 F.col(f"{side}_orders").alias("orders"),
                 F.col(f"{side}_leads").alias("customers"),
                 safe_ratio(f"{side}_revenue", f"{side}_orders").alias("aov"),
                 safe_ratio(f"{side}_orders", f"{side}_leads").alias("frequency"),
                 F.col(f"{side}_sessions").alias("sessions"),
                 safe_ratio(f"{side}_orders", f"{side}_sessions").alias("cvr"),
                 safe_ratio(all_orders, "sessions").alias("overall_cvr"))
        for flag, side in ((S.NEW, "new"), (S.REPEAT, "repeat"))])))


def basket_stats(orders: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Pieces per order, mean unit price and order value per flag, and the value gap."""
    gap = (safe_ratio("repeat_revenue", "repeat_orders")
           - safe_ratio("new_revenue", "new_orders"))
    return _by_flag(orders, history).select(F.inline(F.array(*[
        F.struct(F.lit(flag).alias("flag"),
                 safe_ratio(f"{side}_pieces", f"{side}_orders").alias("pieces_per_order"),
                 safe_ratio(f"{side}_unit_price_sum", f"{side}_unit_prices")
                 .alias("mean_unit_price"),
                 safe_ratio(f"{side}_revenue", f"{side}_orders").alias("aov"),
                 gap.alias("aov_gap"))
        for flag, side in ((S.NEW, "new"), (S.REPEAT, "repeat"))])))


def repeat_purchase_rate(orders: DataFrame) -> DataFrame:
    """Share of customers with two or more orders."""
    return (orders.where(F.col("customer_id").isNotNull())
            .groupBy("customer_id").agg(order_count(orders).alias("n"))
            .agg(F.count("*").alias("customers"),
                 F.count_if(F.col("n") >= 2).alias("repeaters"))
            .withColumn("rate", safe_ratio("repeaters", "customers")))


def purchase_funnel(orders: DataFrame, behavior: DataFrame) -> DataFrame:
    """Sessions, product views, carts and purchases, each in percent of sessions.

    Cut both inputs to the same period before calling.
    """
    totals = behavior.agg(
        zero_if_null(F.sum("sessions")).alias("s0"),
        zero_if_null(F.sum("product_page_views")).alias("s1"),
        zero_if_null(F.sum("add_to_cart")).alias("s2"),
        safe_ratio(F.sum("bounce_rate"), F.count("bounce_rate")).alias("mean_bounce_rate"))
    totals = totals.withColumn("s3", orders.agg(order_count(orders)).scalar())
    base = F.greatest(F.col("s0"), F.lit(1))
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(stage).alias("stage"),
                 F.col(f"s{i}").cast("long").alias("n"),
                 (safe_ratio(f"s{i}", base) * 100).alias("pct_of_sessions"),
                 F.col("mean_bounce_rate"))
        for i, stage in enumerate(S.FUNNEL_STAGES)])))


# ── breakdowns ──────────────────────────────────────────────────────────────


def _amount_by(lines: DataFrame, *keys) -> DataFrame:
    known = lines.where(F.col(keys[-1]).isNotNull())
    return known.groupBy(*keys).agg(zero_if_null(F.sum("total_amount")).alias("amount"))


def _sum_amount(df: DataFrame, *keys) -> DataFrame:
    present = df.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(F.sum("amount").alias("revenue"))


def sales_by_customer_type(orders: DataFrame, customers: DataFrame) -> DataFrame:
    by_customer = _amount_by(orders, "customer_id")
    joined = by_customer.join(customers.select("customer_id", "customer_type"), "customer_id")
    return _sum_amount(joined, "customer_type")


def sales_by_region(orders: DataFrame, customers: DataFrame) -> DataFrame:
    by_customer = _amount_by(orders, "customer_id")
    joined = by_customer.join(customers.select("customer_id", "prefecture"), "customer_id")
    return _sum_amount(joined, "prefecture").orderBy(F.desc("revenue"), "prefecture")


def sales_by_category(orders: DataFrame, products: DataFrame) -> DataFrame:
    by_sku = _amount_by(orders, "sku_id")
    joined = by_sku.join(products.select("sku_id", "category"), "sku_id")
    return _sum_amount(joined, "category")


def sku_ranking(orders: DataFrame, products: DataFrame, k: int | None = 15) -> DataFrame:
    """Best selling SKUs; SKUs missing from the catalogue have no label and no row."""
    labels = products.select("sku_id", sku_label().alias("label")).dropna()
    by_sku = _amount_by(orders, "sku_id").withColumnRenamed("amount", "revenue")
    return top_k(by_sku.join(labels, "sku_id"), "revenue", "sku_id", k)


def first_purchase(orders: DataFrame) -> DataFrame:
    """Month of each customer's first order."""
    return (orders.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
            .agg(month_start(F.min("order_date")).alias("first_month")))


def sku_count(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count_distinct("sku_id").alias("skus"))


def sales_by_weekday(orders: DataFrame, per_day: bool = False) -> DataFrame:
    """Mean amount per order line by weekday, Monday first.

    ``per_day`` gives the mean of the daily totals instead.
    """
    number = F.weekday("order_date").alias("position")
    if per_day:
        orders = (orders.groupBy(F.col("order_date").cast("date").alias("order_date"))
                  .agg(F.sum("total_amount").alias("total_amount")))
    means = (orders.groupBy(number)
             .agg(F.sum("total_amount").alias("amount"),
                  summed(orders, "amounts", F.count("total_amount")).alias("n"))
             .select("position", F.try_divide(F.col("amount").cast("double"),
                                              F.col("n").cast("double"))
                     .alias("mean_amount")))
    days = domain(orders.sparkSession, "weekday", S.WEEKDAYS)
    return fill_domain(days, means, "position").orderBy("position")


def monthly_sales(orders: DataFrame) -> DataFrame:
    return (orders.groupBy(month_start("order_date").alias("month"))
            .agg(zero_if_null(F.sum("total_amount")).alias("revenue"))
            .where(F.col("month").isNotNull()).orderBy("month"))


def category_monthly_sales(orders: DataFrame, products: DataFrame) -> DataFrame:
    dated = orders.withColumn("month", month_start("order_date"))
    by_sku = _amount_by(dated, "month", "sku_id")
    joined = by_sku.join(products.select("sku_id", "category"), "sku_id")
    return _sum_amount(joined, "month", "category").orderBy("month", "category")


def channel_bucket(channel: str = "channel", buckets: dict | None = None,
                   default: str = S.DIRECT) -> Column:
    return lookup(channel, S.CHANNEL_BUCKETS if buckets is None else buckets, default)
