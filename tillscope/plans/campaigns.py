"""Campaign lift: sales before, during and after each campaign, all at once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.columns import (
    month_label, percent_change, sku_label, yen, zero_if_null)
from tillscope.operators.daywindows import running_totals, unfold_days, window_sums
from tillscope.operators.ranking import top_k_per_group

KEYS = ("campaign_id", "campaign_name", "start_date", "end_date")


def campaign_days(campaigns: DataFrame) -> DataFrame:
    """One row per campaign and day with its phase.

    A campaign of n nights has n days before, n + 1 days during and n days after.
    """
    start, end = F.col("start_date"), F.col("end_date")
    nights = F.datediff(end, start)
    days = unfold_days(campaigns.select(*KEYS), F.date_sub(start, nights),
                       F.date_add(end, nights))
    phase = (F.when(F.col("day") < start, "before").when(F.col("day") <= end, "during")
             .otherwise("after"))
    return days.withColumn("phase", phase)


def daily_sales(orders: DataFrame, days: DataFrame, *keys) -> DataFrame:
    """Sales by day and ``keys`` on the given ``day`` rows; order dates may have a time.

    The first and last day bound the scan, and other days leave before they are summed.
    """
    at = F.col("order_date")
    first, last = (days.agg(f("day")).scalar() for f in (F.min, F.max))
    inside = (orders.where((at >= first) & (at < F.date_add(last, 1)))
              .withColumn("day", at.cast("date")))
    return (inside.join(days.select("day").distinct(), "day", "left_semi")
            .groupBy("day", *keys).agg(F.sum("total_amount").alias("amount")))


def campaign_lift(orders: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Sales of the three phases and the change in percent, 0 if nothing sold before.

    Phases are those of :func:`campaign_days`. Each is the difference of two running totals,
    so campaigns that are long or overlap cost no more than short ones.
    """
    start, end = F.col("start_date"), F.col("end_date")
    nights = F.datediff(end, start)
    bounds = {"before": (F.date_sub(start, nights), F.date_sub(start, 1)),
              "during": (start, end), "after": (F.date_add(end, 1), F.date_add(end, nights))}
    keyed = campaigns.select(*KEYS).distinct().withColumn("campaign_key", F.struct(*KEYS))
    # totals begin the day before the first one asked for
    spans = keyed.where(nights >= 0).agg(
        F.min(F.date_sub(start, nights + 1)).alias("first"),
        F.max(F.date_add(end, nights)).alias("last"))
    first, last = (spans.select(c).scalar() for c in ("first", "last"))
    at = F.col("order_date")
    daily = (orders.where((at >= first) & (at < F.date_add(last, 1)))
             .groupBy(at.cast("date").alias("day")).agg(F.sum("total_amount").alias("amount")))
    sums = window_sums(keyed, running_totals(daily, first, last), "campaign_key", bounds)
    sums = sums.select(*KEYS, *[zero_if_null(p).alias(p) for p in bounds])

    def lift(phase):
        return F.when(F.col("before") > 0, percent_change(phase, "before")).otherwise(0.0)
    return (sums.withColumn("during_lift_pct", lift("during"))
            .withColumn("after_lift_pct", lift("after")).orderBy("campaign_id"))


def campaign_daily_sales(orders: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Sales by campaign and day over all three phases, days with sales only."""
    days = campaign_days(campaigns)
    return (days.select("campaign_id", "day", "phase").join(daily_sales(orders, days), "day")
            .select("campaign_id", "day", "phase", zero_if_null("amount").alias("amount"))
            .orderBy("campaign_id", "day"))


def campaign_sku_ranking(orders: DataFrame, campaigns: DataFrame, products: DataFrame,
                         k: int = 15) -> DataFrame:
    """Best SKUs of each campaign while it ran."""
    during = unfold_days(campaigns.select(*KEYS), F.col("start_date"), F.col("end_date"))
    sold = (during.select("campaign_id", "day")
            .join(daily_sales(orders.where(F.col("sku_id").isNotNull()), during, "sku_id"),
                  "day")
            .groupBy("campaign_id", "sku_id")
            .agg(zero_if_null(F.sum("amount")).alias("revenue")))
    labels = products.select("sku_id", sku_label().alias("label")).dropna()
    return top_k_per_group(sold.join(labels, "sku_id"), "campaign_id", "revenue",
                           "sku_id", k)


def campaign_list(campaigns: DataFrame, name: str | None = None) -> DataFrame:
    """Details of one campaign, or of all, as text."""
    chosen = campaigns if name is None else campaigns.where(F.col("campaign_name") == name)
    return chosen.select(
        "campaign_id", "campaign_name",
        month_label("start_date", "yyyy/MM/dd").alias("start_date"),
        month_label("end_date", "yyyy/MM/dd").alias("end_date"),
        "discount_rate", "coupon_type", "target_category",
        yen("budget").alias("budget"), yen("actual_spend").alias("actual_spend"))
