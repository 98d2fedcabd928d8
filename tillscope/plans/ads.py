"""Advertising results by channel and month, and the adjustable spending plan."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.columns import (
    lookup, month_from_label, month_label, month_start, open_ratio, safe_ratio,
    zero_if_null)
from tillscope.operators.matrix import month_number, newest, with_header
from tillscope.sources.tables import empty


def monthly_ad_spend(ads: DataFrame) -> DataFrame:
    return (ads.groupBy(month_start("date").alias("month"))
            .agg(zero_if_null(F.sum("cost")).alias("ad_spend"))
            .where(F.col("month").isNotNull()).orderBy("month"))


def mean_monthly_ad_spend(ads: DataFrame) -> DataFrame:
    """Mean of the monthly totals, 0 without any spending."""
    return monthly_ad_spend(ads).agg(
        safe_ratio(F.sum("ad_spend"), F.count("ad_spend")).alias("mean_ad_spend"))


def ad_channel_summary(ads: DataFrame) -> DataFrame:
    """Cost, clicks, conversions and revenue with CPA and ROAS per channel.

    CPA and ROAS are NULL where their denominator is 0; halves round to even.
    """
    return (ads.where(F.col("channel").isNotNull()).groupBy("channel")
            .agg(*[zero_if_null(F.sum(c)).alias(c)
                   for c in ("cost", "clicks", "conversions", "revenue")])
            .withColumn("cpa", F.bround(open_ratio("cost", "conversions"), 0))
            .withColumn("roas_pct", F.bround(open_ratio("revenue", "cost") * 100, 1))
            .orderBy("channel"))


def ad_conversions_by_type(ads: DataFrame) -> DataFrame:
    return (ads.dropna(subset=["channel", "cv_type"]).groupBy("channel", "cv_type")
            .agg(zero_if_null(F.sum("conversions")).alias("conversions")))


def ad_monthly_cost_revenue(ads: DataFrame) -> DataFrame:
    return (ads.where(F.col("date").isNotNull())
            .groupBy(month_label("date").alias("month"))
            .agg(zero_if_null(F.sum("cost")).alias("cost"),
                 zero_if_null(F.sum("revenue")).alias("revenue"))
            .orderBy("month"))


def ad_plan_adjusted(plan: DataFrame | None, multipliers: dict | None = None,
                     months: DataFrame | None = None) -> DataFrame:
    """Plan rows with the cost after a factor per channel, cut to whole money.

    Channels without a factor stay as planned. ``months`` (a ``month`` DATE column)
    keeps only those months. Without a plan there are no rows.
    """
    if plan is None:
        return empty(SparkSession.active(), "month string, channel string, objective string, "
                     "planned_cost long, month_start date, adjusted_cost long")
    dated = plan.withColumn("month_start", month_from_label("month"))
    if months is not None:
        keep = months.select(F.col("month").alias("month_start"))
        dated = dated.join(keep, "month_start", "left_semi")
    factor = lookup("channel", {k: float(v) for k, v in multipliers.items()}, 1.0) \
        if multipliers else F.lit(1.0)
    return dated.withColumn("adjusted_cost", (F.col("planned_cost") * factor).cast("long"))


def _plan_sums(adjusted, keys):
    return (adjusted.groupBy(*keys)
            .agg(zero_if_null(F.sum("planned_cost")).alias("planned"),
                 zero_if_null(F.sum("adjusted_cost")).alias("adjusted"))
            .withColumn("delta", F.col("adjusted") - F.col("planned"))
            .withColumn("delta_pct", safe_ratio("delta", "planned") * 100))


def plan_scenarios(plan: DataFrame, factors: DataFrame) -> DataFrame:
    """Plan totals by scenario and month, the cost of a row cut to whole money as above.

    ``factors`` (scenario, channel, factor) is a table of hand-made scenarios, of which every
    task holds one copy; plan rows unfold per scenario. Channels without a factor in a scenario
    stay as planned, of repeated factors the largest counts, rows without a scenario or factor
    count for nothing.
    """
    known = (factors.where(F.col("scenario").isNotNull() & F.col("factor").isNotNull())
             .groupBy("scenario", "channel")
             .agg(F.max(F.col("factor").cast("double")).alias("factor")))
    # a channel that is null becomes a factor of no channel, yet keeps its scenario
    per_scenario = known.groupBy("scenario").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("channel").isNotNull(), F.struct("channel", "factor")))).alias("factors"))
    scenarios = per_scenario.agg(F.collect_list(F.struct("scenario", "factors"))).scalar()
    factor = F.coalesce(F.try_element_at("s.factors", F.col("channel")), F.lit(1.0))
    return (_plan_sums(plan.withColumn("month_start", month_from_label("month"))
                       .withColumn("s", F.explode(scenarios))
                       .withColumn("scenario", F.col("s.scenario"))
                       .withColumn("adjusted_cost",
                                   (F.col("planned_cost") * factor).cast("long")),
                       ["scenario", "month_start"])
            .orderBy("scenario", "month_start"))


def ad_plan_monthly(adjusted: DataFrame) -> DataFrame:
    return _plan_sums(adjusted, ["month_start"]).orderBy("month_start")


def ad_plan_total(adjusted: DataFrame) -> DataFrame:
    return _plan_sums(adjusted, [])


def ad_plan_newest(adjusted: DataFrame, window: int = 12, start: int | None = None) -> DataFrame:
    """Adjusted cost with channels as rows and ``window`` months as columns ``p0``, ``p1``, ...

    The newest months of the plan, or those from position ``start`` on; the row ``month``
    tells which, as numbers like 202603.
    """
    cells = newest(adjusted.select("channel", "month", "adjusted_cost"), "month", window, start)
    return with_header(cells, ["channel"], F.sum("adjusted_cost"),
                       F.max(month_number(F.col("month"))), window)


def ad_plan_matrix(adjusted: DataFrame, months) -> DataFrame:
    """Adjusted cost with channels as rows and the given ``yyyy-MM`` months as columns."""
    return (adjusted.groupBy("channel").pivot("month", list(months))
            .agg(F.sum("adjusted_cost")).orderBy("channel"))
