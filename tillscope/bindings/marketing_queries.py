"""Attribution, advertising and campaign queries over the driver tables."""

from pyspark.sql import functions as F

from tillscope.bindings import roles as R
from tillscope.bindings.registry import query
from tillscope.bindings.sales_queries import done
from tillscope.functions.columns import value_percent, yen_short
from tillscope.operators.asof import asof_join
from tillscope.plans import ads as A
from tillscope.plans import attribution as T
from tillscope.plans import campaigns as C
from tillscope.plans.projection import demand_projection
from tillscope.plans.sales import channel_bucket

MULTIPLIERS = {"1-URGENT": 1.5, "2-HIGH": 0.7, "5-LOW": 0.0}
TIE = ("session_id",)

_EVENT_BUCKET = """case channel when 'view' then 'organic' when 'click' then 'paid'
    when 'signup' then 'paid' else 'direct' end"""
_VISIT_BUCKET = """case channel when '1-URGENT' then 'paid' when '2-HIGH' then 'paid'
    when '3-MEDIUM' then 'organic' when '4-NOT SPECIFIED' then 'mail' else 'direct' end"""


@query(f"""select {_EVENT_BUCKET} bucket, count(*) sessions from touches group by 1""")
def channel_buckets(spark, d):
    bucket = channel_bucket("channel", R.EVENT_BUCKETS, "direct")
    return (R.touches(spark, d).groupBy(bucket.alias("bucket"))
            .agg(F.count("*").alias("sessions")))


@query("select order_id, customer_id, order_date, channel from touched")
def asof_last_touch(spark, d):
    orders = R.purchases(spark, d).select("order_id", "customer_id", "order_date")
    return asof_join(orders, R.touches(spark, d), "customer_id", "order_date", "date",
                     ["channel"], tie=TIE)


@query("""select order_id, sku_id, customer_id, order_date, quantity, channel
    from visited""")
def asof_last_visit(spark, d):
    orders = done(spark, d).select("order_id", "sku_id", "customer_id", "order_date",
                                   "quantity")
    return asof_join(orders, R.visits(spark, d), "customer_id", "order_date", "date",
                     ["channel"], tie=TIE)


def _by_channel(spark, d):
    return T.sales_by_channel(R.purchases(spark, d), R.touches(spark, d), R.EVENT_BUCKETS,
                              "direct", TIE)


@query(f"""select {_EVENT_BUCKET} channel, cast(sum(total_amount) as double) revenue
    from touched group by 1""")
def sales_by_channel(spark, d):
    return _by_channel(spark, d)


@query("""select channel, cast(revenue as double) revenue,
    cast(revenue as double) / cast(sum(revenue) over () as double) share from sold""",
       sold=f"select {_EVENT_BUCKET} channel, sum(total_amount) revenue from touched "
            "group by 1")
def channel_shares(spark, d):
    return T.channel_shares(_by_channel(spark, d))


@query(f"""select {_VISIT_BUCKET} channel, cast(sum(total_amount) as double) revenue
    from visited group by 1""")
def sales_by_channel_visits(spark, d):
    return T.sales_by_channel(done(spark, d), R.visits(spark, d), R.VISIT_BUCKETS,
                              "direct", TIE)


_TOP = "order by {0} desc, sku_id limit 15"
_REVENUE = """select sku_id, label, cast(sum(total_amount) as double) revenue
    from {0} join products using (sku_id) where channel in {1} group by 1, 2
    order by revenue desc, sku_id limit 15"""
_PROFIT = """select sku_id, label, cast(sum(total_amount - cost_price * quantity) as double)
    profit from {0} join products using (sku_id) where channel in {1} group by 1, 2
    order by profit desc, sku_id limit 15"""
_MONTHLY = """select month, coalesce(cost, 0) cost, coalesce(profit, 0) profit
    from (select strftime(date, '%Y-%m') as month, cast(sum(cost) as {3}) cost
          from {2} group by 1)
    full join (select strftime(order_date, '%Y-%m') as month,
                      cast(sum(total_amount - cost_price * quantity) as double) profit
               from {0} join products using (sku_id) where channel in {1} group by 1)
      using (month)"""
_EVENT_ADS, _VISIT_ADS = "('click', 'signup')", "('1-URGENT', '2-HIGH')"


def _event_side(spark, d):
    return R.purchases(spark, d), R.touches(spark, d), R.products(spark, d)


def _visit_side(spark, d):
    return done(spark, d), R.visits(spark, d), R.products(spark, d)


@query(_REVENUE.format("touched", _EVENT_ADS))
def ad_attributed_sku_revenue(spark, d):
    return T.ad_attributed_sku_revenue(*_event_side(spark, d), R.EVENT_ADS, tie=TIE)


@query(_REVENUE.format("visited", _VISIT_ADS))
def ad_attributed_sku_revenue_visits(spark, d):
    return T.ad_attributed_sku_revenue(*_visit_side(spark, d), R.VISIT_ADS, tie=TIE)


@query(_PROFIT.format("touched", _EVENT_ADS))
def ad_attributed_sku_profit(spark, d):
    return T.ad_attributed_sku_profit(*_event_side(spark, d), R.EVENT_ADS, tie=TIE)


@query(_PROFIT.format("visited", _VISIT_ADS))
def ad_attributed_sku_profit_visits(spark, d):
    return T.ad_attributed_sku_profit(*_visit_side(spark, d), R.VISIT_ADS, tie=TIE)


@query(_MONTHLY.format("touched", _EVENT_ADS, "ads", "double"))
def ad_cost_vs_profit_monthly(spark, d):
    return T.ad_cost_vs_profit_monthly(*_event_side(spark, d), R.ad_performance(spark, d),
                                       R.EVENT_ADS, TIE)


@query(_MONTHLY.format("visited", _VISIT_ADS, "order_ads", "bigint"))
def ad_cost_vs_profit_monthly_visits(spark, d):
    return T.ad_cost_vs_profit_monthly(*_visit_side(spark, d), R.order_ads(spark, d),
                                       R.VISIT_ADS, TIE)


# ── advertising ─────────────────────────────────────────────────────────────


@query("select * from spend")
def monthly_ad_spend(spark, d):
    return A.monthly_ad_spend(R.order_ads(spark, d))


@query("select cast(sum(ad_spend) as double) / count(*) mean_ad_spend from spend")
def mean_monthly_ad_spend(spark, d):
    return A.mean_monthly_ad_spend(R.order_ads(spark, d))


@query("""select channel, cast(sum(cost) as double) cost, cast(sum(clicks) as bigint) clicks,
    cast(sum(conversions) as bigint) conversions, cast(sum(revenue) as double) revenue,
    round_even(cast(sum(cost) as double) / nullif(sum(conversions), 0), 0) cpa,
    round_even(cast(sum(revenue) as double) / nullif(cast(sum(cost) as double), 0) * 100, 1)
      roas_pct from ads group by 1""")
def ad_channel_summary(spark, d):
    return A.ad_channel_summary(R.ad_performance(spark, d))


@query("""select channel,
    case when revenue >= 1e6 then '¥' || printf('%.1f', round_even(revenue / 1e6, 1)) || 'M'
         else '¥' || format('{:,}', cast(round_even(revenue, 0) as bigint)) end revenue,
    printf('%.1f', round_even(revenue / cost * 100, 1)) || '%' roas
    from (select channel, cast(sum(revenue) as double) revenue,
                 cast(sum(cost) as double) cost from order_ads group by 1)""")
def ad_channel_display(spark, d):
    ads = R.order_ads(spark, d).withColumns({"clicks": F.lit(0), "conversions": F.lit(0)})
    return A.ad_channel_summary(ads).select("channel", yen_short("revenue").alias("revenue"),
                                            value_percent("roas_pct").alias("roas"))


@query("""select channel, cv_type, cast(sum(conversions) as bigint) conversions from ads
    group by 1, 2""")
def ad_conversions_by_type(spark, d):
    return A.ad_conversions_by_type(R.ad_performance(spark, d))


@query("""select strftime(date, '%Y-%m') as month, cast(sum(cost) as bigint) cost,
    cast(sum(revenue) as bigint) revenue from order_ads group by 1""")
def ad_monthly_cost_revenue(spark, d):
    return A.ad_monthly_cost_revenue(R.order_ads(spark, d))


def adjusted_plan(spark, d):
    return A.ad_plan_adjusted(R.ad_plan(spark, d), MULTIPLIERS)


@query("select month, channel, month_start, planned_cost, adjusted_cost from adjusted")
def ad_plan_adjusted(spark, d):
    return adjusted_plan(spark, d)


_PLAN = """select {0} cast(sum(planned_cost) as bigint) planned,
    cast(sum(adjusted_cost) as bigint) adjusted,
    cast(sum(adjusted_cost) - sum(planned_cost) as bigint) delta,
    coalesce(cast(sum(adjusted_cost) - sum(planned_cost) as double)
      / nullif(cast(sum(planned_cost) as double), 0), 0) * 100 delta_pct
    from adjusted {1}"""


@query(_PLAN.format("month_start,", "group by 1"))
def ad_plan_monthly(spark, d):
    return A.ad_plan_monthly(adjusted_plan(spark, d))


@query(_PLAN.format("", ""))
def ad_plan_total(spark, d):
    return A.ad_plan_total(adjusted_plan(spark, d))


@query(_PLAN.format("month_start,", "where month_start in (select month from ahead) group by 1"
                    ).replace("from adjusted", "from ahead_plan"),
       ahead_plan="""select cast(month_start + interval 7 year as date) month_start,
           planned_cost, adjusted_cost from adjusted""")
def ad_plan_projected_months(spark, d):
    """The plan moved into the projected months, cut to them, by month."""
    ahead = demand_projection(done(spark, d), R.products(spark, d), horizon=6,
                              method="seasonal")
    moved = R.ad_plan(spark, d).withColumn("month", F.date_format(
        F.add_months(F.to_date("month", "yyyy-MM"), 84), "yyyy-MM"))
    return A.ad_plan_monthly(A.ad_plan_adjusted(moved, MULTIPLIERS, ahead.select("month")))


@query("select channel, " + ", ".join(
    f"cast(sum(adjusted_cost) filter (place = {i}) as bigint) p{i}" for i in range(12))
    + " from adjusted join places using (month) group by 1 union all select 'month', "
    + ", ".join(f"cast(max(replace(month, '-', '')) filter (place = {i}) as bigint)"
                for i in range(12)) + " from places",
       places="""select month, place from (
           select month, row_number() over (order by month desc) as back,
                  least(12, count(*) over ()) - back as place
           from (select distinct month from adjusted)) where back <= 12""")
def ad_plan_matrix(spark, d):
    """The newest 12 months of the plan by position."""
    return A.ad_plan_newest(adjusted_plan(spark, d))


# ── campaigns ───────────────────────────────────────────────────────────────


@query("""select campaign_id, campaign_name, start_date, end_date, before, during, after,
    case when before > 0 then (during - before) / before * 100 else 0 end during_lift_pct,
    case when before > 0 then (after - before) / before * 100 else 0 end after_lift_pct
    from (select campaign_id, campaign_name, start_date, end_date,
                 coalesce(cast(sum(total_amount) filter (order_date < start_date) as double),
                          0) before,
                 coalesce(cast(sum(total_amount) filter (order_date between start_date
                          and end_date) as double), 0) during,
                 coalesce(cast(sum(total_amount) filter (order_date > end_date) as double),
                          0) after
          from windows left join done
            on order_date between start_date - nights and end_date + nights
          group by 1, 2, 3, 4)""")
def campaign_lift(spark, d):
    return C.campaign_lift(done(spark, d), R.campaigns(spark, d))


@query("""select campaign_id, order_date as "day", case when order_date < start_date
    then 'before' when order_date <= end_date then 'during' else 'after' end phase,
    cast(sum(total_amount) as double) amount
    from windows join done on order_date between start_date - nights and end_date + nights
    group by 1, 2, 3""")
def campaign_daily_sales(spark, d):
    return C.campaign_daily_sales(done(spark, d), R.campaigns(spark, d))


@query("""select campaign_id, sku_id, label, cast(revenue as double) revenue,
    cast(rank as int) rank
    from (select *, row_number() over (partition by campaign_id
                                       order by revenue desc, sku_id) rank
          from (select campaign_id, sku_id, label, sum(total_amount) revenue
                from windows join done on order_date between start_date and end_date
                join products using (sku_id) group by 1, 2, 3))
    where rank <= 15""")
def campaign_sku_ranking(spark, d):
    return C.campaign_sku_ranking(done(spark, d), R.campaigns(spark, d),
                                  R.products(spark, d))


@query("""select campaign_id, campaign_name, strftime(start_date, '%Y/%m/%d') start_date,
    strftime(end_date, '%Y/%m/%d') end_date, discount_rate, coupon_type, target_category,
    '¥' || format('{:,}', budget) budget, '¥' || format('{:,}', actual_spend) actual_spend
    from campaigns""")
def campaign_list(spark, d):
    return C.campaign_list(R.campaigns(spark, d))
