"""Sales, visitor and table queries over the driver tables."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope import schemas
from tillscope.bindings import roles as R
from tillscope.bindings.oracle import ratio
from tillscope.bindings.registry import query
from tillscope.functions.columns import percent_text, signed_percent, sku_label, yen
from tillscope.operators.materialize import shared_folder
from tillscope.operators.periods import date_range, latest_date, period_start, trailing_period
from tillscope.operators.periods import period_bounds as bounds
from tillscope.plans import sales as A
from tillscope.plans import visitors as V
from tillscope.plans.daily import DailySales
from tillscope.plans.lifetime import FirstPurchases
from tillscope.sources.stores import store_by_month, stored_between
from tillscope.sources.tables import read_checked

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events")
SIX_MONTHS = """select done.* from done, latest
    where order_date between date_trunc('month', d - interval 6 month) and d"""
TWO_YEARS = """select done.* from done, latest
    where order_date between date_trunc('month', d - interval 24 month) and d"""
BEHAVIOR = """select behavior.* from behavior, latest
    where date between date_trunc('month', d - interval 24 month) and d"""


def done(spark, d):
    return A.completed(R.order_lines(spark, d), R.DONE)


def latest(spark, d):
    """Newest completed order date, from the order heads alone."""
    return latest_date(A.completed(R.order_heads(spark, d), R.DONE), "order_date")


def recent(spark, d, months=6):
    return trailing_period(done(spark, d), "order_date", months, latest(spark, d))


def two_years(spark, d):
    return recent(spark, d, 24)


def behavior(spark, d):
    return trailing_period(R.behavior(spark, d), "date", 24, latest(spark, d))


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n from {t}"
                          for t in TABLES))
def table_row_counts(spark, d):
    return reduce(DataFrame.unionAll, [
        R.table(spark, d, t).agg(F.count("*").alias("n"))
        .select(F.lit(t).alias("table_name"), "n") for t in TABLES])


@query("select * from heads where status = 'F'")
def completed_orders(spark, d):
    return A.completed(R.order_heads(spark, d), R.DONE)


@query("select sku_id, label from products")
def sku_labels(spark, d):
    return R.products(spark, d).select("sku_id", sku_label().alias("label"))


@query("select min(order_date) as first_date, max(order_date) as last_date from heads")
def data_range(spark, d):
    return A.data_range(R.order_heads(spark, d))


@query("""select greatest(cast(date_trunc('month', d - interval 6 month) as date),
                           date '2001-03-15') first_day, d last_day,
    d >= date '2001-03-15' has_rows from (select max(order_date) d from heads)""")
def period_bounds(spark, d):
    return bounds(R.order_heads(spark, d), "order_date", 6, "2001-03-15")


@query("""select cast(sum(total_amount) as double) revenue, count(distinct order_id) orders,
    count(distinct customer_id) customers,
    cast(sum(total_amount) as double) / count(distinct order_id) aov from period""",
       period=SIX_MONTHS)
def revenue_kpis(spark, d):
    return A.revenue_kpis(recent(spark, d))


@query("""select months, cast(sum(total_amount) as double) revenue,
    count(distinct order_id) orders, count(distinct customer_id) customers,
    cast(sum(total_amount) as double) / count(distinct order_id) aov
    from done, latest, (values (1), (3), (6), (12)) m(months)
    where order_date between date_trunc('month', d - to_months(months)) and d
    group by months""")
def trailing_period_kpis(spark, d):
    return A.trailing_kpis(done(spark, d), latest=latest(spark, d))


@query("""select count(*) lines, cast(sum(total_amount) as double) revenue from done
    where order_date between date '1997-03-10' and date '1997-06-30'""")
def date_range_sales(spark, d):
    return (date_range(done(spark, d), "order_date", "1997-03-10", "1997-06-30")
            .agg(F.count("*").alias("lines"), F.sum("total_amount").alias("revenue")))


_COMPARE = """
    select measure, cur as current, base,
           case when base <> 0 then (cur - base) / base * 100 end change_pct,
           coalesce((cur - base) / nullif(base, 0) >= 0, true) is_up
    from (select coalesce(max(cast(v as double)) filter (p = 'cur'), 0) cur,
                 coalesce(max(cast(v as double)) filter (p = 'base'), 0) base, measure
          from (unpivot (
                  select p, cast(sum(total_amount) as double) revenue,
                         cast(count(distinct order_id) as double) orders,
                         cast(sum(total_amount) as double) / count(distinct order_id) aov,
                         cast(count(distinct customer_id) as double) customers
                  from labelled where p is not null group by p)
                on revenue, orders, aov, customers into name measure value v)
          group by measure)"""
_LABELLED = """
    select done.*, case
      when order_date between date_trunc('month', d) and d then 'cur'
      when order_date between {lo} and {hi} then 'base' end p
    from done, latest"""
_MONTH = "date_trunc('month', d)"


@query(_COMPARE, labelled=_LABELLED.format(
    lo=f"{_MONTH} - interval 1 month", hi=f"{_MONTH} - interval 1 day"))
def period_comparison_month(spark, d):
    return A.period_comparison(done(spark, d), "previous_month", latest=latest(spark, d))


@query("""select measure, printf('%+.1f', round_even(change_pct, 1)) || '% 前月比' delta
    from compared""", compared=_COMPARE, labelled=_LABELLED.format(
    lo=f"{_MONTH} - interval 1 month", hi=f"{_MONTH} - interval 1 day"))
def period_comparison_display(spark, d):
    compared = A.period_comparison(done(spark, d), "previous_month", latest=latest(spark, d))
    return compared.select("measure", signed_percent("change_pct", " 前月比").alias("delta"))


@query(_COMPARE, labelled=_LABELLED.format(
    lo=f"{_MONTH} - interval 12 month", hi="d - interval 12 month"))
def period_comparison_year(spark, d):
    return A.period_comparison(done(spark, d), "previous_year", latest=latest(spark, d))


@query(_COMPARE, labelled=_LABELLED.format(
    lo=f"{_MONTH} - interval 1 month", hi="d - interval 1 month"))
def period_comparison_like_for_like(spark, d):
    return A.period_comparison(done(spark, d), "previous_month", True, latest(spark, d))


@query("""select order_id, case when sum(quantity) >= 100 then '事業者(推定)'
    else '個人(推定)' end estimated_segment from lines group by 1""")
def order_size_segment(spark, d):
    return A.order_size_segment(R.line_items(spark, d)
                                .join(R.order_heads(spark, d), "order_id", "left_semi"), 100)


@query("""select month, cast(sum(revenue) as double) total,
    coalesce(cast(sum(revenue) filter (flag = '新規') as double), 0) "new",
    coalesce(cast(sum(revenue) filter (flag = 'リピート') as double), 0) "repeat"
    from flagged group by 1""", period=TWO_YEARS)
def new_repeat_monthly(spark, d):
    return A.new_repeat_monthly(two_years(spark, d))


@query("""select month, cast(sum(revenue) as double) total,
    coalesce(cast(sum(revenue) filter (flag = '新規') as double), 0) "new",
    coalesce(cast(sum(revenue) filter (flag = 'リピート') as double), 0) "repeat"
    from flagged, latest where month >= date_trunc('month', d - interval 24 month)
    group by 1""", period="select * from done")
def new_repeat_monthly_lifetime(spark, d):
    since = period_start(latest(spark, d), 24)
    return A.new_repeat_monthly(done(spark, d), since=since)


@query("""select month, cast(sum(revenue) as double) total,
    coalesce(cast(sum(revenue) filter (flag = '新規') as double), 0) "new",
    coalesce(cast(sum(revenue) filter (flag = 'リピート') as double), 0) "repeat"
    from flagged, latest where month >= date_trunc('month', d - interval 24 month)
    group by 1""", period="select * from done")
def new_repeat_monthly_state(spark, d):
    """The same from kept first months: years of history as batches, one of them delivered
    twice, then the period's own lines; only these are split."""
    lines, at = done(spark, d), F.year("order_date")
    kept = FirstPurchases(spark, f"{shared_folder(spark)}/first-{uuid.uuid4().hex}")
    for name, batch in (("old", at < 1995), ("mid", at.between(1995, 1997)), ("new", at > 1997),
                        ("mid", at.between(1995, 1997))):
        kept.add(name, lines.where(batch))
    return A.new_repeat_monthly(two_years(spark, d), history=kept.state())


@query("""select count(*) customers, min(first_month) first_month, max(first_month) last_month,
    count(distinct first_month) as months
    from (select customer_id, cast(date_trunc('month', min(order_date)) as date) first_month
          from done where customer_id is not null group by 1)""")
def first_purchase_state(spark, d):
    """Kept first months after two batches in the wrong order were put into one part."""
    lines, early = done(spark, d), F.year("order_date") < 1996
    folder = f"{shared_folder(spark)}/first-{uuid.uuid4().hex}"
    kept = FirstPurchases(spark, folder)
    kept.add("late", lines.where(~early))
    kept.add("early", lines.where(early))
    return kept.compacted(folder + "-base").state().agg(
        F.count("*").alias("customers"), F.min("first_month").alias("first_month"),
        F.max("first_month").alias("last_month"),
        F.count_distinct("first_month").alias("months"))


@query(f"""select flag, revenue, {ratio('revenue', '(sum(money) over ())')} * 100 share_pct
    from flags""", period=TWO_YEARS)
def new_repeat_share(spark, d):
    return A.new_repeat_share(two_years(spark, d))


@query(f"""select flag, revenue, orders, customers, {ratio('revenue', 'orders')} aov,
    {ratio('orders', 'customers')} frequency, cast(s as bigint) sessions,
    {ratio('orders', 's')} cvr, {ratio('all_orders', 'n')} overall_cvr
    from (select *, case when flag = '新規' then new_s else n - new_s end s
          from (select *, cast(trunc(n * (cast(max(orders) filter (flag = '新規') over ()
                                          as double) / sum(orders) over ())) as bigint) new_s,
                       sum(orders) over () all_orders
                from flags, (select cast(sum(sessions) as bigint) n from site)))""",
       period=TWO_YEARS, site=BEHAVIOR)
def revenue_tree(spark, d):
    return A.revenue_tree(two_years(spark, d), behavior(spark, d))


@query(f"""select flag, {ratio('pieces', 'orders')} pieces_per_order,
    {ratio('price_sum', 'prices')} mean_unit_price, {ratio('revenue', 'orders')} aov,
    (select {ratio('revenue', 'orders')} from flags where flag = 'リピート')
    - (select {ratio('revenue', 'orders')} from flags where flag = '新規') aov_gap
    from flags""", period=TWO_YEARS)
def basket_stats(spark, d):
    return A.basket_stats(two_years(spark, d))


@query(f"""select count(*) customers, count(*) filter (n >= 2) repeaters,
    {ratio('count(*) filter (n >= 2)', 'count(*)')} rate
    from (select customer_id, count(distinct order_id) n from period group by 1)""",
       period=TWO_YEARS)
def repeat_purchase_rate(spark, d):
    return A.repeat_purchase_rate(two_years(spark, d))


@query(f"""select cast(position as int) as position, stage, cast(n as bigint) n,
    {ratio('n', 'sessions')} * 100 pct_of_sessions, mean_bounce_rate
    from (select unnest([0, 1, 2, 3]) as position,
                 unnest(['セッション数', '商品ページ閲覧', 'カート投入', '購入']) stage,
                 unnest([sessions, views, carts, orders]) n, sessions, mean_bounce_rate
          from (select cast(sum(sessions) as bigint) sessions,
                       cast(sum(product_page_views) as bigint) views,
                       cast(sum(add_to_cart) as bigint) carts,
                       {ratio('sum(bounce_rate)', 'count(bounce_rate)')} mean_bounce_rate
                from site),
               (select count(distinct order_id) orders from period))""",
       period=TWO_YEARS, site=BEHAVIOR)
def purchase_funnel(spark, d):
    return A.purchase_funnel(two_years(spark, d), behavior(spark, d))


@query("""select customer_type, cast(sum(total_amount) as double) revenue
    from done join customers using (customer_id) group by 1""")
def sales_by_customer_type(spark, d):
    return A.sales_by_customer_type(done(spark, d), R.customers(spark, d))


@query("""select prefecture, cast(sum(total_amount) as double) revenue
    from done join customers using (customer_id) group by 1""")
def sales_by_region(spark, d):
    return A.sales_by_region(done(spark, d), R.customers_with_region(spark, d))


@query("""select category, cast(sum(total_amount) as double) revenue
    from done join products using (sku_id) group by 1""")
def sales_by_category(spark, d):
    return A.sales_by_category(done(spark, d), R.products(spark, d))


@query("""select sku_id, label, cast(sum(total_amount) as double) revenue
    from done join products using (sku_id) group by 1, 2
    order by revenue desc, sku_id limit 15""")
def sku_ranking(spark, d):
    return A.sku_ranking(done(spark, d), R.products(spark, d))


@query("select count(distinct sku_id) skus from done")
def sku_count(spark, d):
    return A.sku_count(done(spark, d))


_DAYS = """select cast(p as int) as position, ['月','火','水','木','金','土','日'][p + 1] weekday,
    {mean} mean_amount from range(7) r(p) left join {source} l
    on isodow(order_date) - 1 = p group by p"""


@query(_DAYS.format(mean="cast(sum(total_amount) as double) / count(total_amount)",
                    source="done"))
def sales_by_weekday(spark, d):
    return A.sales_by_weekday(done(spark, d))


@query(_DAYS.format(mean="cast(sum(amount) as double) / count(amount)",
                    source="daily"),
       daily="select order_date, sum(total_amount) amount from done group by 1")
def sales_by_weekday_per_day(spark, d):
    return A.sales_by_weekday(done(spark, d), per_day=True)


@query("""select cast(date_trunc('month', order_date) as date) as month,
    cast(sum(total_amount) as double) revenue from done group by 1""")
def monthly_sales(spark, d):
    return A.monthly_sales(done(spark, d))


@query("""select cast(date_trunc('month', order_date) as date) as month, category,
    cast(sum(total_amount) as double) revenue
    from done join products using (sku_id) group by 1, 2""")
def category_monthly_sales(spark, d):
    return A.category_monthly_sales(done(spark, d), R.products(spark, d))


@query("""select customer_id, cast(date_trunc('month', min(order_date)) as date) first_month
    from heads where status = 'F' group by 1""")
def first_purchase(spark, d):
    return A.first_purchase(A.completed(R.order_heads(spark, d), R.DONE))


# ── visitors ────────────────────────────────────────────────────────────────

_VALUE = f"""
    select segment, coalesce(uu, 0) uu, coalesce(cast(sales as double), 0) sales,
           coalesce(n, 0) orders,
           {ratio('sales', 'uu')} uu_unit_price, {ratio('n', 'uu')} cvr,
           {ratio('sales', 'n')} aov, {ratio('sales', '(sum(sales) over ())')} sales_ratio,
           {ratio('uu', '(sum(uu) over ())')} uu_ratio
    from (select distinct customer_type segment from customers)
    left join (select customer_type segment, count(distinct customer_id) uu
               from visitors group by 1) using (segment)
    left join (select customer_type segment, sum(total_amount) sales,
                      count(distinct order_id) n
               from bought join customers using (customer_id) group by 1) using (segment)"""
_EVENTS = {"visitors": """select * from sessions where is_logged_in
               and date >= date '2024-01-05' and date < date '2024-01-21'""",
           "bought": """select * from purchases where order_date >= date '2024-01-05'
               and order_date < date '2024-01-21'"""}
_VISITS = {"visitors": """select v.*, customer_type from visits v
               join customers using (customer_id) where is_logged_in
               and date between date '1997-01-01' and date '1998-12-31'""",
           "bought": """select * from done
               where order_date between date '1997-01-01' and date '1998-12-31'"""}


def event_values(spark, d):
    return V.segment_visitor_value(R.sessions(spark, d), R.purchases(spark, d),
                                   R.customers(spark, d), "2024-01-05", "2024-01-20",
                                   R.SEGMENTS)


def visit_values(spark, d):
    return V.segment_visitor_value(R.visits_with_type(spark, d), done(spark, d),
                                   R.customers(spark, d), "1997-01-01", "1998-12-31",
                                   R.SEGMENTS)


@query("""select channel, count(*) sessions, count(distinct customer_id) visitors
    from touches where is_logged_in group by 1""")
def logged_in_visitors(spark, d):
    return (V.logged_in_visitors(R.sessions(spark, d)).groupBy("channel")
            .agg(F.count("*").alias("sessions"),
                 F.count_distinct("customer_id").alias("visitors")))


@query(_VALUE, **_EVENTS)
def segment_visitor_value(spark, d):
    return event_values(spark, d)


@query(_VALUE, **_VISITS)
def segment_visitor_value_visits(spark, d):
    return visit_values(spark, d)


@query("""select cast(sum(sales) as double) total_sales, cast(sum(uu) as bigint) total_uu,
    cast(sum(sales) as double) / cast(sum(uu) as bigint) overall_uu_unit_price
    from (select cast(sum(total_amount) as decimal(38,4)) sales, 0 uu from bought
          join customers using (customer_id)
          union all select 0, sum(u) from (select count(distinct customer_id) u
          from visitors group by customer_type))""", **_VISITS)
def overall_visitor_value(spark, d):
    return V.overall_visitor_value(visit_values(spark, d))


@query(f"""select month, segment, coalesce(uu, 0) uu, coalesce(sales, 0) sales,
    {ratio('sales', 'uu')} uu_unit_price
    from (select cast(date_trunc('month', date) as date) as month, customer_type segment,
                 count(distinct customer_id) uu
          from visits join customers using (customer_id) where is_logged_in group by 1, 2)
    full join (select cast(date_trunc('month', order_date) as date) as month,
                      customer_type segment, cast(sum(total_amount) as double) sales
               from done join customers using (customer_id) group by 1, 2)
      using (month, segment)""")
def segment_visitor_value_monthly(spark, d):
    return V.segment_visitor_value_monthly(R.visits_with_type(spark, d), done(spark, d),
                                           R.customers(spark, d), R.SEGMENTS)


@query("""select segment, '¥' || format('{:,}', cast(round_even(sales, 0) as bigint)) sales,
    format('{:,}', uu) uu, '¥' || format('{:,}', cast(round_even(uu_unit_price, 0) as bigint))
      uu_unit_price, printf('%.2f', cvr * 100) || '%' cvr
    from shown""", shown=_VALUE, **_VISITS)
def visitor_value_display(spark, d):
    return visit_values(spark, d).select(
        "segment", yen("sales").alias("sales"), F.format_number("uu", 0).alias("uu"),
        yen("uu_unit_price").alias("uu_unit_price"), percent_text("cvr").alias("cvr"))


# ── reading files ───────────────────────────────────────────────────────────


@query("""select count(*) filter (quantity <> 7) lines,
    cast(sum(quantity) filter (quantity <> 7) as bigint) pieces,
    cast(sum(day(order_date)) filter (quantity <> 7) as bigint) as days,
    count(*) filter (quantity = 7) bad_records, count(distinct quantity % 2) files
    from lines where sku_id % 10 < 5""")
def csv_folder(spark, d):
    """Order lines as a folder of CSV files with two orders of columns; one value in fifty is
    not a number. Sound and bad records are counted after reading the folder."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    kinds = schemas.TABLES["ec_orders"]
    given = {"order_id", "customer_id", "sku_id", "order_date", "quantity", "unit_price",
             "status"}
    lines = R.order_lines(spark, d).where(F.col("sku_id") % 10 < 5).select(
        F.col("quantity").alias("pieces"),
        *[(F.col(c) if c in given else F.lit(1)).cast("string").alias(c) for c in kinds.names])
    lines = lines.withColumn("quantity", F.when(F.col("pieces") == 7, "seven")
                             .otherwise(F.col("quantity")))
    for odd, names in ((0, kinds.names), (1, kinds.names[::-1])):
        (lines.where(F.col("pieces") % 2 == odd).select(*names).write.mode("append")
         .option("header", True).csv(f"{path}/ec_orders.csv"))
    good, bad = read_checked(spark, path, "ec_orders")
    counts = good.agg(F.count("*").alias("lines"), F.sum("quantity").alias("pieces"),
                      F.sum(F.dayofmonth("order_date")).alias("days"))
    return counts.select("*", bad.agg(F.count("record")).scalar().alias("bad_records"),
                         F.lit(2).cast("long").alias("files"))


@query("""select cast(date_trunc('month', h.order_date) as date) as month,
    count(distinct order_id) orders, cast(sum(quantity) as bigint) quantity,
    cast(sum(total_amount) as double) revenue
    from lines join heads h using (order_id)
    where h.order_date between date '1996-02-10' and date '1996-11-20' group by 1""")
def stored_orders_monthly(spark, d):
    """Lines and heads stored by month and bucketed by order, then joined for ten months."""
    folder, name = f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}", f"store_{uuid.uuid4().hex}"
    dated = R.order_lines(spark, d).drop("customer_id", "status")
    sides = [stored_between(store_by_month(df, f"{name}_{side}", f"{folder}/{side}", "order_date",
                                           "order_id", 16), "order_date", "1996-02-10", "1996-11-20")
             for side, df in (("lines", dated), ("heads", R.order_heads(spark, d)))]
    return (sides[0].drop("order_date").join(sides[1], "order_id")
            .groupBy("order_id", F.trunc("order_date", "MM").alias("month"))
            .agg(F.sum("quantity").alias("quantity"), F.sum("total_amount").alias("revenue"))
            .groupBy("month").agg(F.count("*").alias("orders"), F.sum("quantity").alias("quantity"),
                                  F.sum("revenue").alias("revenue")))


# ── from daily rows kept once ───────────────────────────────────────────────


def kept_days(spark, d):
    """Daily rows of all completed lines in three batches, one of them delivered twice.

    Lines meet their heads once, for all deliveries; they are cached until the last is taken in.
    """
    lines, at = done(spark, d).drop("status").persist(), F.year("order_date")
    kept = DailySales(spark, f"{shared_folder(spark)}/days-{uuid.uuid4().hex}")
    try:
        for name, batch in (("mid", at.between(1994, 1996)), ("old", at < 1994),
                            ("mid", at.between(1994, 1996)), ("new", at > 1996)):
            kept.add(name, lines.where(batch))
    finally:
        lines.unpersist()
    return kept


_LAST_LINE = "select max(order_date) d from done"
_KEPT_YEARS = """select done.* from done, newest
    where order_date between date_trunc('month', d - interval 24 month) and d"""


@query("""select min(order_date) first_date, max(order_date) last_date, count(*) as lines
    from done""")
def kept_days_range(spark, d):
    return kept_days(spark, d).dates()


@query("""select cast(date_trunc('month', order_date) as date) as month, count(*) as lines,
    count(distinct order_id) orders, count(distinct customer_id) customers,
    count(distinct sku_id) skus, cast(sum(quantity) as bigint) quantity,
    cast(sum(total_amount) as double) revenue from done group by 1""")
def kept_days_monthly(spark, d):
    """Sums and distinct counts by month, orders by adding them up."""
    return (kept_days(spark, d).rows().groupBy(F.trunc("order_date", "MM").alias("month"))
            .agg(F.sum("lines").alias("lines"), F.sum("orders").alias("orders"),
                 F.count_distinct("customer_id").alias("customers"),
                 F.count_distinct("sku_id").alias("skus"), F.sum("quantity").alias("quantity"),
                 F.sum("total_amount").cast("double").alias("revenue")))


@query("""select months, cast(sum(total_amount) as double) revenue,
    count(distinct order_id) orders, count(distinct customer_id) customers,
    cast(sum(total_amount) as double) / count(distinct order_id) aov
    from done, newest, (values (1), (3), (6), (12)) m(months)
    where order_date between date_trunc('month', d - to_months(months)) and d
    group by months""", newest=_LAST_LINE)
def kept_days_kpis(spark, d):
    """KPIs of the trailing periods; the newest date is the one noted when days were written."""
    kept = kept_days(spark, d)
    return A.trailing_kpis(kept.rows(), latest=kept.latest())


@query(f"""select flag, {ratio('pieces', 'orders')} pieces_per_order,
    {ratio('price_sum', 'prices')} mean_unit_price, {ratio('revenue', 'orders')} aov,
    (select {ratio('revenue', 'orders')} from flags where flag = 'リピート')
    - (select {ratio('revenue', 'orders')} from flags where flag = '新規') aov_gap
    from flags""", newest=_LAST_LINE, period=_KEPT_YEARS)
def kept_days_baskets(spark, d):
    """Baskets of new and repeat customers over the kept days of two years."""
    kept = kept_days(spark, d)
    return A.basket_stats(trailing_period(kept.rows(), "order_date", 24, kept.latest()))


@query("""select 'region' as kind, prefecture as name, cast(sum(total_amount) as double) revenue
    from done join customers using (customer_id) where prefecture is not null group by 2
    union all select 'type', customer_type, cast(sum(total_amount) as double)
    from done join customers using (customer_id) where customer_type is not null group by 2
    union all select 'category', category, cast(sum(total_amount) as double)
    from done join products using (sku_id) where category is not null group by 2
    union all (select 'sku', label, cast(sum(total_amount) as double) revenue
    from done join products using (sku_id) group by sku_id, label
    order by revenue desc, sku_id limit 15)""")
def kept_days_breakdowns(spark, d):
    """Four breakdowns of revenue, all from one set of kept days."""
    rows = kept_days(spark, d).rows()
    found = {"region": (A.sales_by_region(rows, R.customers_with_region(spark, d)), "prefecture"),
             "type": (A.sales_by_customer_type(rows, R.customers(spark, d)), "customer_type"),
             "category": (A.sales_by_category(rows, R.products(spark, d)), "category"),
             "sku": (A.sku_ranking(rows, R.products(spark, d)), "label")}
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"),
                  F.col("revenue").cast("double").alias("revenue"))
        for kind, (df, name) in found.items()])
