"""Inventory, P&L, account, projection and replenishment queries."""

from pyspark.sql import functions as F

from tillscope.bindings import roles as R
from tillscope.bindings.marketing_queries import adjusted_plan
from tillscope.bindings.oracle import ratio
from tillscope.bindings.registry import query
from tillscope.bindings.sales_queries import done, latest
from tillscope.functions.columns import account_name
from tillscope.operators.periods import latest_date, latest_snapshot
from tillscope.plans import accounts as A
from tillscope.plans import ads as D
from tillscope.plans import inventory as I
from tillscope.plans import pl as L
from tillscope.plans import projection as P
from tillscope.plans import replenishment as Z
from tillscope.plans import sales as S
from tillscope.schemas import COST_ITEMS as COSTS
from tillscope.schemas import CORPORATE_PREFIXES, CORPORATE_STEMS, SHIPPING_WAREHOUSE

LAUNCH = "2000-10-15"
AS_OF = "2001-09-30"


# ── inventory ───────────────────────────────────────────────────────────────


@query("""select warehouse_type, warehouse_name, count(*) n from inventory
    group by 1, 2""")
def warehouse_names(spark, d):
    return (R.inventory(spark, d).groupBy("warehouse_type", "warehouse_name")
            .agg(F.count("*").alias("n")))


_FLOW = """select date, category, cast(sum(stock_quantity) as bigint) stock,
    cast(sum(inbound) as bigint) inbound, cast(sum(outbound) as bigint) outbound,
    -cast(sum(outbound) as bigint) outbound_shown
    from inventory join products using (sku_id) {0} group by 1, 2"""


@query(_FLOW.format(""))
def inventory_flow(spark, d):
    return I.inventory_flow(R.inventory(spark, d), R.products(spark, d))


@query(_FLOW.format("where warehouse_type = '発送倉庫'"))
def inventory_flow_shipping(spark, d):
    return I.inventory_flow(R.inventory(spark, d), R.products(spark, d),
                            SHIPPING_WAREHOUSE)


@query("""select category, cast(sum(stock_quantity) as double) / count(*)
      mean_stock_per_row, cast(sum(outbound) as bigint) outbound,
    round_even(cast(sum(outbound) as double)
      / nullif(cast(sum(stock_quantity) as double) / count(*), 0), 2) turnover
    from inventory join products using (sku_id)
    where date >= (select max(date) from inventory) - interval 5 month group by 1""")
def inventory_turnover(spark, d):
    newest = R.ship_month(spark, d)
    return I.inventory_turnover(R.inventory(spark, d, since=F.add_months(newest, -5)),
                                R.products(spark, d), latest=newest)


@query("""select warehouse_type, count(*) n, cast(sum(stock_quantity) as bigint) stock
    from inventory where date = (select max(date) from inventory) group by 1""")
def latest_stock(spark, d):
    newest = R.ship_month(spark, d)
    return (latest_snapshot(R.inventory(spark, d, since=newest), "date", newest)
            .groupBy("warehouse_type")
            .agg(F.count("*").alias("n"), F.sum("stock_quantity").alias("stock")))


@query("""select sku_id, warehouse_name, stock_quantity, product_name, category, color, size
    from inventory join products using (sku_id)
    where date = (select max(date) from inventory) and warehouse_type = '発送倉庫'
      and stock_quantity < 15
    order by stock_quantity, sku_id, warehouse_name limit 15""")
def low_stock(spark, d):
    newest = R.ship_month(spark, d)
    return I.low_stock(R.inventory(spark, d, since=newest), R.products(spark, d),
                       latest=newest)


@query("""select count(*) low_stock from inventory
    where date = (select max(date) from inventory) and warehouse_type = '発送倉庫'
      and stock_quantity < 15""")
def low_stock_count(spark, d):
    newest = R.ship_month(spark, d)
    return I.low_stock_count(R.inventory(spark, d, since=newest), latest=newest)


# ── profit and loss ─────────────────────────────────────────────────────────


@query("select * from pl")
def monthly_pl(spark, d):
    return L.monthly_pl(R.monthly_expenses(spark, d))


@query(f"""select month, 売上 revenue, total_cost, operating_profit, margin_pct,
    {ratio('原価', '売上')} * 100 cogs_pct from pl order by month desc limit 1""")
def latest_month_pl(spark, d):
    return L.latest_month_pl(L.monthly_pl(R.monthly_expenses(spark, d)))


_ITEMS = " union all ".join(
    f"select month, '{c}' item, cast({c} as bigint) amount from expenses" for c in COSTS)


@query(_ITEMS)
def cost_breakdown(spark, d):
    return L.cost_breakdown(R.monthly_expenses(spark, d))


@query("""select month, item, amount,
    cast(amount as double) / cast(sum(amount) over () as double) share
    from items where month = (select max(month) from items)""", items=_ITEMS)
def latest_cost_shares(spark, d):
    return L.latest_cost_shares(R.monthly_expenses(spark, d))


_PL_ITEMS = ("売上", *COSTS, "total_cost", "operating_profit", "margin_pct")


@query(" union all ".join(f"""select month, position, '{i}' item, cast({i} as double) "value"
    from pl join spots using (month)""" for i in _PL_ITEMS),
       spots="""select month, position from (
           select month, row_number() over (order by month) - 1 as position,
                  count(*) over () n from (select distinct month from pl))
           where position >= n - 12""")
def pl_newest_months(spark, d):
    """P&L of the newest 12 months by position, in long form."""
    return L.pl_items(L.month_slice(L.monthly_pl(R.monthly_expenses(spark, d))))


@query(" union all ".join(
    f"select '{name}' item, " + ", ".join(
        f"cast(max({value}) filter (place = {i}) as double) p{i}" for i in range(12))
    + " from pl join places using (month)"
    for name, value in [*((i, i) for i in _PL_ITEMS), ("month", "replace(month, '-', '')")]),
       places="""select month, place from (
           select month, row_number() over (order by month desc) as back,
                  least(12, count(*) over ()) - back as place
           from (select distinct month from pl)) where back <= 12""")
def pl_matrix(spark, d):
    """P&L of the newest 12 months, months as columns by position."""
    return L.pl_newest(L.monthly_pl(R.monthly_expenses(spark, d)))


# ── corporate accounts ──────────────────────────────────────────────────────

_NAME = ("list_extract([" + ", ".join(f"'{w}'" for w in CORPORATE_PREFIXES)
         + "], cast(points % 3 as int) + 1) || list_extract(["
         + ", ".join(f"'{w}'" for w in CORPORATE_STEMS)
         + "], cast(points % 30 as int) + 1)")
_POINTS = ("list_sum(list_transform(string_split(cast(customer_id as varchar), ''), "
           "lambda c: unicode(c)))")


def account_lines(spark, d):
    newest = latest_date(R.order_heads(spark, d), "order_date")
    return A.account_lines(R.order_lines(spark, d), R.customers(spark, d), 12, LAUNCH,
                           R.CORPORATE, R.DONE, newest)


@query(f"""select customer_id, {_NAME} account_name
    from (select customer_id, {_POINTS} points from customers)""")
def account_names(spark, d):
    return R.customers(spark, d).select("customer_id",
                                        account_name("customer_id").alias("account_name"))


@query(f"""select count(distinct customer_id) accounts,
    cast(sum(total_amount) as double) revenue, count(distinct order_id) orders,
    {ratio('sum(total_amount)', 'count(distinct customer_id)')} revenue_per_account,
    {ratio('count(distinct order_id)', 'count(distinct customer_id)')} orders_per_account
    from account_lines""")
def account_kpis(spark, d):
    return A.account_kpis(account_lines(spark, d))


_SUMMARY = f"""select customer_id, last_order, order_count, total_quantity, total_amount,
    {_NAME} account_name
    from (select customer_id, max(order_date) last_order,
                 count(distinct order_id) order_count,
                 cast(sum(quantity) as bigint) total_quantity,
                 cast(sum(total_amount) as double) total_amount, {_POINTS} points
          from account_lines group by customer_id)"""


@query(_SUMMARY)
def account_summary(spark, d):
    return A.account_summary(account_lines(spark, d))


@query(f"select * from summary where regexp_matches(account_name, '建設|工業')",
       summary=_SUMMARY)
def account_search(spark, d):
    return A.account_summary(account_lines(spark, d), "建設|工業", "account_name")


@query("""select customer_id, category, cast(sum(quantity) as bigint) quantity,
    cast(sum(total_amount) as double) amount
    from account_lines join products using (sku_id) group by 1, 2""")
def account_category_summary(spark, d):
    return A.account_category_summary(account_lines(spark, d), R.products(spark, d))


@query("""select customer_id, order_date, order_id, sku_id, product_name, category, quantity,
    unit_price, cast(total_amount as double) total_amount
    from account_lines join products using (sku_id)""")
def account_order_lines(spark, d):
    return A.account_order_lines(account_lines(spark, d), R.products(spark, d))


# ── projection ──────────────────────────────────────────────────────────────

_SALES_SERIES = """select 'all' series, month, y, row_number() over (order by month) - 1 x
    from (select cast(date_trunc('month', order_date) as date) as month,
                 sum(total_amount) y from done group by 1)"""
_PLAN_SPEND = """select month_start as month, cast(sum(adjusted_cost) as double) ad_spend
    from adjusted group by 1"""


@query("""select series category, s.month, cast(x as bigint) month_num, y qty,
    coalesce(cast(ad_spend as double),
      (select cast(sum(ad_spend) as double) / count(*) from spend)) ad_spend, """
       + ", ".join(f"cast(month(s.month) = {m} as int) m_{m}" for m in range(1, 13))
       + " from series s left join spend on s.month = spend.month")
def demand_features(spark, d):
    history = P.category_monthly_quantity(done(spark, d), R.products(spark, d), 6)
    ads = R.order_ads(spark, d)
    frame = P.month_flags(P.month_index(history, "category"))
    return P.with_ad_spend(frame, D.monthly_ad_spend(ads),
                           D.mean_monthly_ad_spend(ads).scalar())


@query(None)
def sales_projection_trees(spark, d):
    return P.sales_projection(done(spark, d))


@query("""select month, cast(x as bigint) month_num, y sales, y * 0.7::double lower,
    y * 1.3::double upper from projected""", series=_SALES_SERIES)
def sales_projection_seasonal(spark, d):
    return P.sales_projection(done(spark, d), method="seasonal")


_ACTUAL_AND_PROJECTED = """select month, kind, sales, lower, upper, strftime(month, '%Y/%m') label
    from (select m as month, '実績' kind, coalesce('¥' || format('{:,}',
                 cast(round_even(cast(y as double), 0) as bigint)), '—') sales,
                 '—' lower, '—' upper
          from (select cast(unnest(generate_series(newest - interval 6 month, newest,
                                                   interval 1 month)) as date) m
                from (select max(month) newest from series))
          left join series on month = m
          union all
          select month, '予測', '¥' || format('{:,}', cast(round_even(y, 0) as bigint)),
                 '¥' || format('{:,}', cast(round_even(y * 0.7::double, 0) as bigint)),
                 '¥' || format('{:,}', cast(round_even(y * 1.3::double, 0) as bigint))
          from projected)"""


def _actual_and_projected(spark, d):
    sales = done(spark, d)
    return P.actual_projection_table(S.monthly_sales(sales),
                                     P.sales_projection(sales, method="seasonal"))


@query(_ACTUAL_AND_PROJECTED, series=_SALES_SERIES)
def actual_projection_table(spark, d):
    return _actual_and_projected(spark, d)


@query(" union all ".join(
    f"select '{i}' item, " + ", ".join(
        f"max({i}) filter (place = {m}) p{m}" for m in range(13))
    + " from placed" for i in ("label", "kind", "sales", "lower", "upper")),
    series=_SALES_SERIES, shown=_ACTUAL_AND_PROJECTED,
    placed="select *, row_number() over (order by month, kind) - 1 as place from shown")
def actual_projection_matrix(spark, d):
    """Seven actual and six projected months as columns by position."""
    return P.table_by_place(_actual_and_projected(spark, d), 13)


@query(None)
def demand_projection_trees(spark, d):
    """Demand with mean spending and with last year's adjusted plan, from one fit."""
    model = P.fit_demand(done(spark, d), R.products(spark, d), R.order_ads(spark, d))
    plan = P.plan_spend(D.ad_plan_monthly(adjusted_plan(spark, d)))
    shifted = plan.withColumn("month", F.add_months("month", 12))
    return (model.project().withColumn("scenario", F.lit("mean spending"))
            .unionByName(model.project(6, shifted).withColumn("scenario", F.lit("plan"))))


@query("""select month, cast(x as bigint) month_num, true as has_band, true as fits_better
    from projected""", series=_SALES_SERIES)
def sales_projection_tree_checks(spark, d):
    """What holds for any fit: months, a band of 30 %, and less error than the mean has."""
    history = P.month_index(P.sales_history(done(spark, d)), "series")
    model = P.fit_sales(history)
    errors = model.errors().select((F.col("trees") < F.col("mean")).alias("b")).scalar()
    return P.sales_band(model, 6).select(
        "month", "month_num", (F.col("sales").between(F.col("lower"), F.col("upper"))
                               & (F.col("upper") - F.col("lower") > 0)).alias("has_band"),
        errors.alias("fits_better"))


@query("""select category, month, month_num, true as whole, true as same_for_mean_plan,
    true as fits_better from ahead""")
def demand_projection_tree_checks(spark, d):
    """What holds for any fit: months, whole pieces, and a plan equal to the mean spending
    changes nothing."""
    model = P.fit_demand(done(spark, d), R.products(spark, d), R.order_ads(spark, d))
    ahead = model.project(6)
    plan = ahead.select("month").distinct().withColumn("ad_spend", model.mean_spend.scalar())
    planned = model.project(6, plan).select("category", "month", F.col("qty").alias("planned"))
    errors = model.fitted.errors().select((F.col("trees") < F.col("mean")).alias("b")).scalar()
    return ahead.join(planned, ["category", "month"]).select(
        "category", "month", "month_num", (F.col("qty") >= 0).alias("whole"),
        (F.col("qty") == F.col("planned")).alias("same_for_mean_plan"),
        errors.alias("fits_better"))


_FACTORS = [("half", "1-URGENT", 0.5), ("half", "2-HIGH", 0.5), ("half", "3-MEDIUM", 0.5),
            ("none of two", "1-URGENT", 0.0), ("none of two", "5-LOW", 0.0),
            ("urgent more", "1-URGENT", 1.7)]
_SCENARIOS = f"""select scenario, cast(month || '-01' as date) month_start, planned_cost,
    cast(trunc(planned_cost * coalesce(factor, 1::double)) as bigint) adjusted_cost
    from plan cross join (select distinct scenario from factors) left join factors f
      using (scenario, channel)"""
_FACTOR_ROWS = "select * from (values " + ", ".join(
    f"('{s}', '{c}', {f}::double)" for s, c, f in _FACTORS) + ") t(scenario, channel, factor)"


def _scenario_plans(spark, d):
    factors = spark.createDataFrame(_FACTORS, "scenario string, channel string, factor double")
    return D.plan_scenarios(R.ad_plan(spark, d), factors)


@query("""select scenario, month_start, cast(sum(planned_cost) as bigint) planned,
    cast(sum(adjusted_cost) as bigint) adjusted,
    cast(sum(adjusted_cost) - sum(planned_cost) as bigint) delta,
    coalesce(cast(sum(adjusted_cost) - sum(planned_cost) as double)
      / nullif(cast(sum(planned_cost) as double), 0), 0) * 100 delta_pct
    from moved group by 1, 2""", factors=_FACTOR_ROWS, moved=_SCENARIOS)
def ad_plan_scenarios(spark, d):
    """The whole plan under three sets of factors per channel."""
    return _scenario_plans(spark, d)


@query("""select scenario, category, a.month, month_num,
    coalesce(ad_spend, (select cast(sum(ad_spend) as double) / count(*) from spend)) ad_spend,
    true as whole, true as delta_fits
    from ahead a cross join (select distinct scenario from factors)
    left join planned p using (scenario, month)""",
       factors=_FACTOR_ROWS, moved=_SCENARIOS,
       planned="""select scenario, cast(month_start + to_months(84) as date) as month,
           cast(sum(adjusted_cost) as double) ad_spend from moved group by 1, 2""")
def demand_scenarios_checks(spark, d):
    """Scenarios of the plan of seven years ago through one fit: spending of every month,
    whole pieces, and differences that agree with a projection at mean spending."""
    spend = _scenario_plans(spark, d).select(
        "scenario", F.add_months("month_start", 84).alias("month"),
        F.col("adjusted").cast("double").alias("ad_spend"))
    model = P.fit_demand(done(spark, d), R.products(spark, d), R.order_ads(spark, d), trees=20)
    mean = model.project(6).select("category", "month", F.col("qty").alias("usual"))
    return model.scenarios(spend, 6).join(mean, ["category", "month"]).select(
        "scenario", "category", "month", "month_num", "ad_spend",
        (F.col("qty") >= 0).alias("whole"),
        (F.col("qty") - F.col("usual") == F.col("delta")).alias("delta_fits"))


def seasonal_demand(spark, d):
    return P.demand_projection(done(spark, d), R.products(spark, d), horizon=6,
                               method="seasonal")


@query("select * from ahead")
def demand_projection_seasonal(spark, d):
    return seasonal_demand(spark, d)


@query("""select cast(f.month + to_months(12) as date) as month,
    coalesce(p.ad_spend, (select cast(sum(ad_spend) as double) / count(*) from spend))
      ad_spend, category, month_num, qty
    from (select category, cast(month - to_months(12) as date) as month, month_num, qty
          from ahead) f left join plan_spend p on f.month = p.month""",
       plan_spend=_PLAN_SPEND)
def planned_spend_ahead(spark, d):
    """Last year's adjusted plan, or the mean past spending, next to each future month."""
    plan = P.plan_spend(D.ad_plan_monthly(adjusted_plan(spark, d)))
    return P.with_ad_spend(seasonal_demand(spark, d),
                           plan.withColumn("month", F.add_months("month", 12)),
                           D.mean_monthly_ad_spend(R.order_ads(spark, d)).scalar())


def split(spark, d):
    return P.sku_demand_split(seasonal_demand(spark, d), done(spark, d),
                              R.products(spark, d), latest=latest(spark, d))


@query("""select category, sku_id, product_name, color, size, month, qty,
    cast(sum(qty) over (partition by sku_id) as bigint) total from split""")
def sku_demand_split(spark, d):
    return split(spark, d)


@query("select category, sku_id, cast(sum(qty) as bigint) total, " + ", ".join(
    f"max(qty) filter (place = {i}) p{i}" for i in range(6))
    + " from split join places using (month) group by 1, 2 union all"
      " select 'month', null, null, " + ", ".join(
    f"cast(max(strftime(month, '%Y%m')) filter (place = {i}) as bigint)" for i in range(6))
    + " from places",
       places="""select month, row_number() over (order by month) - 1 as place
           from (select distinct month from split)""")
def sku_demand_matrix(spark, d):
    """Projected months as columns by position."""
    return P.sku_demand_by_place(split(spark, d))


@query("select category, cast(sum(qty) as bigint) qty from split group by 1")
def category_demand_total(spark, d):
    return P.category_demand_total(split(spark, d))


# ── replenishment ───────────────────────────────────────────────────────────


def plan(spark, d):
    return Z.replenishment_plan(seasonal_demand(spark, d), R.products(spark, d),
                                R.inventory(spark, d, "YEAR"), AS_OF,
                                latest=R.ship_month(spark, d, "YEAR"))


_PLAN_COLUMNS = """sku_id, product_name, category, color, size, demand, ship_stock, ec_stock,
    shortage, transfer, core_move, deadline, status"""


@query(f"select {_PLAN_COLUMNS} from replenish")
def replenishment_plan(spark, d):
    return plan(spark, d)


@query("""select count(*) filter (status = '在庫十分') enough_skus,
    count(*) filter (status = 'EC在庫倉庫から移動') transfer_skus,
    count(*) filter (status = '基幹倉庫から移動') core_skus,
    cast(coalesce(sum(core_move), 0) as bigint) core_units,
    count(*) filter (shortage > 0) short_skus,
    cast(coalesce(sum(shortage), 0) as bigint) short_units from replenish""")
def replenishment_kpis(spark, d):
    return Z.replenishment_kpis(plan(spark, d))


@query("""select category, count(*) skus, cast(sum(core_move) as bigint) units,
    min(deadline) deadline, case when min(deadline) - date '2001-09-30' <= 14
      then 'critical' when min(deadline) - date '2001-09-30' <= 30 then 'warning'
      else 'info' end as level
    from replenish where status = '基幹倉庫から移動' group by 1""")
def replenishment_alerts(spark, d):
    return Z.replenishment_alerts(plan(spark, d), AS_OF)


@query(f"select {_PLAN_COLUMNS} from replenish where shortage > 0")
def shipping_shortages(spark, d):
    return Z.shipping_shortages(plan(spark, d))


@query(f"select {_PLAN_COLUMNS} from replenish where status = 'EC在庫倉庫から移動'")
def ec_transfers(spark, d):
    return Z.ec_transfers(plan(spark, d))


@query(f"select {_PLAN_COLUMNS} from replenish where status = '基幹倉庫から移動'")
def core_moves(spark, d):
    return Z.core_moves(plan(spark, d))
