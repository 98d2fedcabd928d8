"""SQL twins of ``tillscope.bindings.roles``, as named common table expressions."""

import re

_ROLES = {
    "heads": """
        select o_orderkey order_id, o_custkey customer_id,
               cast(o_orderdate as date) order_date, o_orderstatus status
        from orders""",
    "lines": """
        select l_orderkey order_id, o_custkey customer_id, l_partkey sku_id,
               cast(o_orderdate as date) order_date, o_orderstatus status,
               cast(l_quantity as int) quantity,
               cast(floor(l_extendedprice * 100 / l_quantity) as bigint) unit_price,
               cast(l_extendedprice as decimal(12,2))
                 * (1 - cast(l_discount as decimal(4,2))) total_amount
        from lineitem join orders on l_orderkey = o_orderkey""",
    "done": "select * from lines where status = 'F'",
    "latest": "select max(order_date) d from heads where status = 'F'",
    "customers": """
        select c_custkey customer_id, c_mktsegment customer_type, n_name prefecture
        from customer left join nation on c_nationkey = n_nationkey""",
    "products": """
        select p_partkey sku_id, p_name product_name, p_type category, p_brand color,
               p_size size, cast(floor(p_retailprice * 0.6) as bigint) cost_price,
               p_name || ' ' || p_brand || '/' || cast(p_size as varchar) || '（'
                 || cast(p_partkey as varchar) || '）' label
        from part""",
    "touches": """
        select event_id session_id, ts date, user_id customer_id, event_type channel,
               event_type <> 'error' is_logged_in
        from events where event_type <> 'purchase'""",
    "sessions": """
        select t.*, customer_type from touches t left join customers using (customer_id)""",
    "purchases": """
        select event_id order_id, user_id customer_id, ts order_date,
               event_id * 7 % (select count(*) from part) sku_id, 1 + event_id % 3 quantity,
               cast(value as decimal(12,2)) total_amount
        from events where event_type = 'purchase'""",
    "touched": """
        select p.*, t.channel
        from purchases p asof left join touches t
          on p.customer_id = t.customer_id and p.order_date >= t.date""",
    "visits": """
        select o_orderkey session_id, o_custkey customer_id,
               cast(o_orderdate as date) - cast(o_orderkey % 10 as int) date,
               o_orderpriority channel, o_orderkey % 4 <> 0 is_logged_in
        from orders""",
    "visit_days": """
        select customer_id, date, arg_max(channel, session_id) channel
        from visits group by all""",
    "visited": """
        select p.*, t.channel
        from done p asof left join visit_days t
          on p.customer_id = t.customer_id and p.order_date >= t.date""",
    "behavior": """
        select cast(o_orderdate as date) date, sum(30 + o_orderkey % 40) sessions,
               sum(15 + o_orderkey % 20) product_page_views,
               sum(1 + o_orderkey % 6) add_to_cart,
               cast(floor(sum(o_orderkey % 5) * 1000 / count(*)) as decimal(10,0))
                 * 0.0001 bounce_rate
        from orders group by 1""",
    "ads": """
        select cast(ts as date) date, 'ch' || cast(user_id % 4 as varchar) channel,
               event_type cv_type,
               sum(case when event_type = 'click' then cast(value as decimal(12,2))
                   else 0 end) cost,
               count(*) filter (event_type = 'click') clicks,
               count(*) filter (event_type = 'purchase') conversions,
               sum(case when event_type = 'purchase' then cast(value as decimal(12,2))
                   else 0 end) revenue
        from events group by 1, 2, 3""",
    "order_ads": """
        select cast(o_orderdate as date) date, o_orderpriority channel,
               cast(sum(floor(o_totalprice / 20)) as bigint) cost,
               cast(sum(floor(o_totalprice)) as bigint) revenue
        from orders group by 1, 2""",
    "spend": """
        select cast(date_trunc('month', date) as date) as month,
               cast(sum(cost) as bigint) ad_spend
        from order_ads group by 1""",
    "plan": """
        select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority channel,
               cast(sum(floor(o_totalprice / 25)) as bigint) planned_cost
        from orders group by 1, 2""",
    "adjusted": """
        select *, cast(month || '-01' as date) month_start,
               cast(trunc(planned_cost * case channel when '1-URGENT' then 1.5::double
                 when '2-HIGH' then 0.7::double when '5-LOW' then 0::double
                 else 1::double end) as bigint) adjusted_cost
        from plan""",
    "inventory": """
        select cast(date_trunc('month', l_shipdate) as date) date, l_partkey sku_id,
               case when l_suppkey % 2 = 0 then '発送倉庫' else 'EC在庫倉庫' end
                 warehouse_type,
               case when l_suppkey % 2 = 0 then '関東発送倉庫' else '関東EC在庫倉庫' end
                 warehouse_name,
               (l_partkey * 7 + l_suppkey * 13
                 + month(date_trunc('month', l_shipdate)) * 5) % 120 stock_quantity,
               sum(case when l_returnflag = 'R' then cast(l_quantity as int) else 0 end)
                 inbound,
               sum(case when l_returnflag = 'R' then 0 else cast(l_quantity as int) end)
                 outbound
        from lineitem group by 1, 2, l_suppkey, 5""",
    "yearly_inventory": """
        select distinct cast(date_trunc('year', l_shipdate) as date) date, l_partkey sku_id,
               l_suppkey,
               case when l_suppkey % 2 = 0 then '発送倉庫' else 'EC在庫倉庫' end
                 warehouse_type,
               (l_partkey * 7 + l_suppkey * 13 + 5) % 120 stock_quantity
        from lineitem""",
    "campaigns": """
        select 'CMP' || lpad(cast(c_nationkey as varchar), 3, '0') campaign_id,
               'campaign ' || cast(c_nationkey as varchar) campaign_name,
               date '1995-02-01' + cast(c_nationkey * 91 + 17 as int) start_date,
               date '1995-02-01' + cast(c_nationkey * 91 + 17 + c_nationkey * 7 % 45 as int)
                 end_date,
               c_nationkey % 5 * 10 discount_rate,
               case when c_nationkey % 2 = 0 then '割引' else 'クーポン' end coupon_type,
               case when c_nationkey % 3 = 0 then '全カテゴリ' else 'PROMO' end
                 target_category,
               cast(sum(floor(c_acctbal)) as bigint) budget, count(*) * 1000 actual_spend
        from customer group by c_nationkey""",
    "windows": """
        select *, cast(end_date - start_date as int) nights from campaigns""",
    "expenses": """
        select strftime(m, '%Y-%m') as month, sales as 売上, pieces * 900 as 原価,
               n * 150 as 広告費, pieces * 20 as 倉庫代, n * 500 as 外注費,
               pieces * 35 as 物流費, sales // 50 as 決済手数料,
               cast(400000 as bigint) as システム費
        from (select date_trunc('month', l_shipdate) m,
                     cast(floor(sum(cast(l_extendedprice as decimal(12,2)))) as bigint) sales,
                     cast(sum(cast(l_quantity as int)) as bigint) pieces, count(*) n
              from lineitem group by 1)""",
    "pl": """
        select *, 売上 - total_cost operating_profit,
               round_even(cast(売上 - total_cost as double) / nullif(売上, 0) * 100, 1)
                 margin_pct
        from (select *, 原価 + 倉庫代 + 外注費 + 物流費 + 決済手数料 + システム費 total_cost
              from expenses)""",
    # New and repeat months of each customer.
    "cube": """
        select customer_id, cast(date_trunc('month', order_date) as date) as month,
               sum(total_amount) revenue, count(distinct order_id) orders,
               sum(quantity) pieces, sum(unit_price) price_sum, count(unit_price) prices
        from period group by all""",
    "flagged": """
        select *, case when month = min(month) over (partition by customer_id)
                       then '新規' else 'リピート' end flag
        from cube""",
    "flags": """
        select f.flag, coalesce(cast(sum(revenue) as double), 0) revenue,
               sum(revenue) money,
               cast(coalesce(sum(orders), 0) as bigint) orders,
               count(distinct customer_id) customers,
               cast(coalesce(sum(pieces), 0) as double) pieces,
               cast(coalesce(sum(price_sum), 0) as double) price_sum,
               cast(coalesce(sum(prices), 0) as double) prices
        from (values ('新規'), ('リピート')) f(flag) left join flagged using (flag)
        group by 1""",
    "account_lines": """
        select done.* from done join customers using (customer_id),
               (select max(order_date) d from heads)
        where customer_type = 'BUILDING' and order_date <= d
          and order_date >= greatest(date_trunc('month', d - interval 12 month),
                                     date '2000-10-15')""",
    # Demand history and its seasonal projection.
    "demand": """
        select category, cast(date_trunc('month', order_date) as date) as month,
               cast(sum(quantity) as bigint) qty
        from done join products using (sku_id) group by 1, 2""",
    "series": """
        select category series, month, qty y,
               row_number() over (partition by category order by month) - 1 x
        from demand""",
    "fit": """
        select *, (sy - slope * sx) / n intercept
        from (select series, count(*)::double n, sum(x)::double sx, sum(y)::double sy,
                     coalesce((count(*)::double * sum(x * y)::double
                       - sum(x)::double * sum(y)::double)
                       / nullif(count(*)::double * sum(x * x)::double
                         - sum(x)::double * sum(x)::double, 0), 0) slope,
                     max(month) last_month, max(x) last_x
              from series group by 1)""",
    "offsets": """
        select s.series, month(s.month) moy,
               (sum(y)::double - count(*)::double * intercept
                 - slope * sum(x)::double) / count(*)::double season
        from series s join fit using (series) group by 1, 2, intercept, slope""",
    "projected": """
        select f.series, cast(last_month + to_months(cast(i as int)) as date) as month,
               last_x + i x, intercept + slope * (last_x + i) + coalesce(season, 0) y
        from fit f cross join range(1, 7) r(i)
        left join offsets o on o.series = f.series
          and o.moy = month(last_month + to_months(cast(i as int)))""",
    "ahead": """
        select series category, month, cast(x as bigint) month_num,
               cast(trunc(greatest(y, 0)) as bigint) qty
        from projected""",
    "split": """
        select category, sku_id, product_name, color, size, month,
               greatest(1, cast(trunc(qty * share) as bigint)) qty
        from (select p.*, a.month, a.qty,
                     case when recent is null then 1.0::double / count(*) over w
                          when sum(recent) over w > 0
                            then recent::double / (sum(recent) over w)::double
                          else 0 end share
              from products p
              left join (select sku_id, sum(quantity) recent from done, latest
                         where order_date >= d - interval 6 month group by 1)
                using (sku_id)
              join ahead a using (category)
              window w as (partition by p.category, a.month))""",
    "replenish": """
        select *, case when core_move > 0 then date '2001-09-30' - 7
                    + cast((ship_stock + ec_stock) // greatest(1, demand // 30) as int)
                  end deadline,
               case when core_move > 0 then '基幹倉庫から移動'
                    when shortage > 0 then 'EC在庫倉庫から移動' else '在庫十分' end status
        from (select *, greatest(0, demand - ship_stock) shortage,
                     least(greatest(0, demand - ship_stock), ec_stock) transfer,
                     greatest(0, demand - ship_stock - ec_stock) core_move
              from (select sku_id, product_name, category, color, size,
                           greatest(1, cast(trunc(qty / n) as bigint)) demand,
                           cast(coalesce(ship, 0) as bigint) ship_stock,
                           cast(coalesce(ec, 0) as bigint) ec_stock
                    from products
                    join (select category, arg_min(qty, month) qty from ahead group by 1)
                      using (category)
                    join (select category, count(*) n from products group by 1)
                      using (category)
                    left join (select sku_id,
                                      sum(stock_quantity)
                                        filter (warehouse_type = '発送倉庫') ship,
                                      sum(stock_quantity)
                                        filter (warehouse_type = 'EC在庫倉庫') ec
                               from yearly_inventory
                               where date = (select max(date) from yearly_inventory)
                               group by 1) using (sku_id)))""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` under the expressions it names; ``extra`` adds some of its own."""
    known = {**_ROLES, **extra}
    needed: dict[str, str] = {}

    def need(text):
        for name in known:
            if name not in needed and re.search(rf"(?:from|join|,)\s+{name}\b", text):
                needed[name] = ""  # reserve, in case of a table of the same name
                need(known[name])
                del needed[name]
                needed[name] = known[name]
    need(body)
    parts = ",\n".join(f"{name} as ({text.strip()})" for name, text in needed.items())
    return f"with {parts}\n{body.strip()}" if parts else body.strip()


def ratio(n: str, d: str) -> str:
    return f"coalesce(cast({n} as double) / nullif({d}, 0), 0)"
