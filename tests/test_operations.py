from datetime import date as D

import pytest

from tests.conftest import rows
from tillscope import schemas as S
from tillscope.plans import accounts as A
from tillscope.plans import inventory as I
from tillscope.plans import pl as L
from tillscope.plans import projection as P
from tillscope.plans import replenishment as R
from tillscope.plans.sales import monthly_sales
from tillscope.sources.tables import rename_warehouses

SHIP, EC = S.SHIPPING_WAREHOUSE, S.EC_WAREHOUSE


@pytest.fixture(scope="module")
def stock(spark):
    return spark.createDataFrame([
        (D(2026, 3, 1), "s1", SHIP, "w", 99, 1, 50),     # too old for turnover
        (D(2026, 4, 1), "s1", SHIP, "w", 20, 5, 6),
        (D(2026, 9, 1), "s1", SHIP, "w", 14, 1, 2),
        (D(2026, 9, 1), "s1", EC, "e", 3, 0, 4),
        (D(2026, 9, 1), "s2", SHIP, "w", 15, 0, 0),      # not below 15
        (D(2026, 9, 1), "s3", SHIP, "w", 0, 0, 9),
        (D(2026, 9, 1), "s9", SHIP, "w", 1, 7, 7),       # unknown SKU
        (D(2026, 9, 1), "s4", EC, "e", 40, 0, 0),        # EC warehouse only
    ], S.TABLES["wms_inventory"])


def test_inventory(tables, stock):
    products = tables["products"]
    flow = rows(I.inventory_flow(stock, products).where("date = '2026-09-01'"))
    assert flow == [(D(2026, 9, 1), "トップス", 32, 1, 6, -6),
                    (D(2026, 9, 1), "ボトムス", 0, 0, 9, -9),
                    (D(2026, 9, 1), "小物", 40, 0, 0, 0)]
    ec = I.inventory_flow(stock, products, EC).collect()
    assert [(r.category, r.stock) for r in ec] == [("トップス", 3), ("小物", 40)]
    turn = {r.category: r for r in I.inventory_turnover(stock, products).collect()}
    # Rows from April on: stock 20 + 14 + 3 + 15 over 4 rows, outbound 12.
    assert (turn["トップス"].mean_stock_per_row, turn["トップス"].turnover) == (13, 0.92)
    assert turn["ボトムス"].turnover is None and turn["小物"].turnover == 0
    low = rows(I.low_stock(stock, products), "sku_id", "stock_quantity", "product_name")
    assert low == [("s3", 0, "パンツ"), ("s9", 1, None), ("s1", 14, "シャツ")]
    assert len(rows(I.low_stock(stock, products, k=2))) == 2


def test_warehouse_names(spark):
    old = spark.createDataFrame([(None, "s", "マザー倉庫", "関東マザー倉庫", 1, 0, 0)],
                                S.TABLES["wms_inventory"])
    assert rows(rename_warehouses(old), "warehouse_type", "warehouse_name") == [
        ("EC在庫倉庫", "関東EC在庫倉庫")]


# ── profit and loss ─────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def expenses(spark):
    return spark.createDataFrame([
        ("2026-03", 1000, 400, 999, 10, 20, 30, 40, 100),   # newest, not last in order
        ("2026-01", 0, 5, 1, 0, 0, 0, 0, 0),                # no revenue
        ("2026-02", 800, 300, 1, None, 20, 30, 40, 50)],
        S.TABLES["monthly_expenses"])


def test_profit_and_loss(expenses):
    pl = L.monthly_pl(expenses)
    got = {r.month: r for r in pl.collect()}
    assert (got["2026-03"].total_cost, got["2026-03"].operating_profit) == (600, 400)
    assert got["2026-03"].margin_pct == 40 and got["2026-01"].margin_pct is None
    assert got["2026-02"].total_cost == 440
    newest = L.latest_month_pl(pl).first()
    assert (newest.month, newest.cogs_pct) == ("2026-03", 40)
    assert L.cost_breakdown(expenses).count() == 18
    shares = L.latest_cost_shares(expenses).collect()
    assert {r.month for r in shares} == {"2026-03"}
    assert sum(r.share for r in shares) == pytest.approx(1)


def test_pl_matrix(expenses):
    pl = L.monthly_pl(expenses)
    assert L.month_window(pl, 2) == ["2026-02", "2026-03"]
    assert L.month_window(pl, 2, 0) == ["2026-01", "2026-02"]
    assert L.month_window(pl, 12) == ["2026-01", "2026-02", "2026-03"]
    matrix = L.pl_matrix(pl, L.month_window(pl, 2)).collect()
    assert matrix[0].asDict() == {"item": "売上", "2026-02": 800, "2026-03": 1000}
    assert [r.item for r in matrix][-3:] == ["total_cost", "operating_profit", "margin_pct"]
    wide = L.pl_matrix(pl, L.month_window(pl))
    back = wide.unpivot(["item"], ["2026-01", "2026-02", "2026-03"], "month", "v")
    assert back.where("item = '売上'").selectExpr("sum(v)").first()[0] == 1800


# ── corporate accounts ──────────────────────────────────────────────────────


def test_accounts(tables):
    orders, customers, products = tables["orders"], tables["customers"], tables["products"]
    lines = A.account_lines(orders, customers)    # launch 15 June clamps the six months
    assert sorted({r.order_id for r in lines.collect()}) == ["o3", "o4", "o9"]
    kpi = A.account_kpis(lines).first()
    assert (kpi.accounts, kpi.revenue, kpi.orders) == (2, 750, 3)
    assert (kpi.revenue_per_account, kpi.orders_per_account) == (375, 1.5)
    late = A.account_lines(orders, customers, launch="2027-01-01")
    assert A.account_kpis(late).first().revenue_per_account == 0
    table = rows(A.account_summary(lines), "customer_id", "last_order", "order_count",
                 "total_quantity", "total_amount")
    # Product P1 has two SKU rows; amounts are not multiplied by them.
    assert table == [("c2", D(2026, 8, 20), 2, 5, 700), ("c4", D(2026, 6, 15), 1, 1, 50)]
    assert rows(A.account_category_summary(lines, products)) == [
        ("c2", "トップス", 4, 400), ("c2", "ボトムス", 1, 300), ("c4", "トップス", 1, 50)]
    assert rows(A.account_order_lines(lines, products), "order_id", "product_name") == [
        ("o4", "シャツ"), ("o3", "パンツ"), ("o9", "シャツ")]
    # Code points of "c2" add up to 149: 149 % 3 = 2 and 149 % 30 = 29.
    names = dict(rows(A.account_summary(lines, sort_by="account_name"),
                      "customer_id", "account_name"))
    assert names["c2"] == "合同会社遠藤製作"
    assert rows(A.account_summary(lines, " 遠藤|無 "), "customer_id") == [("c2",)]
    for key in A.SORTS:
        assert A.account_summary(lines, sort_by=key).count() == 2


# ── projection and replenishment ────────────────────────────────────────────


@pytest.fixture(scope="module")
def year(spark):
    """Thirteen months of two categories; April is missing for bottoms."""
    out = []
    for i in range(13):
        day = D(2025 + i // 12, i % 12 + 1, 15)
        out.append((f"a{i}", "c1", "P1", "s1", day, "完了", 10 + i, 1, 100 * (10 + i)))
        if i != 3:
            out.append((f"b{i}", "c1", "P2", "s3", day, "完了", 7, 1, 70))
    out.append(("z", "c1", "P3", "s4", D(2026, 1, 1), "完了", 1, 1, 1))  # one month only
    return spark.createDataFrame(out, S.TABLES["ec_orders"])


@pytest.fixture(scope="module")
def ads(spark):
    return spark.createDataFrame([(D(2025, 1, 1), "a", "x", 100, 1, 1, 1),
                                  (D(2025, 2, 1), "a", "x", 300, 1, 1, 1)],
                                 S.TABLES["ad_performance"])


def test_features(tables, year, ads):
    history = P.category_monthly_quantity(year, tables["products"], 6)
    assert {r.category for r in history.collect()} == {"トップス", "ボトムス"}
    present = P.month_index(history, "category").where("category = 'ボトムス'")
    calendar = P.month_index(history, "category", calendar=True).where("category = 'ボトムス'")
    assert max(r.month_num for r in present.collect()) == 11
    assert max(r.month_num for r in calendar.collect()) == 12
    ahead = P.future_months(present, "category", 3)
    assert sorted(rows(ahead, "month", "month_num")) == [
        (D(2026, 2, 1), 12), (D(2026, 3, 1), 13), (D(2026, 4, 1), 14)]
    flags = P.month_flags(ahead).where("month = '2026-02-01'").first()
    assert [flags[f"m_{m}"] for m in range(1, 13)] == [0, 1] + [0] * 10
    mean = P.mean_monthly_ad_spend(ads).scalar()
    spend = P.with_ad_spend(present, P.monthly_ad_spend(ads), mean)
    assert {r.month: r.ad_spend for r in spend.collect()}[D(2025, 2, 1)] == 300
    assert {r.month: r.ad_spend for r in spend.collect()}[D(2025, 3, 1)] == 200
    from pyspark.sql import functions as F
    cut = P.drop_partial_month(history, F.lit("2026-01-15").cast("date"))
    assert max(r.month for r in cut.collect()) == D(2025, 12, 1)


def test_seasonal_projection(tables, year):
    got = P.demand_projection(year, tables["products"], horizon=3, method="seasonal")
    table = {(r.category, r.month): r.qty for r in got.collect()}
    assert len(table) == 6 and all(q >= 0 for q in table.values())
    assert [table["トップス", D(2026, m, 1)] for m in (2, 3, 4)] in ([23, 24, 25], [22, 23, 24])
    sales = P.sales_projection(year, method="seasonal").collect()
    assert [r.month for r in sales] == [D(2026, m, 1) for m in range(2, 8)]
    assert all(r.lower == r.sales * 0.7 and r.upper == r.sales * 1.3 for r in sales)


def test_tree_projection(tables, year, ads):
    model = P.fit_demand(year, tables["products"], ads, trees=3)
    first = rows(model.project(4))
    assert len(first) == 8 and all(isinstance(r[3], int) and r[3] >= 0 for r in first)
    assert first == rows(P.fit_demand(year, tables["products"], ads, trees=3).project(4))
    plan = year.sparkSession.sql("select date'2026-02-01' as month, 300.0D as ad_spend")
    assert len(rows(model.project(4, plan))) == 8
    sales = P.sales_projection(year, horizon=2, trees=2).collect()
    assert [r.month for r in sales] == [D(2026, 2, 1), D(2026, 3, 1)]


def test_scenarios_differ_where_demand_follows_spending(spark, tables, year):
    from tillscope.plans import ads as A2
    months = [D(2023 + m // 12, m % 12 + 1, 1) for m in range(36)]
    spent = [100 + 400 * (m * 7 % 5 > 2) for m in range(36)]
    ads = spark.createDataFrame(
        [(d, "c", "t", s, 1, 1, 1) for d, s in zip(months, spent)],
        "date date, channel string, cv_type string, cost long, clicks long, conversions long, "
        "revenue long")
    lines = spark.createDataFrame(  # ten pieces a month, and one more for every ten spent
        [(f"o{i}", d, "s1", 10 + s // 10) for i, (d, s) in enumerate(zip(months, spent))],
        "order_id string, order_date date, sku_id string, quantity int")
    model = P.fit_demand(lines, tables["products"], ads, trees=20)
    plan = spark.createDataFrame(
        [(f"2026-{m:02}", c, 250) for m in (1, 2, 3) for c in ("a", "b")],
        "month string, channel string, planned_cost long")
    factors = spark.createDataFrame(
        [("less", "a", 0.2), ("less", "b", 0.2), ("less", "b", 0.1), ("one", "b", 1.0),
         ("same", None, 5.0), (None, "a", 9.0), ("gone", "a", None)],
        "scenario string, channel string, factor double")
    totals = A2.plan_scenarios(plan, factors)
    assert {(r.scenario, r.planned, r.adjusted, r.delta) for r in totals.collect()} == {
        ("less", 500, 100, -400), ("one", 500, 500, 0), ("same", 500, 500, 0)}
    spend = totals.selectExpr("scenario", "month_start as month", "adjusted as ad_spend")
    got = rows(model.scenarios(spend, 4), "scenario", "month", "ad_spend", "qty", "delta")
    assert [g[:2] for g in got] == [(s, D(2026, m, 1)) for s in ("less", "one", "same")
                                    for m in (1, 2, 3, 4)]
    by = {g[:2]: g[2:] for g in got}
    usual = {r.month: r.qty for r in model.project(4).collect()}
    assert all(q - usual[m] == delta for (_, m), (_, q, delta) in by.items())
    for m in (1, 2, 3):
        assert by["less", D(2026, m, 1)][1] + 20 < by["one", D(2026, m, 1)][1]
        assert by["one", D(2026, m, 1)] == by["same", D(2026, m, 1)]
    mean = sum(spent) / len(spent)
    assert by["less", D(2026, 4, 1)] == (mean, usual[D(2026, 4, 1)], 0)  # not in the plan
    assert rows(A2.plan_scenarios(plan.limit(0), factors)) == []
    assert rows(A2.plan_scenarios(plan, factors.limit(0))) == []
    assert rows(model.scenarios(spend.limit(0), 4)) == []


def test_actual_projection_table(year):
    sales = P.sales_projection(year, 2, "seasonal")
    table = P.actual_projection_table(monthly_sales(year), sales, "2024-12-01", "2025-01-01")
    got = rows(table, "label", "kind", "sales", "lower")
    assert got[0] == ("2024/12", "実績", "—", "—") and got[1][2] == "¥1,070"
    assert [g[0] for g in got[2:]] == ["2026/02", "2026/03"] and got[2][1] == "予測"
    side = P.months_as_columns(table, ["2024/12", "2025/01", "2026/02"])
    kinds = side.where("item = 'kind'").first()
    assert (kinds["2025/01"], kinds["2026/02"]) == ("実績", "予測")


def projection(spark, **qty):
    return spark.createDataFrame(
        [(c, D(2026, 10, 1), 0, q) for c, q in qty.items()]
        + [(c, D(2026, 11, 1), 1, 5 * q) for c, q in qty.items()],
        "category string, month date, month_num long, qty long")


def test_sku_demand_split(spark, tables):
    lines = spark.createDataFrame([
        ("a", "c", "P1", "s1", D(2026, 9, 30), "完了", 3, 1, 1),
        ("b", "c", "P1", "s2", D(2026, 3, 30), "完了", 1, 1, 1),    # just inside six months
        ("c", "c", "P1", "s2", D(2026, 3, 29), "完了", 50, 1, 1)], S.TABLES["ec_orders"])
    split = P.sku_demand_split(projection(spark, トップス=10, 小物=9, ボトムス=0), lines,
                               tables["products"])
    got = {(r.sku_id, r.month.month): r.qty for r in split.collect()}
    assert (got["s1", 10], got["s2", 10]) == (7, 2)       # 3/4 and 1/4 of ten, cut
    assert got["s4", 11] == 45 and got["s3", 10] == 1     # no sales: equal share, at least 1
    assert {r.sku_id: r.total for r in split.collect()}["s1"] == 7 + 37
    assert dict(rows(P.category_demand_total(split)))["小物"] == 54
    wide = P.sku_demand_matrix(split, ["2026/10", "2026/11"])
    assert {r.sku_id: (r["2026/10"], r["2026/11"]) for r in wide.collect()}["s4"] == (9, 45)


def test_replenishment(spark, tables, stock):
    plan = R.replenishment_plan(projection(spark, トップス=61, ボトムス=90, 小物=30),
                                tables["products"], stock, "2026-09-30")
    got = {r.sku_id: r for r in plan.collect()}
    s1, s2, s3, s4 = (got[f"s{i}"] for i in range(1, 5))
    assert (s1.demand, s1.shortage, s1.transfer, s1.core_move) == (30, 16, 3, 13)
    assert s1.deadline == D(2026, 10, 10)                 # 17 days of stock less 7
    assert (s2.core_move, s2.status) == (15, S.MOVE_FROM_CORE)
    assert (s3.demand, s3.deadline) == (90, D(2026, 9, 23))
    assert (s4.shortage, s4.transfer, s4.status, s4.deadline) == (30, 30, S.MOVE_FROM_EC, None)
    assert all(r.shortage == r.transfer + r.core_move for r in got.values())
    kpi = R.replenishment_kpis(plan).first()
    assert (kpi.enough_skus, kpi.transfer_skus, kpi.core_skus, kpi.core_units) == (0, 1, 3, 118)
    alerts = rows(R.replenishment_alerts(plan, "2026-09-30"))
    assert alerts == [("ボトムス", 1, 90, D(2026, 9, 23), "critical"),
                      ("トップス", 2, 28, D(2026, 10, 8), "critical")]
    earlier = R.replenishment_alerts(plan, "2026-09-15")
    assert rows(earlier, "level") == [("critical",), ("warning",)]
    assert rows(R.shipping_shortages(plan), "sku_id")[0] == ("s3",)
    assert rows(R.ec_transfers(plan), "sku_id") == [("s4",)]
    assert rows(R.core_moves(plan), "sku_id") == [("s3",), ("s2",), ("s1",)]
