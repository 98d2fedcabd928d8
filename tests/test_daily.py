"""Daily rows in place of lines: the same results, additive over batches, dates without a scan."""

import re
from datetime import date as D

import pytest

from tests.conftest import rows
from tillscope.bindings.sales_queries import kept_days, kept_days_baskets, kept_days_breakdowns
from tillscope.operators.periods import date_range, trailing_period
from tillscope.plans import sales as A
from tillscope.plans import visitors as V
from tillscope.plans.daily import DailySales, daily_sales

BEHAVIOR = "date date, sessions long, product_page_views long, add_to_cart long, bounce_rate double"
SESSIONS = "customer_id string, customer_type string, date date, is_logged_in boolean"


@pytest.fixture(scope="module")
def lines(spark, tables):
    """Completed lines, with some odd ones: without order, SKU, amount or date."""
    odd = spark.createDataFrame([
        (None, "c1", "P1", "s1", D(2026, 8, 2), "完了", 7, 10, 70),
        (None, None, "P1", "s1", D(2026, 8, 2), "完了", 7, 10, 70),
        ("p1", "c2", "P1", None, D(2026, 8, 4), "完了", 1, None, 5),
        ("p1", "c2", "P1", "s1", D(2026, 8, 4), "完了", 1, 4, None),
        ("p2", "c4", "P2", "s3", None, "完了", 2, 6, 12)], tables["orders"].schema)
    return A.completed(tables["orders"].unionByName(odd)).cache()


@pytest.fixture(scope="module")
def kept(spark, lines, tmp_path_factory):
    store = DailySales(spark, str(tmp_path_factory.mktemp("days") / "kept"))
    cut = "order_date < date '2026-08-03'"
    store.add("late", lines.where(f"not ({cut}) or order_date is null"))
    store.add("early", lines.where("order_id = 'o1'"))  # replaced by the next
    store.add("early", lines.where(cut))
    store.add("none", lines.where("false"))
    return store


ANALYSES = {
    "kpis": lambda o, t: A.revenue_kpis(o),
    "estimates": lambda o, t: A.revenue_kpis(o, rsd=0.01),
    "trailing": lambda o, t: A.trailing_kpis(o),
    "month before": lambda o, t: A.period_comparison(o, "previous_month"),
    "year before": lambda o, t: A.period_comparison(o, "previous_year"),
    "no base": lambda o, t: A.period_comparison(o, None),
    "new and repeat": lambda o, t: A.new_repeat_monthly(o),
    "lifetime": lambda o, t: A.new_repeat_monthly(trailing_period(o, "order_date", 2), o),
    "shares": lambda o, t: A.new_repeat_share(o),
    "tree": lambda o, t: A.revenue_tree(o, t["behavior"]),
    "baskets": lambda o, t: A.basket_stats(o),
    "repeaters": lambda o, t: A.repeat_purchase_rate(o),
    "funnel": lambda o, t: A.purchase_funnel(o, t["behavior"]),
    "types": lambda o, t: A.sales_by_customer_type(o, t["customers"]),
    "regions": lambda o, t: A.sales_by_region(o, t["customers"]),
    "categories": lambda o, t: A.sales_by_category(o, t["products"]),
    "ranking": lambda o, t: A.sku_ranking(o, t["products"]),
    "skus": lambda o, t: A.sku_count(o),
    "first": lambda o, t: A.first_purchase(o),
    "weekdays": lambda o, t: A.sales_by_weekday(o),
    "weekdays by day": lambda o, t: A.sales_by_weekday(o, per_day=True),
    "months": lambda o, t: A.monthly_sales(o),
    "category months": lambda o, t: A.category_monthly_sales(o, t["products"]),
    "range": lambda o, t: A.data_range(o),
    "visitors": lambda o, t: V.segment_visitor_value(
        t["sessions"], o, t["customers"], "2026-06-01", "2026-08-31", ("個人", "法人")),
    "visitors by month": lambda o, t: V.segment_visitor_value_monthly(
        t["sessions"], o, t["customers"], ("個人", "法人")),
}


@pytest.fixture(scope="module")
def others(spark, tables):
    behavior = [(D(2026, 8, 1), 100, 50, 20, 0.5), (D(2026, 8, 2), 31, 9, 4, 0.25)]
    sessions = [("c1", "個人", D(2026, 8, 1), True), ("c2", "法人", D(2026, 7, 1), True)]
    return {**tables, "behavior": spark.createDataFrame(behavior, BEHAVIOR),
            "sessions": spark.createDataFrame(sessions, SESSIONS)}


@pytest.mark.parametrize("name", ANALYSES)
def test_daily_rows_give_what_lines_give(lines, kept, others, name):
    for some in ("true", "order_date >= date '2026-08-01'", "false"):
        from_lines = ANALYSES[name](lines.where(some), others)
        from_days = ANALYSES[name](kept.rows().where(some), others)
        assert from_days.columns == from_lines.columns
        assert sorted(map(str, rows(from_days))) == sorted(map(str, rows(from_lines))), some


def test_one_row_for_each_key(lines):
    days = daily_sales(lines)
    keys = rows(days, "order_date", "sku_id", "customer_id")
    assert len(keys) == len(set(keys)) == lines.select(
        "order_date", "sku_id", "customer_id").distinct().count()
    assert days.agg({"lines": "sum"}).first()[0] == lines.count()
    assert days.agg({"orders": "sum"}).first()[0] == lines.where(
        "order_id is not null").select("order_id").distinct().count()


def test_lines_without_order_or_customer_do_not_meet_in_one_task(spark):
    many = spark.range(2_000).selectExpr(
        "if(id < 0, 'o', null) order_id", "if(id < 0, 'c', null) customer_id", "id as sku_id",
        "date '2026-01-01' order_date", "1 quantity", "1 unit_price", "1 total_amount")
    plan = daily_sales(many)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(order_id#\d+, customer_id#\d+, _w\d+", plan)  # with the salt


def test_dates_come_from_the_noted_facts_alone(lines, kept):
    assert rows(kept.dates()) == [(D(2025, 8, 10), D(2026, 8, 31), lines.count())]
    assert all("/dates/" in f for f in kept.dates().inputFiles())
    recent = trailing_period(kept.rows(), "order_date", 1, kept.latest())
    scans = [x for x in recent._jdf.queryExecution().optimizedPlan().toString().split("\n")
             if "Relation" in x]
    assert len([x for x in scans if "customer_id" in x]) == 1
    assert all("first_date" in x for x in scans if "customer_id" not in x)
    assert rows(A.revenue_kpis(recent)) == rows(A.revenue_kpis(trailing_period(
        lines, "order_date", 1)))


def test_days_are_pushed_to_the_scan(kept):
    cut = date_range(kept.rows(), "order_date", "2026-08-01", "2026-08-31").select("orders")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_date" in plan
    assert "total_amount" not in plan.split("ReadSchema")[1]


def test_lines_meet_their_heads_once_for_all_deliveries(spark, tmp_path, monkeypatch):
    spark.range(1, 8).selectExpr(
        "id o_orderkey", "id % 3 o_custkey", "'F' o_orderstatus", "1D o_totalprice", "'x' o_orderpriority",
        "make_timestamp_ntz(1991 + cast(id as int), 5, 1, 0, 0, 0) o_orderdate",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(28).selectExpr(
        "1 + id % 7 l_orderkey", "id l_partkey", "2D l_quantity", "5D l_extendedprice",
        "0D l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    leaves, add, held = [], DailySales.add, spark.sparkContext._jsc.getPersistentRDDs

    def noted(self, batch, orders):
        found = orders._jdf.queryExecution().optimizedPlan().collectLeaves()
        leaves.append([found.apply(i).nodeName() for i in range(found.size())])
        add(self, batch, orders)

    monkeypatch.setattr(DailySales, "add", noted)
    before = held().size()
    days = kept_days(spark, str(tmp_path))
    assert leaves == [["InMemoryRelation"]] * 4
    assert held().size() == before
    assert rows(days.dates()) == [(D(1992, 5, 1), D(1998, 5, 1), 28)]
    per_day = days.rows().groupBy("order_date").agg({"orders": "sum", "lines": "sum"})
    assert sorted(rows(per_day, "order_date", "sum(orders)", "sum(lines)")) == [
        (D(1991 + i, 5, 1), 1, 4) for i in range(1, 8)]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Orders 1 to 3 in 1993, 1995 and 1997, each with one line of SKU 1 and one of SKU 2; the
    last two are one customer's. Order 4 is not completed."""
    folder = tmp_path_factory.mktemp("shop")
    for name, frame in {
        "orders": spark.range(1, 5).selectExpr(
            "id o_orderkey", "if(id = 1, 1L, 2L) o_custkey", "if(id < 4, 'F', 'O') o_orderstatus",
            "1D o_totalprice", "'x' o_orderpriority",
            "make_timestamp_ntz(1991 + 2 * cast(id as int), 5, 1, 0, 0, 0) o_orderdate"),
        "lineitem": spark.range(8).selectExpr(
            "1 + id div 2 l_orderkey", "1 + id % 2 l_partkey", "2D l_quantity",
            "10D * (1 + id div 2) l_extendedprice", "0D l_discount"),
        "customer": spark.range(1, 3).selectExpr(
            "id c_custkey", "'c' c_name", "cast(id as int) c_nationkey", "0D c_acctbal",
            "if(id = 1, 'MACHINERY', 'BUILDING') c_mktsegment"),
        "nation": spark.range(1, 3).selectExpr(
            "cast(id as int) n_nationkey", "if(id = 1, 'PERU', 'CHINA') n_name", "0 n_regionkey"),
        "part": spark.range(1, 3).selectExpr(
            "id p_partkey", "concat('p', id) p_name", "'b' p_brand", "concat('t', id) p_type",
            "1 p_size", "1D p_retailprice")}.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def delivered(monkeypatch):
    """The leaves of the plan of each delivery, as they are taken in."""
    leaves, add = [], DailySales.add

    def noted(self, batch, orders):
        found = orders._jdf.queryExecution().optimizedPlan().collectLeaves()
        leaves.append([found.apply(i).nodeName() for i in range(found.size())])
        add(self, batch, orders)

    monkeypatch.setattr(DailySales, "add", noted)
    return leaves


def test_breakdowns_meet_heads_once_and_read_the_kept_days_alone(spark, shop, delivered):
    found = kept_days_breakdowns(spark, shop)
    assert delivered == [["InMemoryRelation"]] * 4
    assert not any("lineitem" in f or "orders" in f for f in found.inputFiles())
    assert sorted(r for r in rows(found) if r[0] != "sku") == [
        ("category", "t1", 60.0), ("category", "t2", 60.0), ("region", "CHINA", 100.0),
        ("region", "PERU", 20.0), ("type", "BUILDING", 100.0), ("type", "MACHINERY", 20.0)]
    assert [r[2] for r in rows(found) if r[0] == "sku"] == [60.0, 60.0]


def test_baskets_meet_heads_once_and_read_the_kept_days_alone(spark, shop, delivered):
    found = kept_days_baskets(spark, shop)
    assert delivered == [["InMemoryRelation"]] * 4
    assert not any("lineitem" in f or "orders" in f for f in found.inputFiles())
    sides = {r["flag"]: (r["pieces_per_order"], float(r["aov"])) for r in found.collect()}
    assert sides == {"新規": (4.0, 40.0), "リピート": (4.0, 60.0)}
