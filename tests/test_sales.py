from datetime import date as D

import pytest

from tests.conftest import rows
from tillscope import schemas as S
from tillscope.operators.periods import trailing_period
from tillscope.plans import sales as A
from tillscope.plans import visitors as V


@pytest.fixture(scope="module")
def done(tables):
    return A.completed(tables["orders"])


@pytest.fixture(scope="module")
def period(done):
    """Six months up to 2026-08-31: everything but last year's order."""
    return trailing_period(done, "order_date", 6)


def test_kpis(done, period):
    assert rows(A.data_range(done)) == [(D(2025, 8, 10), D(2026, 8, 31))]
    kpi = A.revenue_kpis(period).first()
    assert (kpi.revenue, kpi.orders, kpi.customers) == (1570, 7, 4)
    assert kpi.aov == 1570 / 7
    none = A.revenue_kpis(period.where("false")).first()
    assert (none.revenue, none.orders, none.aov) == (0, 0, 0)
    assert A.revenue_kpis(period, rsd=0.05).first().customers == 4


def test_trailing_kpis_equal_single_periods(done):
    got = {r.months: (r.revenue, r.orders) for r in A.trailing_kpis(done).collect()}
    for m in (1, 3, 6, 12):
        kpi = A.revenue_kpis(trailing_period(done, "order_date", m)).first()
        assert got[m] == (kpi.revenue, kpi.orders)
    assert got[12][0] == got[6][0] + 250


def test_period_comparison(done):
    month = {r.measure: r for r in A.period_comparison(done).collect()}
    assert (month["revenue"].current, month["revenue"].base) == (1100, 0)
    assert month["revenue"].change_pct is None and month["revenue"].is_up
    year = {r.measure: r for r in A.period_comparison(done, "previous_year").collect()}
    assert (year["revenue"].current, year["revenue"].base) == (1100, 250)
    assert year["revenue"].change_pct == (1100 - 250) / 250 * 100
    assert (year["orders"].current, year["customers"].current) == (4, 2)
    alone = {r.measure: r for r in A.period_comparison(done, None).collect()}
    assert alone["revenue"].base == 0 and alone["revenue"].change_pct is None


def test_like_for_like_cuts_the_base(spark):
    lines = spark.createDataFrame(
        [("a", "c", D(2026, 5, 10), 10), ("b", "c", D(2026, 4, 10), 5),
         ("d", "c", D(2026, 4, 11), 7)],
        "order_id string, customer_id string, order_date date, total_amount long")
    full = A.period_comparison(lines).where("measure = 'revenue'").first()
    cut = A.period_comparison(lines, like_for_like=True).where("measure = 'revenue'").first()
    assert (full.base, cut.base) == (12, 5)


def test_order_size_segment(tables):
    got = dict(rows(A.order_size_segment(tables["orders"])))
    assert got["o1"] == S.ESTIMATED_BUSINESS and got["o4"] == S.ESTIMATED_INDIVIDUAL


def test_new_and_repeat(period, done):
    got = rows(A.new_repeat_monthly(period), "month", "total", "new", "repeat")
    # August: c2 is new with both orders, c1 repeats, the unknown buyer counts as repeat.
    assert got == [(D(2026, 6, 1), 470, 470, 0), (D(2026, 8, 1), 1100, 700, 400)]
    # Over the whole history c4 is not new in June.
    life = rows(A.new_repeat_monthly(period, history=done), "month", "new", "repeat")
    assert life == [(D(2026, 6, 1), 420, 50), (D(2026, 8, 1), 700, 400)]
    share = {r.flag: r for r in A.new_repeat_share(period).collect()}
    assert share[S.NEW].revenue + share[S.REPEAT].revenue == 1570
    assert share[S.NEW].share_pct + share[S.REPEAT].share_pct == pytest.approx(100)
    empty = A.new_repeat_share(period.where("false")).collect()
    assert [(r.revenue, r.share_pct) for r in empty] == [(0, 0), (0, 0)]


def test_revenue_tree_and_basket(spark, period):
    site = spark.createDataFrame([
        (D(2026, 8, 1), 60, 30, 12, 0.4), (D(2026, 8, 2), 41, 20, 8, 0.6)],
        S.TABLES["ga_behavior"])
    tree = {r.flag: r for r in A.revenue_tree(period, site).collect()}
    new, rep = tree[S.NEW], tree[S.REPEAT]
    assert (new.orders, rep.orders, new.customers, rep.customers) == (5, 2, 4, 1)
    assert (new.sessions, rep.sessions) == (72, 29)  # 101 * 5 / 7 cut to 72
    assert rep.frequency == 2 and new.cvr == 5 / 72 and new.overall_cvr == 7 / 101
    basket = {r.flag: r for r in A.basket_stats(period).collect()}
    assert basket[S.NEW].pieces_per_order == (5 + 1 + 4 + 1 + 1) / 5
    assert basket[S.NEW].mean_unit_price == (100 + 50 + 300 + 100 + 70 + 50) / 6
    assert basket[S.NEW].aov_gap == 400 / 2 - 1170 / 5
    funnel = rows(A.purchase_funnel(period, site), "stage", "n", "pct_of_sessions",
                  "mean_bounce_rate")
    assert [r[1] for r in funnel] == [101, 50, 20, 7]
    assert funnel[0][2] == 100 and funnel[3][3] == 0.5
    none = A.revenue_tree(period.where("false"), site).collect()
    assert [(r.sessions, r.cvr) for r in none] == [(0, 0), (101, 0)]


def test_repeat_purchase_rate(period):
    assert rows(A.repeat_purchase_rate(period)) == [(4, 2, 0.5)]


def test_breakdowns_drop_unknown_keys(tables, period):
    customers, products = tables["customers"], tables["products"]
    assert sorted(rows(A.sales_by_customer_type(period, customers))) == [
        ("個人", 650), ("法人", 750)]
    assert rows(A.sales_by_region(period, customers)) == [("大阪", 700), ("東京", 650)]
    assert sorted(rows(A.sales_by_category(period, products))) == [
        ("トップス", 900), ("ボトムス", 600)]
    assert rows(A.sku_ranking(period, products, 2), "sku_id", "revenue", "label") == [
        ("s1", 700, "シャツ 白/M（s1）"), ("s3", 600, "パンツ 黒/M（s3）")]
    assert A.sku_count(period).first().skus == 4
    assert rows(A.category_monthly_sales(period, products)) == [
        (D(2026, 6, 1), "トップス", 400), (D(2026, 8, 1), "トップス", 500),
        (D(2026, 8, 1), "ボトムス", 600)]
    assert rows(A.monthly_sales(period)) == [(D(2026, 6, 1), 470), (D(2026, 8, 1), 1100)]


def test_weekdays_start_on_monday(period):
    days = rows(A.sales_by_weekday(period), "weekday", "mean_amount")
    assert [d for d, _ in days] == list(S.WEEKDAYS)
    # Mondays: 15 June 50, 1 June 70, 3 August 300, 31 August 300 and 100.
    assert days[0][1] == 820 / 5 and days[2][1] is None
    assert rows(A.sales_by_weekday(period, True), "mean_amount")[0][0] == 820 / 4


def test_first_purchase(done):
    assert dict(rows(A.first_purchase(done)))["c4"] == D(2025, 8, 1)


# ── visitors ────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def sessions(spark):
    from datetime import datetime as T
    return spark.createDataFrame([
        (T(2026, 8, 1, 9), "c1", "個人", "DM", True),
        (T(2026, 8, 31, 23), "c1", "個人", "DM", True),      # same visitor, last evening
        (T(2026, 8, 2, 9), "c2", "法人", "DM", True),
        (T(2026, 8, 2, 9), None, None, "DM", False),         # anonymous
        (T(2026, 7, 2, 9), "c4", "法人", "DM", True),         # other month, no sales
    ], S.TABLES["ga_sessions"])


def test_segment_visitor_value(tables, done, sessions):
    value = V.segment_visitor_value(sessions, done, tables["customers"], "2026-08-01",
                                    "2026-08-31")
    got = {r.segment: r for r in value.collect()}
    assert list(got) == list(S.SEGMENTS) or set(got) == set(S.SEGMENTS)
    assert (got["個人"].uu, got["個人"].sales, got["個人"].orders) == (1, 300, 1)
    assert (got["法人"].uu, got["法人"].sales, got["法人"].aov) == (1, 700, 350)
    sole = got["個人事業主"]
    assert (sole.uu, sole.sales, sole.uu_unit_price, sole.cvr, sole.aov) == (0, 0, 0, 0, 0)
    assert sum(r.sales_ratio for r in got.values()) == pytest.approx(1)
    assert sum(r.uu_ratio for r in got.values()) == pytest.approx(1)
    overall = V.overall_visitor_value(value).first()
    assert (overall.total_sales, overall.total_uu, overall.overall_uu_unit_price) == (1000, 2, 500)


def test_segment_visitor_value_monthly(tables, done, sessions):
    got = rows(V.segment_visitor_value_monthly(sessions, done, tables["customers"]),
               "month", "segment", "uu", "sales", "uu_unit_price")
    assert (D(2026, 7, 1), "法人", 1, 0, 0) in got       # visits without sales
    assert (D(2026, 6, 1), "個人", 0, 350, 0) in got      # sales without visits
    assert (D(2026, 8, 1), "法人", 1, 700, 700) in got


def test_absent_sessions_give_no_rows(tables, done):
    value = V.segment_visitor_value(None, done, tables["customers"], "2026-08-01", "2026-08-31")
    assert value.columns[0] == "segment" and value.count() == 0
    assert V.segment_visitor_value_monthly(None, done, tables["customers"]).count() == 0


def test_orders_with_a_time_of_day(spark):
    from datetime import datetime

    from tillscope.plans import campaigns, sales

    orders = spark.createDataFrame(
        [("o1", "c1", "s", datetime(2026, 1, 5, 9), 100), ("o2", "c1", "s", datetime(2026, 1, 5, 18), 50),
         ("o3", "c2", "s", datetime(2026, 1, 6, 23, 59), 70), (None, None, "s", datetime(2026, 1, 7), 5)],
        "order_id string, customer_id string, sku_id string, order_date timestamp_ntz, "
        "total_amount long")
    monday = sales.sales_by_weekday(orders, per_day=True).first()
    assert monday.mean_amount == 150
    ran = spark.createDataFrame([("C", "n", "2026-01-05", "2026-01-06")],
                                "campaign_id string, campaign_name string, a string, b string") \
        .selectExpr("*", "to_date(a) start_date", "to_date(b) end_date")
    lift = campaigns.campaign_lift(orders, ran).first()
    assert (lift.before, lift.during, lift.after) == (0, 220, 5)
    assert campaigns.campaign_daily_sales(orders, ran).count() == 3
    kpis = sales.revenue_kpis(orders)
    assert tuple(kpis.first())[:3] == (225, 3, 2)
    assert tuple(sales.revenue_kpis(orders.limit(0)).first())[:3] == (0, 0, 0)
    for plan in (kpis, sales.period_comparison(orders), sales.trailing_kpis(orders)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in text
