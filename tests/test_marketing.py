from datetime import date as D
from datetime import datetime as T

import pytest

from tests.conftest import rows
from tillscope import schemas as S
from tillscope.plans import ads as A
from tillscope.plans import attribution as B
from tillscope.plans import campaigns as C
from tillscope.plans.sales import completed


@pytest.fixture(scope="module")
def done(tables):
    return completed(tables["orders"])


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([
        (T(2026, 6, 1), "c1", "個人", "検索広告", True),
        (T(2026, 8, 31), "c1", "個人", "DM", True),          # on the order's own day
        (T(2026, 8, 1), "c2", "法人", "リターゲ", True),
        (T(2026, 8, 10), "c2", "法人", None, True),          # later touch, no channel
        (T(2026, 7, 1), "c9", "個人", "検索広告", True),      # after the order
        (T(2026, 6, 1), "c4", "法人", "新種", True),          # unmapped channel
        (T(2026, 6, 1), None, None, "検索広告", False),
    ], S.TABLES["ga_sessions"])


def test_sales_by_channel(done, sessions):
    got = dict(rows(B.sales_by_channel(done, sessions)))
    # o1 350 and o3 300 digital; o2 300 mail; o4 400 (null channel), o6, o7, o8, o9 direct.
    assert got == {"デジタル広告": 650, "メルマガ／DM": 300, "ダイレクト": 870}
    assert sum(got.values()) == sum(r.total_amount for r in done.collect())
    shares = B.channel_shares(B.sales_by_channel(done, sessions)).collect()
    assert sum(r.share for r in shares) == pytest.approx(1)
    assert B.sales_by_channel(done, None).count() == 0


def test_advertised_skus(tables, done, sessions):
    products = tables["products"]
    revenue = rows(B.ad_attributed_sku_revenue(done, sessions, products), "sku_id", "revenue")
    assert revenue == [("s3", 300), ("s1", 200), ("s2", 150)]
    profit = rows(B.ad_attributed_sku_profit(done, sessions, products), "sku_id", "profit")
    assert profit == [("s3", 100), ("s1", 80), ("s2", 60)]
    for build in (B.ad_attributed_sku_revenue, B.ad_attributed_sku_profit):
        assert build(done, None, products).count() == 0


def test_profit_skips_lines_without_a_quantity(spark, sessions, tables):
    lines = spark.createDataFrame([
        ("x1", "c2", "P2", "s3", D(2026, 8, 2), "完了", 1, 300, 500),
        ("x2", "c2", "P2", "s3", D(2026, 8, 2), "完了", None, 300, 700),
        ("x3", "c2", "P9", "s8", D(2026, 8, 2), "完了", 1, 300, 900),  # unknown cost
    ], S.TABLES["ec_orders"])
    profit = rows(B.ad_attributed_sku_profit(lines, sessions, tables["products"]),
                  "sku_id", "profit")
    assert profit == [("s3", 300)]


@pytest.fixture(scope="module")
def ads(spark):
    return spark.createDataFrame([
        (D(2026, 6, 1), "a", "購入", 100, 10, 3, 250),
        (D(2026, 6, 2), "a", "登録", 25, 5, 1, 0),
        (D(2026, 7, 1), "b", "購入", 70, 4, 0, 0),      # no conversions
        (D(2026, 7, 1), "c", "購入", 0, 1, 2, 90),      # no cost
        (D(2026, 7, 1), None, "購入", 5, 1, 1, 1),
    ], S.TABLES["ad_performance"])


def test_ad_cost_vs_profit(tables, done, sessions, ads):
    got = rows(B.ad_cost_vs_profit_monthly(done, sessions, tables["products"], ads))
    assert got == [("2026-06", 125, 140), ("2026-07", 75, 0), ("2026-08", 0, 100)]


def test_ad_summaries(ads):
    assert rows(A.monthly_ad_spend(ads)) == [(D(2026, 6, 1), 125), (D(2026, 7, 1), 75)]
    assert A.mean_monthly_ad_spend(ads).first()[0] == 100
    assert A.mean_monthly_ad_spend(ads.where("false")).first()[0] == 0
    got = {r.channel: r for r in A.ad_channel_summary(ads).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].cpa, got["a"].roas_pct) == (31, 200)   # 31.25 and 250 / 125
    assert got["b"].cpa is None and got["c"].roas_pct is None
    assert sorted(rows(A.ad_conversions_by_type(ads))) == [
        ("a", "登録", 1), ("a", "購入", 3), ("b", "購入", 0), ("c", "購入", 2)]
    assert rows(A.ad_monthly_cost_revenue(ads)) == [("2026-06", 125, 250), ("2026-07", 75, 91)]


def test_halves_round_to_even(spark):
    ads = spark.createDataFrame([
        (D(2026, 6, 1), "x", "購入", 5, 1, 2, 5), (D(2026, 6, 1), "y", "購入", 7, 1, 2, 7)],
        S.TABLES["ad_performance"])
    assert rows(A.ad_channel_summary(ads), "cpa") == [(2,), (4,)]


def test_ad_plan(spark):
    plan = spark.createDataFrame([
        ("2026-10", "a", "獲得", 333), ("2026-10", "b", "認知", 100),
        ("2026-11", "a", "獲得", 55), ("2027-09", "a", "獲得", 9)], S.TABLES["ad_plan"])
    horizon = spark.sql("select explode(array(date'2026-10-01', date'2026-11-01')) as month")
    out = A.ad_plan_adjusted(plan, {"a": 0.5}, horizon)
    assert sorted(rows(out, "month", "channel", "adjusted_cost")) == [
        ("2026-10", "a", 166), ("2026-10", "b", 100), ("2026-11", "a", 27)]
    assert [tuple(r)[1:4] for r in A.ad_plan_monthly(out).collect()] == [
        (433, 266, -167), (55, 27, -28)]
    total = A.ad_plan_total(out).first()
    assert total.delta_pct == -195 / 488 * 100
    assert rows(A.ad_plan_matrix(out, ["2026-10", "2026-11"])) == [
        ("a", 166, 27), ("b", 100, None)]
    assert A.ad_plan_total(A.ad_plan_adjusted(plan, {"a": 0.0, "b": 2.0})).first().adjusted == 200
    same = A.ad_plan_total(A.ad_plan_adjusted(plan)).first()
    assert (same.delta, same.delta_pct) == (0, 0)
    assert A.ad_plan_total(out.where("false")).first().delta_pct == 0


@pytest.fixture(scope="module")
def campaigns(spark):
    def row(i, start, end):
        return (i, f"n{i}", start, end, 10, "割引", "全カテゴリ", 500000, 1234)
    return spark.createDataFrame([
        row("A", D(2026, 1, 10), D(2026, 1, 12)), row("B", D(2026, 1, 12), D(2026, 1, 12)),
        row("C", D(2025, 1, 1), D(2025, 1, 5)),
        row("D", D(2026, 1, 9), D(2026, 1, 8))], S.TABLES["campaigns"])


@pytest.fixture(scope="module")
def january(spark):
    def line(i, day, sku, amount):
        return (f"j{i}", "c1", "P1", sku, D(2026, 1, day), "完了", 1, amount, amount)
    return spark.createDataFrame([
        line(1, 7, "s1", 1000), line(2, 8, "s1", 10), line(3, 9, "s1", 30),
        line(4, 10, "s1", 40), line(5, 12, "s2", 60), line(6, 12, "s1", 1),
        line(7, 13, "s2", 20), line(8, 14, "s2", 5), line(9, 15, "s2", 999)],
        S.TABLES["ec_orders"])


def test_campaign_lift(january, campaigns):
    got = {r.campaign_id: r for r in C.campaign_lift(january, campaigns).collect()}
    a = got["A"]
    assert (a.before, a.during, a.after) == (40, 101, 25)
    assert (a.during_lift_pct, a.after_lift_pct) == ((101 - 40) / 40 * 100, -37.5)
    # One-day campaign: no days before or after, so no lift is stated.
    assert (got["B"].before, got["B"].during, got["B"].after) == (0, 61, 0)
    assert (got["D"].before, got["D"].during, got["D"].after) == (0, 0, 0)  # ends early
    assert (got["B"].during_lift_pct, got["C"].during, got["C"].after_lift_pct) == (0, 0, 0)


def test_campaign_days_and_skus(tables, january, campaigns):
    daily = rows(C.campaign_daily_sales(january, campaigns), "campaign_id", "day", "amount")
    assert [(c, d.day, x) for c, d, x in daily] == [
        ("A", 8, 10), ("A", 9, 30), ("A", 10, 40), ("A", 12, 61), ("A", 13, 20),
        ("A", 14, 5), ("B", 12, 61)]
    best = C.campaign_sku_ranking(january, campaigns, tables["products"], 1)
    assert sorted(rows(best, "campaign_id", "sku_id", "revenue")) == [
        ("A", "s2", 60), ("B", "s2", 60)]
    plan = C.campaign_lift(january, campaigns)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_campaign_list(campaigns):
    assert rows(C.campaign_list(campaigns, "nA")) == [
        ("A", "nA", "2026/01/10", "2026/01/12", 10, "割引", "全カテゴリ", "¥500,000", "¥1,234")]
    assert C.campaign_list(campaigns).count() == 4
