from datetime import date as D

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import rows
from tillscope import schemas as S
from tillscope.functions import columns as C
from tillscope.sources.tables import load_tables, read_table


def test_csv_with_byte_order_mark_and_missing_tables(spark, tmp_path):
    head = ",".join(S.TABLES["campaigns"].names)
    (tmp_path / "campaigns.csv").write_text(
        "﻿" + head + "\nC1,新春,2024-01-01,2024-01-15,20,割引,全カテゴリ,500,375\n",
        encoding="utf-8")
    (tmp_path / "wms_inventory.csv").write_text(
        ",".join(S.TABLES["wms_inventory"].names)
        + "\n2024-01-01,s,マザー倉庫,関東マザー倉庫,1,2,3\n", encoding="utf-8")
    got = load_tables(spark, str(tmp_path), "csv", ["campaigns", "wms_inventory", "ad_plan"])
    assert rows(got["campaigns"], "campaign_id", "start_date", "budget") == [
        ("C1", D(2024, 1, 1), 500)]
    assert rows(got["wms_inventory"], "warehouse_type") == [("EC在庫倉庫",)]
    assert got["ad_plan"] is None
    with pytest.raises(AnalysisException):
        read_table(spark, str(tmp_path), "vendors", "csv")


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "ec_orders.csv"
    names = S.TABLES["ec_orders"].names
    values = dict(order_id="o1", customer_id="c1", product_id="P", sku_id="s1", status="完了",
                  order_date="2026-01-05", quantity="2", unit_price="100", total_amount="200")

    def read(order, **changed):
        row = {**values, **changed}
        path.write_text("\ufeff" + ",".join(order) + "\n"
                        + ",".join(row.get(c, "x") for c in order) + "\n", encoding="utf-8")
        return read_table(spark, str(tmp_path), "ec_orders", "csv")
    for order in (names[::-1], ["note", *names[3:], *names[:3], "more"]):
        got = read(order)
        assert got.columns == names
        row = got.first()
        assert (row.order_id, row.order_date, row.total_amount) == ("o1", D(2026, 1, 5), 200)
    with pytest.raises(ValueError, match="order_date"):
        read([c for c in names if c != "order_date"])
    for bad in (dict(order_date="yesterday"), dict(quantity="two")):
        with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse|CAST"):
            read(names, **bad).collect()


def test_absent_optional_tables(spark, tables):
    from tillscope.plans import ads, attribution

    plan = ads.ad_plan_adjusted(None, {"DM": 2.0})
    assert plan.count() == 0
    assert ads.ad_plan_monthly(plan).count() == 0
    assert ads.ad_plan_total(plan).count() == 1
    assert ads.ad_plan_matrix(plan, ["2026-01"]).count() == 0
    assert attribution.sales_by_channel(tables["orders"], None).count() == 0


def test_money_and_percent_texts(spark):
    one = spark.range(1)
    assert rows(one.select(C.yen_short(F.lit(999_999)), C.yen_short(F.lit(1_250_000)),
                           C.value_percent(F.lit(200.0)))) == [("¥999,999", "¥1.2M", "200.0%")]


def test_session_dates_with_and_without_time(spark, tmp_path):
    (tmp_path / "ga_sessions.csv").write_text(
        ",".join(S.TABLES["ga_sessions"].names)
        + "\n2026-01-05,c1,個人,DM,True\n2026-01-05 10:30:00,c1,個人,DM,False\n",
        encoding="utf-8")
    csv = read_table(spark, str(tmp_path), "ga_sessions", "csv")
    assert [(r.date.hour, r.is_logged_in) for r in csv.collect()] == [(0, True), (10, False)]
    dates = csv.limit(1).withColumn("date", F.to_date("date"))
    dates.write.parquet(str(tmp_path / "ga_sessions.parquet"))
    assert read_table(spark, str(tmp_path), "ga_sessions").first().date.day == 5


def test_parquet_round_trip(spark, tables, tmp_path):
    tables["orders"].write.parquet(str(tmp_path / "ec_orders.parquet"))
    back = read_table(spark, str(tmp_path), "ec_orders")
    assert back.schema == S.TABLES["ec_orders"]
    assert sorted(map(str, back.collect())) == sorted(map(str, tables["orders"].collect()))


def test_columns(spark):
    df = spark.createDataFrame([(1, 0, "a"), (3, 2, None), (None, None, "z")],
                               "n int, d int, k string")
    assert rows(df.select(C.safe_ratio("n", "d"), C.open_ratio("n", "d"),
                          C.percent_change("n", "d"), C.lookup("k", {"a": "A"}, "other"))) == [
        (0, None, None, "A"), (1.5, 1.5, 50, "other"), (0, None, None, "other")]
    one = spark.range(1)
    assert rows(one.select(C.yen(F.lit(1234567.5)), C.percent_text(F.lit(0.1234)),
                           C.signed_percent(F.lit(3.25)), C.month_label(F.lit("2026-03-09")),
                           C.month_from_label(F.lit("2026-03")),
                           C.sum_of(F.lit(1), F.lit(None).cast("int")))) == [
        ("¥1,234,568", "12.34%", "+3.2%", "2026-03", D(2026, 3, 1), 1)]
