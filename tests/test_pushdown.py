"""Filters and columns reach the parquet scan of stored order lines."""

from tillscope import schemas as S
from tillscope.operators.periods import trailing_period
from tillscope.plans import sales as A
from tillscope.sources.tables import read_table


def scans(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "FileScan" in line]


def test_period_filter_and_columns_are_pushed(spark, tables, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    tables["orders"].write.parquet(str(tmp_path / "ec_orders.parquet"))
    stored = A.completed(read_table(spark, str(tmp_path), "ec_orders"))
    df = A.monthly_sales(trailing_period(stored, "order_date", 6))
    main = [s for s in scans(df) if "total_amount" in s]
    assert len(main) == 1
    assert f"EqualTo(status,{S.DONE})" in main[0] and "subquery" in main[0]
    assert "ReadSchema: struct<order_date:date,status:string,total_amount:bigint>" in main[0]
    other = [s for s in scans(df) if "total_amount" not in s]
    assert all("ReadSchema: struct<order_date:date,status:string>" in s for s in other)
    assert [r.revenue for r in df.collect()] == [470, 1100]


def test_campaigns_bound_the_scan_and_drop_days_before_sums(spark, tables):
    from tillscope.plans.campaigns import campaign_sku_ranking

    ran = spark.createDataFrame([("C", "n", "2026-08-01", "2026-08-05")],
                                "campaign_id string, campaign_name string, a string, b string") \
        .selectExpr("*", "to_date(a) start_date", "to_date(b) end_date")
    df = campaign_sku_ranking(tables["orders"], ran, tables["products"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    sums = plan.index("sum(total_amount")
    assert "order_date" in plan and ">= scalar-subquery" in plan
    assert plan.index("LeftSemi") > sums  # below the sum by day and SKU


def test_skus_are_not_dealt_by_category(spark, tables):
    from pyspark.sql import functions as F

    from tillscope.plans.projection import sku_demand_split

    ahead = tables["products"].select("category").distinct() \
        .withColumn("month", F.to_date(F.lit("2026-09-01"))).withColumn("qty", F.lit(7))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = sku_demand_split(ahead, tables["orders"], tables["products"])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(category" in plan and "__salt" in plan
        assert {r.sku_id for r in df.collect()} == {"s1", "s2", "s3", "s4"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
