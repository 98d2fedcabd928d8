from datetime import date as D

from pyspark.sql import functions as F

from tests.conftest import rows
from tillscope.operators import periods as P
from tillscope.operators.domains import domain, fill_domain, month_domain
from tillscope.operators.ranking import top_k, top_k_per_group


def dated(spark, *days):
    return (spark.createDataFrame([(d,) for d in days], "d string")
            .select(F.to_date("d").alias("d")))


def test_trailing_period_clamps_month_end_and_snaps(spark):
    df = dated(spark, "2026-02-28", "2026-02-01", "2026-01-31", "2026-08-31")
    # Six months before 31 August is 28 February, snapped to 1 February.
    assert sorted(r.d for r in P.trailing_period(df, "d", 6).collect()) == [
        D(2026, 2, 1), D(2026, 2, 28), D(2026, 8, 31)]
    floor = P.trailing_period(df, "d", 6, floor="2026-02-15")
    assert sorted(r.d for r in floor.collect()) == [D(2026, 2, 28), D(2026, 8, 31)]
    assert P.trailing_period(df, "d", 6, floor="2027-01-01").collect() == []


def test_period_bounds(spark):
    df = dated(spark, "2026-02-28", "2026-08-31")
    assert rows(P.period_bounds(df, "d", 6)) == [(D(2026, 2, 1), D(2026, 8, 31), True)]
    assert rows(P.period_bounds(df, "d", 6, "2026-06-15")) == [
        (D(2026, 6, 15), D(2026, 8, 31), True)]
    assert rows(P.period_bounds(df, "d", 6, "2026-09-01"), "has_rows") == [(False,)]
    assert rows(P.period_bounds(df.where("false"), "d", 6), "has_rows") == [(False,)]


def test_date_range_keeps_both_days_and_time_of_day(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00",), ("2026-01-02 23:59:59",),
                                ("2026-01-03 00:00:00",)], "d string")
    df = df.select(F.col("d").cast("timestamp_ntz").alias("d"))
    assert P.date_range(df, "d", "2026-01-01", "2026-01-02").count() == 2


def test_last_months_and_snapshot(spark):
    df = dated(spark, "2026-03-31", "2026-03-30", "2026-08-31")
    assert P.last_months(df, "d", 5).count() == 2
    assert rows(P.latest_snapshot(df, "d")) == [(D(2026, 8, 31),)]


def test_domains(spark):
    assert [r.month for r in month_domain(spark, "2026-11-05", "2027-01-31").collect()] == [
        D(2026, 11, 1), D(2026, 12, 1), D(2027, 1, 1)]
    got = fill_domain(domain(spark, "s", ["a", "b"]),
                      spark.createDataFrame([("b", 2), ("c", 3)], "s string, n long"),
                      "s", zeros=["n"])
    assert sorted(rows(got, "s", "position", "n")) == [("a", 0, 0), ("b", 1, 2)]


def test_top_k_breaks_ties(spark):
    df = spark.createDataFrame([("g", "b", 5), ("g", "a", 5), ("g", "c", 9), ("h", "z", 1)],
                               "g string, id string, n int")
    assert rows(top_k(df, "n", "id", 2), "id") == [("c",), ("a",)]
    assert len(rows(top_k(df, "n", "id", None))) == 4
    best = top_k_per_group(df, "g", "n", "id", 2)
    assert sorted(rows(best, "g", "id", "rank")) == [("g", "a", 2), ("g", "c", 1), ("h", "z", 1)]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
