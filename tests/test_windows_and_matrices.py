"""Sums of long windows, matrices by position, kept first purchases, folders of CSV files."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillscope import schemas as S
from tillscope.operators.daywindows import running_totals, window_sums
from tillscope.operators.matrix import month_number, newest, with_header
from tillscope.plans import campaigns, lifetime, pl, projection
from tillscope.plans.sales import first_purchase, new_repeat_monthly
from tillscope.sources.tables import read_checked, read_table

DAY = date(2026, 1, 1)
CAMPAIGN = "campaign_id string, campaign_name string, start_date date, end_date date"


def campaign_rows(n, rng, longest):
    out = []
    for i in range(n):
        start = DAY + timedelta(days=rng.randrange(400))
        out.append((f"c{i}", f"n{i}", start, start + timedelta(days=rng.randrange(longest))))
    return out


def test_lift_equals_day_by_day_sums(spark):
    rng = random.Random(4)
    made = campaign_rows(40, rng, 30) + [("odd", "ends first", DAY, DAY - timedelta(days=3)),
                                         ("none", "no dates", None, None)]
    sold = [(DAY + timedelta(days=rng.randrange(150, 300)), rng.randrange(1000)) for _ in range(500)]
    sold += [(None, 5), (DAY + timedelta(days=200), None)]
    orders = spark.createDataFrame(sold, "order_date date, total_amount long")
    got = {r.campaign_id: (r.before, r.during, r.after) for r in campaigns.campaign_lift(
        orders, spark.createDataFrame(made, CAMPAIGN)).collect()}
    assert len(got) == len(made)
    for key, _, start, end in made:
        def total(first, last):
            return sum(a or 0 for d, a in sold if d and first <= d <= last)
        if start is None or end < start:
            assert got[key] == (0, 0, 0)
            continue
        nights = end - start
        one = timedelta(days=1)
        assert got[key] == (total(start - nights, start - one), total(start, end),
                            total(end + one, end + nights)), key
    nothing = spark.createDataFrame([], CAMPAIGN)
    assert campaigns.campaign_lift(orders, nothing).count() == 0
    assert campaigns.campaign_lift(orders.limit(0), spark.createDataFrame(made, CAMPAIGN)).agg(
        F.sum(F.col("before") + F.col("during") + F.col("after"))).first()[0] == 0


def test_long_overlapping_windows_do_not_multiply_rows(spark):
    start = F.date_add(F.lit(DAY), (F.col("id") % 200).cast("int"))
    made = spark.range(10_000).select(F.col("id").alias("k"), start.alias("a"),
                                      F.date_add(start, 365).alias("b"))
    daily = spark.range(700).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("day"),
                                    F.col("id").alias("amount"))
    first, last = F.lit(DAY - timedelta(days=1)), F.lit(DAY + timedelta(days=699))
    out = window_sums(made, running_totals(daily, first, last), "k",
                      {"sum": (F.col("a"), F.col("b"))})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 2  # the calendar, and two bounds of each window
    assert out.count() == 10_000
    assert all(r["sum"] == sum(range(r.k % 200, r.k % 200 + 366)) for r in out.limit(50).collect())


def test_places(spark):
    cells = spark.createDataFrame(
        [("2026-01", "a", 1), ("2026-02", "a", 2), ("2026-02", "a", 5), ("2026-04", "b", 7)],
        "month string, item string, v long")

    def wide(window, start=None):
        some = newest(cells, "month", window, start)
        return rows(with_header(some, ["item"], F.sum("v"), F.max(month_number(F.col("month"))),
                                window).orderBy(F.col("item") != "month", "item"))
    assert wide(2) == [("month", 202602, 202604), ("a", 7, None), ("b", None, 7)]
    assert wide(2, 0) == [("month", 202601, 202602), ("a", 1, 7)]
    assert wide(2, 9) == wide(2)
    assert wide(4) == [("month", 202601, 202602, 202604, None), ("a", 1, 7, None, None),
                       ("b", None, None, 7, None)]
    context = spark.sparkContext
    context.setJobGroup("building", "matrix")
    with_header(newest(cells, "month", 2), ["item"], F.sum("v"),
                F.max(month_number(F.col("month"))), 2)
    assert not context.statusTracker().getJobIdsForGroup("building")
    context.setLocalProperty("spark.jobGroup.id", None)


def test_a_month_that_is_actual_and_projected_keeps_both(spark):
    history = spark.createDataFrame([(date(2026, 1, 1), 100), (date(2026, 3, 1), 300)],
                                    "month date, revenue long")
    ahead = spark.createDataFrame([(date(2026, 3, 1), 310.0, 200.0, 400.0)],
                                  "month date, sales double, lower double, upper double")
    table = projection.actual_projection_table(history, ahead, months=3)
    got = {r["item"]: tuple(r)[1:] for r in projection.table_by_place(table, 4).collect()}
    assert got["label"] == ("2026/01", "2026/02", "2026/03", "2026/03")
    assert sorted(got["kind"][2:]) == sorted([S.ACTUAL, S.PROJECTED])
    assert got["sales"][:2] == ("¥100", "—")
    assert {got["sales"][2], got["sales"][3]} == {"¥300", "¥310"}


def test_first_purchases_kept_by_batches(spark, tmp_path):
    rng = random.Random(1)
    data = [(f"o{i}", rng.choice([1, 2, 3, 4, None]), "s", DAY + timedelta(days=rng.randrange(300)),
             1, 10, 10) for i in range(80)]
    orders = spark.createDataFrame(data, "order_id string, customer_id long, sku_id string, "
                                   "order_date date, quantity int, unit_price int, total_amount long")
    kept = lifetime.FirstPurchases(spark, f"{tmp_path}/kept")
    cut = DAY + timedelta(days=150)
    late, early = orders.where(F.col("order_date") >= cut), orders.where(F.col("order_date") < cut)
    for name, batch in (("late", late), ("early", early), ("late", late)):
        kept.add(name, batch)
    want = rows(first_purchase(orders).orderBy("customer_id"))
    assert rows(kept.state().orderBy("customer_id")) == want
    base = kept.compacted(f"{tmp_path}/base")
    base.add("late", late)
    assert rows(base.state().orderBy("customer_id")) == want
    split = rows(new_repeat_monthly(late, history=base.state()))
    assert split == rows(new_repeat_monthly(late, history=orders))
    whole = rows(new_repeat_monthly(orders, since=F.lit(date(2026, 7, 1))))
    assert [r for r in split if r[0] >= date(2026, 7, 1)] == whole and len(whole) > 2


def order_csv(folder, name, header, records):
    (folder / "ec_orders.csv").mkdir(exist_ok=True)
    text = "\n".join(",".join(r[c] for c in header) for r in records)
    (folder / "ec_orders.csv" / name).write_text(",".join(header) + "\n" + text + "\n")


def record(i, **changed):
    return {**dict(order_id=f"o{i}", customer_id="c", product_id="P", sku_id="s", status="x",
                   order_date="2026-01-05", quantity=str(i), unit_price="100", total_amount="200"),
            **{c: "x" for c in S.TABLES["ec_orders"].names if c not in (
                "order_id customer_id product_id sku_id status order_date quantity unit_price "
                "total_amount").split()}, **changed}


def test_folder_of_csv_files(spark, tmp_path):
    names = S.TABLES["ec_orders"].names
    order_csv(tmp_path, "a.csv", names, [record(1), record(2)])
    order_csv(tmp_path, "b.csv", names[::-1], [record(3)])
    order_csv(tmp_path, "c.csv", [*names[2:], "more", *names[:2]], [record(4, more="m")])
    order_csv(tmp_path, "d.csv", names, [])
    got = read_table(spark, str(tmp_path), "ec_orders", "csv")
    assert got.columns == names
    assert rows(got.orderBy("quantity"), "order_id", "quantity") == [
        (f"o{i}", i) for i in range(1, 5)]
    good, bad = read_checked(spark, str(tmp_path), "ec_orders")
    assert good.count() == 4 and bad.count() == 0
    order_csv(tmp_path, "e.csv", names[::-1], [record(5), record(6, quantity="six"),
                                               record(7, order_date="soon")])
    (tmp_path / "ec_orders.csv" / "f.csv").write_text(",".join(names) + "\no8,c\n")
    good, bad = read_checked(spark, str(tmp_path), "ec_orders")
    assert rows(good.orderBy("quantity"), "quantity") == [(i,) for i in range(1, 6)]
    assert good.count() == 5 and bad.count() == 3
    assert any("six" in r.record and r.file.endswith("e.csv") for r in bad.collect())
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse|CAST"):
        read_table(spark, str(tmp_path), "ec_orders", "csv").collect()
    order_csv(tmp_path, "g.csv", names[1:], [record(9)])
    with pytest.raises(ValueError, match=names[0]):
        read_table(spark, str(tmp_path), "ec_orders", "csv")


def test_pl_of_the_newest_months(spark):
    table = spark.createDataFrame(
        [(f"2026-{m:02d}", *[10 * m] * (len(S.COST_ITEMS) + 1)) for m in range(1, 5)],
        ", ".join(["month string", f"`{S.REVENUE_ITEM}` long", *[f"`{c}` long" for c in S.COST_ITEMS]]))
    wide = {r["item"]: tuple(r)[1:] for r in pl.pl_newest(pl.monthly_pl(table), 3).collect()}
    assert wide["month"] == (202602.0, 202603.0, 202604.0)
    assert wide[S.REVENUE_ITEM] == (20.0, 30.0, 40.0)
