import re
from datetime import date as D

import pytest

from tests.conftest import rows
from tillscope.sources.stores import attach_store, store_by_month, stored_between

LINES = "order_id long, order_date date, amount long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stores"))
    lines = [(i % 50, D(2026, 1 + i % 50 % 12, 1 + i % 28), i) for i in range(400)]
    lines += [(7, None, 1), (None, D(2026, 3, 3), 2)]
    heads = [(i, D(2026, 1 + i % 12, 5), i % 3) for i in range(50)]
    made = [store_by_month(spark.createDataFrame(r, LINES), f"stored_{n}", f"{folder}/{n}",
                           "order_date", "order_id", 4)
            for n, r in (("lines", lines), ("heads", heads))]
    yield folder, lines, *made
    for n in ("lines", "heads", "again"):
        spark.sql(f"drop table if exists stored_{n}")


def test_all_rows_are_stored(spark, stores):
    folder, lines, stored, _ = stores
    assert sorted(rows(stored.drop("stored_month")), key=str) == sorted(lines, key=str)
    found = rows(stored_between(stored, "order_date", "2026-02-10", "2026-04-20"))
    assert sorted(found, key=str) == sorted(
        [x for x in lines if x[1] and D(2026, 2, 10) <= x[1] <= D(2026, 4, 20)], key=str)
    empty = store_by_month(spark.createDataFrame([], LINES), "stored_again", f"{folder}/none",
                           "order_date", "order_id", 4)
    assert rows(stored_between(empty, "order_date", "2026-02-10", "2026-04-20")) == []
    spark.sql("drop table stored_again")


def test_months_are_pruned_and_joins_not_shuffled(spark, stores):
    folder, lines, stored, heads = stores
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        part = stored_between(stored, "order_date", "2026-02-10", "2026-04-20")
        assert re.search(r"PartitionFilters: \[.*stored_month", plan_of(part))
        assert 0 < len(part.inputFiles()) < len(stored.inputFiles())
        attached = attach_store(spark, "stored_again", f"{folder}/lines", LINES, "order_id", 4)
        for side in (stored, attached):
            both = side.join(heads.withColumnRenamed("amount", "kind"), "order_id")
            assert "SortMergeJoin" in plan_of(both) and "Exchange" not in plan_of(both)
            assert both.count() == len([x for x in lines if x[0] is not None])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
