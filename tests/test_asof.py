"""The as-of join against a brute-force answer."""

import random
from datetime import datetime, timedelta

import pytest

from tillscope.operators.asof import asof_join

LEFT = "id int, k string, at timestamp_ntz, v int"
RIGHT = "k string, seen timestamp_ntz, tie int, channel string"


def brute(left, right):
    out = []
    for i, k, at, v in left:
        past = [r for r in right if k is not None and at is not None and r[0] == k
                and r[1] is not None and r[1] <= at]
        best = max(past, key=lambda r: (r[1], r[2])) if past else (None,) * 4
        out.append((i, k, at, v, best[3]))
    return sorted(out)


def run(spark, left, right, **options):
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT),
                    "k", "at", "seen", ["channel"], tie=["tie"], **options)
    assert got.columns == ["id", "k", "at", "v", "channel"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("minutes", [1, 60, 7, 1440])
def test_matches_brute_force(spark, minutes):
    rng = random.Random(minutes)
    start = datetime(1969, 12, 31, 20, 0)  # slices before and after 1970

    def when():
        return start + timedelta(seconds=rng.randrange(0, 8 * 3600, 30))
    keys = ["hot"] * 6 + ["a", "b", "c"]
    left = [(i, rng.choice(keys + [None]), when(), i) for i in range(120)]
    left += [(500, "hot", None, 0)]
    right = [(rng.choice(keys + [None]), when(), i, rng.choice(["x", "y", None]))
             for i in range(90)]
    right += [("hot", None, 99, "x")]
    assert run(spark, left, right, slice_minutes=minutes) == brute(left, right)


def test_exact_hit_tie_and_null_channel(spark):
    t = datetime(2026, 1, 5, 9)
    left = [(1, "a", t, 0), (2, "a", t - timedelta(microseconds=1), 0), (3, "z", t, 0),
            (4, "a", t + timedelta(days=40), 0)]
    right = [("a", t, 1, "first"), ("a", t, 2, "second"),
             ("a", t + timedelta(days=1), 0, None)]
    for minutes in (1, 1440):
        assert [r[4] for r in run(spark, left, right, slice_minutes=minutes)] == [
            "second", None, None, None]


def test_date_columns(spark):
    left = spark.createDataFrame([(1, "a", "2026-03-01"), (2, "a", "2026-02-28")],
                                 "id int, k string, at string")
    right = spark.createDataFrame([("a", "2026-03-01", "x")], "k string, d string, channel string")
    left = left.selectExpr("id", "k", "to_date(at) at")
    right = right.selectExpr("k", "to_date(d) d", "channel")
    got = asof_join(left, right, "k", "at", "d", ["channel"])
    assert sorted((r.id, r.channel) for r in got.collect()) == [(1, "x"), (2, None)]


def test_building_runs_no_job_and_null_keys_skip_the_join(spark):
    left = spark.createDataFrame([(1, "a", datetime(2026, 1, 1), 0)], LEFT)
    right = spark.createDataFrame([("a", datetime(2026, 1, 1), 0, "x")], RIGHT)
    context = spark.sparkContext
    context.setJobGroup("building", "as-of join")
    joined = asof_join(left, right, "k", "at", "seen", ["channel"], tie=["tie"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert not context.statusTracker().getJobIdsForGroup("building")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert "NestedLoop" not in plan and "Broadcast" not in plan.split("Union")[0]
    assert "isnotnull(k" in plan


def test_many_rows_at_one_instant(spark):
    t = datetime(2026, 1, 5, 9)
    left = [(i, "a", t, i) for i in range(200)] + [(900, "b", t, 0), (901, None, t, 0)]
    right = [("a", t, i, f"c{i}") for i in range(100)]
    got = run(spark, left, right)
    assert got == brute(left, right) and len(got) == 202


def test_left_side_is_read_once(spark, tmp_path):
    rng = random.Random(9)
    start = datetime(2026, 1, 1)
    left = [(i, rng.choice(["hot", "hot", "a", None]), start + timedelta(hours=rng.randrange(400)),
             i) for i in range(400)]
    right = [(rng.choice(["hot", "a", "b"]), start + timedelta(hours=rng.randrange(400)), i, "x")
             for i in range(300)]
    spark.createDataFrame(left, LEFT).write.parquet(f"{tmp_path}/left")
    spark.createDataFrame(right, RIGHT).write.parquet(f"{tmp_path}/right")
    joined = asof_join(spark.read.parquet(f"{tmp_path}/left"), spark.read.parquet(f"{tmp_path}/right"),
                       "k", "at", "seen", ["channel"], tie=["tie"])
    for df in (joined, joined.groupBy("channel").agg({"v": "sum"})):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 2, final
        assert "ReusedExchange" in final
    assert sorted(map(tuple, joined.collect())) == brute(left, right)
