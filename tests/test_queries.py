"""Every registered query against its SQL on the driver tables."""

import os

import pytest

import __spark_entry__ as E
from tests.check_oracle import compare, connect
from tillscope.bindings.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"  # smaller tables lack rare cases, such as orders without lines
SLOW = {"sales_projection_trees", "demand_projection_trees"}  # fits with 100 trees
CHECKS = {"sales_projection_tree_checks", "demand_projection_tree_checks"}  # the same fits

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


@pytest.fixture(scope="module")
def base():
    return connect(FOLDER)


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_only_model_fits_lack_sql():
    assert set(QUERIES) - set(ORACLE) == SLOW


def test_plans_have_no_pair_joins_and_no_python(spark):
    for name in set(QUERIES) - SLOW - CHECKS:
        df = QUERIES[name](spark, FOLDER)
        plan = df._jdf.queryExecution().executedPlan().toString()
        for word in ("NestedLoop", "Cartesian", "EvalPython", "InPandas", "ExistingRDD"):
            assert word not in plan, (name, word)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, base, name):
    assert compare(base, spark, FOLDER, name) is None
