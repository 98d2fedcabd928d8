"""Named queries over the driver tables, each with its SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillscope.bindings.oracle import sql
from tillscope.functions.columns import decimals_as_double

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None, **extra: str):
    """Register a function under its own name; money leaves it as double."""
    def register(build: Query) -> Query:
        def run(spark, sf_dir):
            return decimals_as_double(build(spark, sf_dir))
        QUERIES[build.__name__] = run
        if oracle is not None:
            ORACLE[build.__name__] = sql(oracle, **extra)
        return build
    return register
