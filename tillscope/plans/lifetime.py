"""First purchases as kept state, so that lifetime splits do not read the history again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.plans.sales import first_purchase

SCHEMA = "customer_id {kind}, first_month date"


def merged(*states: DataFrame) -> DataFrame:
    """One state from several: each customer's earliest month.

    A minimum of minimums, so the order of states and repeated ones do not matter.
    """
    both = states[0].select("customer_id", "first_month")
    for state in states[1:]:
        both = both.unionByName(state.select("customer_id", "first_month"))
    return both.groupBy("customer_id").agg(F.min("first_month").alias("first_month"))


class FirstPurchases:
    """(customer, first month) in a folder, a part for each batch of order lines.

    A batch may come late, again, or be cut in any way: its part is written anew under its
    name, and reading takes the minimum over the parts. ``compacted`` puts all parts into
    one, so that reading stays about as large as the number of customers.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str = "long"):
        self.spark, self.folder, self.schema = spark, folder, SCHEMA.format(kind=kind)

    def add(self, batch: str, orders: DataFrame) -> None:
        """Takes in order lines; the earlier part of the same name is replaced."""
        first_purchase(orders).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def state(self) -> DataFrame:
        parts = (self.spark.read.schema(self.schema + ", batch string")
                 .option("basePath", self.folder).parquet(f"{self.folder}/batch=*"))
        return merged(parts)

    def compacted(self, folder: str) -> "FirstPurchases":
        """The same state as one part of another folder, to which batches may be added."""
        self.state().write.parquet(f"{folder}/batch=base")
        return FirstPurchases(self.spark, folder, self.schema.split(",")[0].split()[1])
