"""Token counts: rollups kept up to date by signed changes, committed batch by batch.

A change carries the state before, the state after, or both: an insert, a delete, a revised
count. Each state is one row of sign -1 or +1, so totals by source, language and tokenizer
version are sums that a batch only adds to; no total is read to change it. A batch's sums are
written first and named in the commit table last: what a lost driver left behind is never
counted, and a batch that is delivered again is not counted twice.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.tokens import encoder, tokenizer_path

KEYS = ("source", "lang", "tokenizer")
STATE = "struct<source:string,lang:string,tokenizer:string,tokens:bigint>"


def signed(changes: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Rows of keys, documents and tokens, -1 times the state before and +1 times that after.

    States are structs of the keys and tokens; a null state is absent, null tokens are 0, null
    keys are keys of their own. Repeated rows are changes of their own.
    """
    rows = changes.select(F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), F.col(before).cast(STATE).alias("state")),
        F.struct(F.lit(1).alias("sign"), F.col(after).cast(STATE).alias("state")))).alias("x"))
    rows = rows.filter("x.state is not null")
    return rows.select(*[F.col(f"x.state.{k}").alias(k) for k in KEYS],
                       F.col("x.sign").cast("long").alias("documents"),
                       (F.col("x.sign") * F.coalesce("x.state.tokens", F.lit(0))).alias("tokens"))


class Rollup:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.deltas, self.commits = spark, f"{folder}/deltas", f"{folder}/commits"
        for path, schema in ((self.deltas, "batch string, attempt string, source string, "
                              "lang string, tokenizer string, documents long, tokens long"),
                             (self.commits, "batch string, attempt string")):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(path)

    def _read(self, path):
        return self.spark.read.parquet(path)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Adds a batch of signed rows once; False if a batch of that name is in already."""
        if self._read(self.commits).filter(F.col("batch") == batch).head(1):
            return False
        attempt = uuid.uuid4().hex
        (rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"),
                                 F.sum("tokens").alias("tokens"))
         .select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), "*")
         .write.mode("append").parquet(self.deltas))
        self.spark.createDataFrame([(batch, attempt)], "batch string, attempt string") \
            .write.mode("append").parquet(self.commits)
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by key, over committed batches; keys without any are left out.

        Of two attempts that were committed at once under one name the first by name counts.
        """
        valid = self._read(self.commits).groupBy("batch").agg(F.min("attempt").alias("attempt"))
        return (self._read(self.deltas).join(valid, ["batch", "attempt"]).groupBy(*KEYS)
                .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
                .filter("documents != 0 or tokens != 0"))


def counted(docs: DataFrame, text: str = "text", out: str = "tokens",
            path: str | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each whole text in its place; null: 0.

    Another column that is called ``out`` is left out.
    """
    path = path or tokenizer_path()
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c == text or c.lower() != out.lower()])
    where = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            count = [len(encoder(path).encode(t)) // 4 for t in batch.column(where).to_pylist()]
            names = list(batch.schema.names)
            names[where] = out
            columns = list(batch.columns)
            columns[where] = pa.array(count, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)
    schema = ", ".join(f"`{out}` long" if f.name == text else
                       f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema)
