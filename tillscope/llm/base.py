"""What the corpus operators share: reading tables, and writing intermediate results once."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, return.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Bytes of an Arrow batch to and from Python workers. Spark's own 64 MB are held several times over,
#: in the JVM and in the worker, by every task.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and get batches
    of few bytes, unless the session has a limit of its own."""
    spark.conf.set(BATCH, spark.conf.get(BATCH, BATCH_BYTES))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one gets a folder."""
    importable(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tillscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, written with the writer's ``options``.

    It survives lost executors, cuts the lineage, and Spark knows its size: a join to it is
    broadcast only below the session's threshold and shuffled above it.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 500):
    """Arrow batches cut to ``rows`` rows, so that a worker turns few texts at a time into
    Python values; memory that Arrow keeps goes back when the task ends, as workers stay."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    release()


def release() -> None:
    """Gives free memory back to the system: workers stay for the tasks to come, of other
    operators too, and would keep what the largest of their tasks took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_of(column: str = "text") -> Column:
    """Null texts read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(id_column: str = "doc_id") -> Column:
    """A fifth of the rows, by the checksum of the id written as text; null ids are in."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(True))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
