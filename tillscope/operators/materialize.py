"""Keeping intermediate results, for work that reads them many times."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, for tables; a local session without one gets a
    folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tillscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the session's ``spark.checkpoint.dir`` and read from there.

    Unlike a cache it is not computed again when an executor is lost. A session without
    that folder caches the rows instead; ``unpersist`` releases them.
    """
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None:
            return df.persist()
        context.setCheckpointDir(folder)
    return df.checkpoint()
