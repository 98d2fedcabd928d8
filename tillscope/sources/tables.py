"""Reading the retail tables with declared schemas."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope import schemas as S


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet",
               required: bool = True) -> DataFrame | None:
    """One table at ``folder/name.fmt``; ``None`` for a missing optional one."""
    path, schema = f"{folder}/{name}.{fmt}", S.TABLES[name]
    try:
        if fmt == "csv":
            return _read_csv(spark, path, schema)
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if required or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _files_by_header(spark, path) -> list[list[str]]:
    """The files of a CSV folder, those with one header line together.

    The lines of all files are read for it, in parallel, but only file names and their
    headers move. One file is its own group and is not read.
    """
    text = spark.read.text(path)
    files = sorted(text.inputFiles())
    if len(files) < 2:
        return [files]
    heads = (text.select(F.col("_metadata.file_path").alias("file"), "value",
                         F.col("_metadata.file_block_start").alias("begin"),
                         F.monotonically_increasing_id().alias("line"))
             .where("begin = 0").groupBy("file").agg(F.min_by("value", "line").alias("head"))
             .groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")))
    return sorted(r.files for r in heads.collect())


def _csv_parts(spark, path, schema, extra=()):
    """For each group of files with one header: a reader that knows its columns, the files."""
    for files in _files_by_header(spark, path):
        reader = spark.read.option("header", True)
        found = [c.strip("\ufeff") for c in reader.csv(files[:1]).columns]
        missing = [c for c in schema.names if c not in found]
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
        kinds = T.StructType([T.StructField(c, schema[c].dataType if c in schema.names
                                            else T.StringType()) for c in found])
        yield reader.schema(T.StructType([*kinds, *extra])), files


def _read_csv(spark, path, schema):
    """The declared columns by their header name, in any order; others are left out.

    Files of a folder may order their columns differently. A column that is missing is named
    in the error, and a value that is not of its column's type ends the reading.
    """
    return reduce(DataFrame.unionByName, [
        reader.option("mode", "FAILFAST").csv(files).select(*schema.names)
        for reader, files in _csv_parts(spark, path, schema)])


def read_checked(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The sound rows of a CSV table, and its bad records.

    A record is bad if a declared value is not of its type or fields are missing or too many.
    Bad records keep what could be read, with the ``file`` and the whole ``record``, to be
    counted, mended and read again. Headers are checked as in :func:`read_table`.
    """
    schema = S.TABLES[name]
    record = T.StructField("__record", T.StringType())
    rows = reduce(DataFrame.unionByName, [
        reader.option("columnNameOfCorruptRecord", record.name).csv(files).select(*schema.names, record.name, F.col("_metadata.file_path").alias("file"))
        for reader, files in _csv_parts(spark, f"{folder}/{name}.csv", schema, [record])])
    # Spark checks the values of the columns that are asked for, so the condition names them all
    values = F.concat_ws("", *[F.col(c).cast("string") for c in schema.names])
    bad = F.concat(record.name, F.substring(values, 1, 0)).isNotNull()
    return (rows.where(~bad).select(*schema.names),
            rows.where(bad).withColumnRenamed(record.name, "record"))


def load_tables(spark: SparkSession, folder: str, fmt: str = "parquet",
                names=None) -> dict[str, DataFrame | None]:
    """All retail tables by name, warehouses already renamed."""
    tables = {name: read_table(spark, folder, name, fmt, name not in S.OPTIONAL_TABLES)
              for name in (names or S.TABLES)}
    if tables.get("wms_inventory") is not None:
        tables["wms_inventory"] = rename_warehouses(tables["wms_inventory"])
    return tables


def rename_warehouses(inventory: DataFrame) -> DataFrame:
    return (inventory.replace(S.WAREHOUSE_TYPE_NAMES, subset=["warehouse_type"])
            .replace(S.WAREHOUSE_NAMES, subset=["warehouse_name"]))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows with a full schema, what an analysis gives when its table is absent."""
    return spark.createDataFrame([], schema)
