"""A corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; every
stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import lines, mixing, packing, simhash, toxicity
from tillscope.llm.base import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many unlike documents of a source hold go; documents stay.

    A source is far larger than a web site, so a line is boilerplate from one document in a
    hundred on: in the given tables lines stand either below that, or, planted, above it (2 to
    5 %, some 13 %). Copies of a document count once, so that they keep their lines for the
    next stage.
    """
    return lines.cleaned(docs, ratio=0.01, least=5, unlike=True)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, by the operator and its contract:
    shingles of four words, fingerprints linked at four or fewer differing bits."""
    return simhash.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight; a document that the mix takes several times has as many rows."""
    return mixing.repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, neighbours together, with their ids."""
    return packing.packed(docs)


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage),
          ("simhash near-dedup", copies_stage), ("source mix", mixing_stage),
          ("packing", packing_stage)]

#: A classifier decides in the first stage, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again.

    The result has the ids of each piece (binary, little-endian unsigned 32-bit) and their
    checksum.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids_crc32", F.crc32("ids"))
