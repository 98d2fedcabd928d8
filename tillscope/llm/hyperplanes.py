"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines.

Vectors are hashed by the signs of their products with random planes. Vectors of one label
that agree in one table's signs meet in a bucket; there every cosine is computed in double
precision. A pair counts in the first table in which it meets, so degrees add up without a
list of pairs. Equal vectors of a label are one class with a count. Buckets give stars, and
connected components join them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.base import written
from tillscope.llm.components import components
from tillscope.llm.groups import runs, smallest_labels, whole_runs

SEED = 42
RECALL = 0.999  # of a pair exactly at the least cosine
TILE = 4096     # rows of a bucket that are compared in one group; larger buckets are split


def plan(rows: int, cosine: float) -> tuple[int, int]:
    """Signs per table and number of tables, by the rows of the largest label."""
    signs = max(6, math.ceil(math.log2(max(rows, 2) / 8)))
    meet = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _signatures(unit: np.ndarray, signs: int, tables: int) -> np.ndarray:
    # by rows, so that fewer tables are the first of more
    planes = np.random.default_rng(SEED).standard_normal((signs * tables, unit.shape[1]))
    bits = (unit @ planes.T > 0).reshape(len(unit), tables, signs)
    return bits @ np.left_shift(np.int64(1), np.arange(signs))


def linked_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding",
                   label: str = "label", cosine: float = 0.98) -> DataFrame:
    """Per row: key, n_links, component_id (smallest key reachable), kept.

    Vectors that are null, empty, zero, or hold null or non-finite numbers, and rows without a
    label, link with nothing; vectors of different lengths do not meet. Rows with equal keys
    and unequal vectors should not occur; they take part as they are. Null keys give rows whose
    component is null unless a link leads to a key.
    """
    sound = (F.col("label").isNotNull() & (F.size("v") > 0)
             & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                        & (F.abs(x) < F.lit(float("inf"))))
             & F.exists("v", lambda x: x != 0))
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"),
                     F.col(vector).cast("array<double>").alias("v"))
    rows = written(rows.withColumn("ok", F.coalesce(sound, F.lit(False)))
                   .withColumn("v", F.when(F.col("ok"), F.col("v")))
                   .withColumn("v", F.expr("transform(v, x -> x + 0.0D)"))
                   .withColumn("label", F.concat_ws("/", "label", F.size("v")))
                   .withColumn("node", F.when(F.col("ok"), F.unhex(F.sha2(F.concat(
                       F.col("label"), F.to_json(F.struct("v"))), 256)))))
    classes = written(rows.filter("ok").groupBy("node").agg(
        F.count("*").alias("rows"), F.min("id").alias("least"),
        F.any_value("label").alias("label"), F.any_value("v").alias("v")))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    signs, tables = plan(most, cosine)

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for size in set(lengths := batch.column("v").value_lengths().to_pylist()):
                some = batch.take(pa.array([i for i, n in enumerate(lengths) if n == size]))
                v = _matrix(some.column("v"))
                sig = _signatures(v / np.linalg.norm(v / np.abs(v).max(1, keepdims=True), axis=1,
                                                     keepdims=True), signs, tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [some.column("node"), some.column("label"), pa.array(sig[:, t]),
                         pa.array(np.full(len(v), t, np.int32)), some.column("rows"),
                         some.column("v")], names=["node", "label", "sig", "t", "rows", "v"])

    hashed = classes.mapInArrow(
        keys, "node binary, label string, sig long, t int, rows long, v array<double>")
    bucket = F.xxhash64("label", "sig", "t")
    sizes = hashed.groupBy(bucket.alias("bucket")).count() \
        .filter(F.col("count") > TILE).select(
            "bucket", F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("parts"))
    # buckets above TILE rows are cut into parts; every two parts meet in one tile
    parted = (hashed.withColumn("bucket", bucket).join(written(sizes), "bucket", "left")
              .withColumn("parts", F.coalesce("parts", F.lit(1)))
              .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
              .withColumn("key", F.xxhash64("bucket", F.least("part", "other"),
                                            F.greatest("part", "other")))
              .withColumn("alone", F.col("part") == F.col("other")))

    def link(batches):
        for table in whole_runs(batches):
            start, end = runs(table.column("key").to_numpy())
            for s, e in zip(start.tolist(), end.tolist()):
                group = table.slice(s, e - s)
                v = _matrix(group.column("v"))
                unit = v / np.abs(v).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                t = group.column("t").to_numpy()[0]
                part, alone = (group.column(c).to_numpy() for c in ("part", "alone"))
                weight = group.column("rows").to_numpy()
                sig = _signatures(unit, signs, t + 1)
                degree = np.zeros(len(v), np.int64)
                pairs = []
                for a in range(0, len(v), 1024):
                    i, j = np.nonzero(unit[a:a + 1024] @ unit[a:].T >= cosine)
                    i, j = i + a, j + a
                    ahead = (j > i) & (alone[i] | (part[i] != part[j]))
                    i, j = i[ahead], j[ahead]
                    first = ~(sig[i, :t] == sig[j, :t]).any(1)
                    i, j = i[first], j[first]
                    np.add.at(degree, i, weight[j])
                    np.add.at(degree, j, weight[i])
                    pairs.append((i, j))
                i, j = (np.concatenate(x) for x in zip(*pairs))
                label = smallest_labels(len(v), i, j)
                on = pa.array(np.flatnonzero(degree))
                node = group.column("node")
                yield pa.RecordBatch.from_arrays(
                    [node.take(on).combine_chunks(),
                     node.take(pa.array(label[degree > 0])).combine_chunks(),
                     pa.array(degree[degree > 0])], names=["a", "b", "links"])

    found = written(parted.repartition("key").sortWithinPartitions("key").select(
        "key", "node", "t", "rows", "v", "part", "alone")
        .mapInArrow(link, "a binary, b binary, links long"))
    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    rooted = (classes.select("node", "rows", "least").join(roots, "node", "left")
              .withColumn("root", F.coalesce("root", "node")).join(degrees, "node", "left"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = written(rooted.join(ids, "root").select(
        "node", "component_id",
        (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = rows.select("id", "node").join(facts, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
