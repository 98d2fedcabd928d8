"""Vector codes: a product quantizer whose Lloyd rounds run over cover trees.

Vectors are cut into consecutive parts, each part has its own codebook. All numbers are
integers, so results do not depend on how rows are dealt. Rows are put into blocks of bounded
size, and every block gets a cover tree for each part, once: a node's ball holds its points,
its children's balls have half its radius at most and centres that far apart. Points lie in
tree order with cumulative sums, so the sum of a subtree is a difference of two rows.

In a round a node whose ball is nearer to one entry than to any other, by the triangle
inequality, gives its whole subtree to that entry; the children of an ambiguous node are looked
at instead, down to single points, which are compared exactly. A round moves only sums of a
codebook's entries; the codebooks, of fixed size, are on the driver.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.base import fresh, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK = 4096  # vectors of a block
LEAF = 8      # points that are not split further
LIMB = 40     # bits of a partial sum's digits
LONGEST = 2 ** 63 - 1


def whole(values: list) -> np.ndarray:
    """floor(``SCALE`` * x) of rows of numbers, exactly: as floats if their squared distances
    fit, else as Python integers."""
    v = np.array(values, np.float64)
    if v.size == 0 or np.abs(v).max() * SCALE < 2 ** 24 and v.shape[-1] <= 1 << 12:
        return np.floor(v * SCALE)
    exact = [[int(x) * SCALE if abs(x) >= 2 ** 53 else math.floor(x * SCALE) for x in row]
             for row in v.tolist()]
    return np.array(exact, object).reshape(v.shape)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    if points.dtype != centres.dtype:
        points, centres = as_integers(points), as_integers(centres)
    return ((points * points).sum(1)[:, None] - 2 * points.dot(centres.T)
            + (centres * centres).sum(1)[None])


def as_integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array(
        [[int(a) for a in row] for row in x.tolist()], object).reshape(x.shape)


class Tree:
    """A cover tree; node 0 is the root.

    ``points`` in tree order, ``order``: their rows before, ``total``: cumulative sums. Of each
    node: ``start`` and ``end`` of its points, of which the first is its centre, ``radius``,
    rounded up, and ``first`` to ``last`` of its children (none: a leaf). Numbers too large
    for exact floats have no useful radius: their tree is one leaf.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        order = np.arange(n)
        start, end, radius, first, last = [0], [n], [0.0], [0], [0]
        node = 0
        while node < len(start):
            a, b = start[node], end[node]
            rows = order[a:b]
            apart = self._apart(points, rows, rows[0])
            radius[node] = float(apart.max(initial=0.0))
            first[node] = last[node] = len(start)
            if b - a > LEAF and 0 < radius[node] < np.inf:
                # children: balls of half the radius, centres outside each other's balls
                inside, left, done = radius[node] / 2, np.arange(b - a), []
                while len(left):
                    near = apart[left] <= inside if not done else self._apart(
                        points, rows[left], rows[left[0]]) <= inside
                    near[0] = True
                    done.append(left[near])
                    left = left[~near]
                order[a:b] = rows[np.concatenate(done)]
                for some in done:
                    start.append(a)
                    a += len(some)
                    end.append(a)
                    radius.append(0.0)
                    first.append(0)
                    last.append(0)
                last[node] = len(start)
            node += 1
        self.order, self.points = order, points[order]
        self.total = np.concatenate((np.zeros((1, points.shape[1]), points.dtype),
                                     np.cumsum(self.points, 0)))
        self.start, self.end = np.array(start), np.array(end)
        self.radius = np.array(radius) * (1 + 1e-9)
        self.first, self.last = np.array(first), np.array(last)

    @staticmethod
    def _apart(points, rows, one) -> np.ndarray:
        gap = points[rows] - points[one]
        if gap.dtype == object:
            return np.where((gap != 0).any(1), np.inf, 0.0)
        return np.sqrt((gap * gap).sum(1))

    def assigned(self, entries: np.ndarray):
        """Subtrees or points and their nearest entries: start, end, entry, in no order."""
        done = []
        node = np.zeros(1 if len(self.points) else 0, np.int64)
        while len(node):
            apart = distances(self.points[self.start[node]], entries)
            best = np.argmin(apart, 1)
            sure = self.radius[node] == 0
            if apart.dtype != object:
                root = np.sqrt(apart)
                near = root[np.arange(len(node)), best]
                root[np.arange(len(node)), best] = np.inf
                # strictly nearer to all points of the ball, with room for rounding
                sure |= near * (1 + 1e-9) + 2 * self.radius[node] < root.min(1) * (1 - 1e-9)
            done.append((self.start[node[sure]], self.end[node[sure]], best[sure]))
            open_ = node[~sure]
            leaf = self.first[open_] == self.last[open_]
            points = spans(self.start[open_[leaf]], self.end[open_[leaf]])
            if len(points):
                done.append((points, points + 1, np.argmin(
                    distances(self.points[points], entries), 1)))
            node = spans(self.first[open_[~leaf]], self.last[open_[~leaf]])
        return tuple(np.concatenate(x) for x in zip(*done)) if done else \
            (np.empty(0, int),) * 3

    def sums(self, entries: np.ndarray):
        """Points of each entry: number and componentwise sum."""
        start, end, entry = self.assigned(entries)
        count = np.zeros(len(entries), np.int64)
        np.add.at(count, entry, end - start)
        total = np.zeros(entries.shape, self.total.dtype)
        np.add.at(total, entry, self.total[end] - self.total[start])
        return count, total

    def coded(self, entries: np.ndarray):
        """Entry and squared distance of each point, in the order before."""
        start, end, entry = self.assigned(entries)
        by = np.argsort(start)
        code = np.empty(len(self.points), np.int64)
        code[self.order] = np.repeat(entry[by], (end - start)[by])
        gap = np.empty(self.points.shape, object if object in (
            self.points.dtype, entries.dtype) else np.float64)
        gap[self.order] = self.points
        gap = gap - entries[code]
        return code, (gap * gap).sum(1)


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start to its end."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def sound(vector: str):
    """Not null, no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < F.lit(float("inf")))), F.lit(False))


def codebooks(blocks: DataFrame, start: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after some Lloyd rounds over written blocks of trees."""
    books = start
    for _ in range(rounds):
        def run(batches, books=tuple(books)):
            for batch in batches:
                for trees in batch.column(0).to_pylist():
                    rows = []
                    for part, (tree, entries) in enumerate(zip(pickle.loads(trees), books)):
                        count, total = tree.sums(entries)
                        for e in np.flatnonzero(count).tolist():
                            rows.append((part, e, -1, 0, int(count[e])))
                            for at, value in enumerate(map(int, total[e])):
                                digit = 0
                                while value not in (0, -1) and abs(value) >> LIMB:
                                    rows.append((part, e, at, digit, value & (1 << LIMB) - 1))
                                    value >>= LIMB
                                    digit += 1
                                rows.append((part, e, at, digit, value))
                    part, entry, at, digit, value = zip(*rows) if rows else ([],) * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in (
                            (part, pa.int32()), (entry, pa.int32()), (at, pa.int32()),
                            (digit, pa.int32()), (value, pa.int64()))],
                        names=["part", "entry", "at", "digit", "value"])
        # a row for each component of an entry and each digit of its sum
        found = (blocks.select("trees").mapInArrow(
            run, "part int, entry int, at int, digit int, value long")
            .groupBy("part", "entry", "at", "digit").agg(F.sum("value").alias("value")).collect())
        sums: dict = {}
        for r in found:
            key = r.part, r.entry, r["at"]
            sums[key] = sums.get(key, 0) + (r.value << LIMB * r.digit)
        after = []
        for part, entries in enumerate(books):
            new = as_integers(entries).copy()
            for e in range(len(new)):
                n = sums.get((part, e, -1))
                if n:
                    new[e] = [sums[part, e, a] // n for a in range(new.shape[1])]
            after.append(_small(new))
        books = after
    return books


def _small(entries: np.ndarray) -> np.ndarray:
    """Floats if squared distances to them are exact in floats."""
    fits = all(abs(x) <= 2 ** 24 for row in entries.tolist() for x in row)
    return entries.astype(np.float64) if fits and entries.shape[1] <= 16 else entries


def sha256_of(books: list[np.ndarray]) -> str:
    """Checksum of all components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(
        str(int(x)) for book in books for row in book.tolist() for x in row).encode()).hexdigest()


def coded(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
          entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per sound vector: key, code (two hex digits a part), error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are left out, and so are
    those whose length differs from that of the smallest key's vector or is not a positive
    multiple of ``PARTS``. Codebooks start from the ``entries`` smallest keys, ties by the
    vector, null keys last; with fewer rows they are as small. Repeated keys and vectors are
    rows of their own, equal distances take the lower entry. An error above the range of a long
    is its greatest value. Null labels are one label. An empty table gives no rows.
    """
    slim = df.select(F.col(key).alias("id"), F.col(label).alias("label"),
                     F.col(vector).cast("array<double>").alias("v")).filter(sound("v"))
    first = slim.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    length = len(first[0].v) if first else 0
    first = [r.v for r in first if len(r.v) == length]
    usable = length > 0 and length % PARTS == 0
    slim = slim.filter(F.lit(usable) & (F.size("v") == length))
    if len(first) < entries and usable:
        # rows of other lengths were among the smallest
        first = [r.v for r in slim.orderBy(F.col("id").asc_nulls_last(), "v")
                 .select("v").limit(entries).collect()]
    books = [_small(as_integers(b)) for b in np.split(
        whole(first), PARTS, 1)] if usable else []
    id_kind, label_kind = (slim.schema[c].dataType.simpleString() for c in ("id", "label"))

    def planted(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                points = whole(some.column(2).to_pylist())
                trees = [Tree(np.ascontiguousarray(p)) for p in np.split(points, PARTS, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some.column(0).to_pylist()], pa.list_(some.schema.field(0).type)),
                     pa.array([some.column(1).to_pylist()], pa.list_(some.schema.field(1).type)),
                     pa.array([pickle.dumps(trees)], pa.binary())],
                    names=["ids", "labels", "trees"])
    blocks = written(slim.mapInArrow(
        planted, f"ids array<{id_kind}>, labels array<{label_kind}>, trees binary"))
    books = codebooks(blocks, books, rounds) if usable else books

    def code(batches):
        for batch in batches:
            for ids, labels, trees in zip(batch.column(0), batch.column(1),
                                          batch.column(2).to_pylist()):
                found = [t.coded(b) for t, b in zip(pickle.loads(trees), books)]
                error = [min(LONGEST, int(sum(map(int, e)))) for e in zip(*(e for _, e in found))]
                text = ["".join(f"{int(c):02x}" for c in row) for row in zip(*(c for c, _ in found))]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(text, pa.string()),
                     pa.array(error, pa.int64())], names=["id", "label", "code", "error"])
    rows = written(blocks.mapInArrow(
        code, f"id {id_kind}, label {label_kind}, code string, error long"))
    own = fresh("own", rows)
    sums = rows.groupBy(F.col("label").alias(own)).agg(F.least(
        F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)"))
        .cast("long").alias("label_error"))
    return rows.join(written(sums), F.col("label").eqNullSafe(F.col(own))).select(
        F.col("id").alias(key), "code", "error", "label_error",
        F.lit(sha256_of(books)).alias("codebooks_sha256"))
