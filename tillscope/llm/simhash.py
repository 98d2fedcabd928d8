"""SimHash near-duplicates: pivot distance tables over fingerprints.

A fingerprint has a bit for each bit of the shingle hashes, set if it is set in over half of
them. Documents with one fingerprint are one class; only distinct fingerprints are compared.

Distances to random reference fingerprints (pivots) discard pairs: those of two fingerprints
at distance d differ by at most d at every pivot. In 64 bits a pivot alone keeps 57 % of the
random pairs at distance 4, so pivots cannot propose pairs; key tables do: fingerprints that
agree on some bits share a bucket. ``exact_tables`` cuts the bits into blocks and takes every
choice of blocks that an allowed pair must share, so no link is lost. ``sampled_tables``
takes random bits, for distances at which that would need too many tables. In a bucket the
pivots discard pairs by the largest difference, and the full distance verifies the survivors.
Buckets give stars, never all their pairs, and connected components join them.

A bucket of many fingerprints, as of one family of pages, is not searched: its fingerprints
get longer keys, of one block more, and so on until buckets are small. A pair that shares a
bucket which is searched is found there; of any other pair both go on, and meet again.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.base import fresh, slices, written
from tillscope.llm.components import components
from tillscope.llm.groups import runs, smallest_labels, whole_runs

SEED = 42
PIVOTS = 8
BUCKET = 16  # random fingerprints that a bucket may hold on average
LARGE = 4096  # fingerprints of a bucket above which they get longer keys
LONGEST = 48  # bits of a key: at distance 4 no bucket of 64-bit fingerprints exceeds 2**16 then
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; fewer words: of all of them."""
    import xxhash

    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)),
                       np.uint64, n)


def majority(hashes: np.ndarray, words: int) -> bytes:
    """The fingerprint, ``words`` times 64 bits, most significant byte first."""
    if not len(hashes):
        return bytes(8 * words)
    out = []
    for w in range(words):
        h = hashes if w == 0 else _mixed(hashes + MULTIPLIER * np.full(1, w, np.uint64))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(h)).tobytes())
    return b"".join(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, to draw further hashes from one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4, words: int = 1,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of ``docs`` and the fingerprint ``fp`` (binary) of the whole text."""
    slim = docs.select(*keep, F.col(text).cast("binary").alias("fp"))
    names = list(keep) + ["fp"]

    def run(batches):
        for batch in slices(batches):
            prints = [majority(shingle_hashes(t, size), words)
                      for t in batch.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names) - 1)] + [pa.array(prints, pa.binary())],
                names=names)
    schema = slim.schema
    return slim.mapInArrow(run, schema)


def block_tables(bits: int, distance: int, blocks: int) -> list[np.ndarray]:
    """Bit positions of each key table: every choice of all but ``distance`` of the blocks."""
    parts = np.array_split(np.arange(bits), blocks)
    return [np.concatenate([parts[i] for i in c])[:LONGEST]
            for c in combinations(range(blocks), blocks - distance)]


def exact_tables(bits: int, distance: int, rows: int) -> list[list[np.ndarray]]:
    """Key tables, and those with longer keys for the fingerprints of large buckets, and so on;
    in each of them pairs within ``distance`` agree on one table at least.

    ``distance`` bits spoil as many blocks at most, so of b blocks b - ``distance`` agree.
    More blocks give longer keys and more tables. The first have the fewest that keep buckets
    small, but two shared blocks at least, so that the rows made per fingerprint stay the same
    up to 2**24; each further level has a block more.
    """
    wanted = min(LONGEST, math.log2(max(rows, 2) / BUCKET))
    levels = []
    for blocks in range(distance + 2, 4 * distance + 1):
        tables = block_tables(bits, distance, blocks)
        shortest = min(map(len, tables))
        if levels or shortest >= wanted or blocks == distance + 5:
            levels.append(tables)
        if levels and shortest >= LONGEST:
            break
    return levels or [block_tables(bits, distance, distance + 2)]


def sampled_tables(bits: int, differing: float, recall: float, rows: int) -> list[np.ndarray]:
    """Random bits per table: a pair that differs in that share of bits meets with ``recall``."""
    k = int(min(48, max(8, math.ceil(math.log2(max(rows, 2) / BUCKET)))))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing) ** k))
    rng = np.random.default_rng(SEED)
    return [rng.choice(bits, k, replace=False) for _ in range(count)]


def _words(column) -> np.ndarray:
    """Fingerprints as rows of unsigned 64-bit words."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.frombuffer(b"".join(raw.to_pylist()), dtype=">u8").astype(np.uint64)
    return flat.reshape(len(raw), -1)


def _links(fp: np.ndarray, start: np.ndarray, end: np.ndarray, distance: int):
    """Index pairs whose links connect what links within the runs connect."""
    rng = np.random.default_rng(SEED)
    pivots = rng.integers(0, 2 ** 64, (PIVOTS, fp.shape[1]), dtype=np.uint64)
    table = np.stack([np.bitwise_count(fp ^ p).sum(1, dtype=np.int16) for p in pivots], 1)

    def near(i, j):
        likely = np.abs(table[i] - table[j]).max(1) <= distance
        i, j = i[likely], np.broadcast_to(j, likely.shape)[likely]
        close = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= distance
        return i[close], j[close]

    out = []
    length = end - start
    small = length <= 2 * BUCKET
    s, e = start[small], end[small]
    for d in range(1, int(length[small].max(initial=1))):
        on = e - s > d
        s, e = s[on], e[on]
        # all rows of the runs that have one d places on
        n = e - s - d
        i = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        out.append(near(i, i + d))
    for s, e in zip(start[~small], end[~small]):
        rest = np.arange(s, e)
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                hit, _ = near(rest, np.array([one := todo.pop()]))
                if len(hit):
                    out.append((hit, np.full(len(hit), one)))
                    todo.extend(hit.tolist())
                    rest = rest[~np.isin(rest, hit)]
    if not out:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def keyed(classes: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """``key`` of every table and ``fp``, for each fingerprint."""
    def keys(batches):
        for batch in batches:
            raw = batch.column(0).to_pylist()
            if not raw:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), 1)
            for t, where in enumerate(tables):
                weights = np.left_shift(np.int64(1), np.arange(len(where)))
                key = bits[:, where].astype(np.int64) @ weights + (np.int64(t) << np.int64(48))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch.column(0)], names=["key", "fp"])

    return classes.select("fp").mapInArrow(keys, "key long, fp binary")


def searched(rows: DataFrame, distance: int) -> DataFrame:
    """Edges ``a``, ``b`` that connect what links within the buckets ``key`` connect."""
    def link(batches):
        for table in whole_runs(batches):
            start, end = runs(table.column("key").to_numpy())
            if not len(start):
                continue
            rows = np.repeat(start - np.concatenate(([0], np.cumsum(end - start)[:-1])),
                             end - start) + np.arange((end - start).sum())
            raw = table.column("fp").take(pa.array(rows))
            e = np.cumsum(end - start)
            i, j = _links(_words(raw), e - (end - start), e, distance)
            label = smallest_labels(len(rows), i, j)
            linked_ = np.flatnonzero(label != np.arange(len(rows)))
            if len(linked_):
                yield pa.RecordBatch.from_arrays(
                    [raw.take(pa.array(linked_)).combine_chunks(),
                     raw.take(pa.array(label[linked_])).combine_chunks()], names=["a", "b"])

    return (rows.repartition("key").sortWithinPartitions("key")
            .mapInArrow(link, "a binary, b binary"))


def linked(classes: DataFrame, levels: list[list[np.ndarray]], distance: int,
           large: int = LARGE) -> DataFrame:
    """Edges ``a``, ``b`` between fingerprints ``fp`` that connect what links connect.

    Buckets of more than ``large`` fingerprints are left to the next level, which has the
    fingerprints of such buckets only; the last level searches all its buckets.
    """
    found = None
    for tables in levels[:-1]:
        rows = written(keyed(classes, tables))
        crowded = written(rows.groupBy("key").agg(F.count("*").alias("n"))
                          .filter(F.col("n") > large).select("key"))
        edges = searched(rows.join(crowded, "key", "left_anti"), distance)
        found = edges if found is None else found.union(edges)
        if crowded.isEmpty():
            return found
        classes = written(rows.join(crowded, "key", "left_semi").select("fp").distinct())
    edges = searched(keyed(classes, levels[-1]), distance)
    return edges if found is None else found.union(edges)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4,
                    words: int = 1, distance: int = 4, sampled: tuple[float, float] | None = None
                    ) -> DataFrame:
    """Per document: key, ``fp`` and ``component_id``, the smallest key reachable by links.

    Links join fingerprints that differ in ``distance`` bits at most. ``sampled``: share of
    differing bits and recall, for tables of sampled bits; without it tables are exact.
    Null and wordless texts have the zero fingerprint, linked like any other; rows with equal
    keys stay apart; a null key is never a component's id unless it has no other. An empty
    table gives no rows.
    """
    rows = written(fingerprints(docs.select(F.col(key).alias("id"), text), text, size, words,
                                ("id",)))
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("least")))
    count = classes.count()
    levels = [sampled_tables(64 * words, *sampled, count)] if sampled else \
        exact_tables(64 * words, distance, count)
    roots = components(linked(classes, levels, distance))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(rooted.join(ids, "root").select("fp", "component_id"))
    return rows.join(found, "fp").select(F.col("id").alias(key), "fp", "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4,
                 distance: int = 4) -> DataFrame:
    """One row of each component of ``near_duplicates``, with the columns of ``docs``.

    The row with the smallest key stays, of equal keys that with the smallest hash of its text;
    a row without a key stays if its group has no key. Rows are told apart by key and text:
    different texts with one key are different documents, rows equal in both are copies.
    """
    row = F.struct(F.col(key).isNull().alias("keyless"), F.col(key).alias("id"),
                   F.xxhash64(text).alias("h"))
    found = near_duplicates(docs.select(row.alias("row"), text), "row", text, size,
                            distance=distance)
    own, hashed = fresh("own", docs), fresh("hashed", docs)
    keep = written(found.filter(F.col("row").eqNullSafe(F.col("component_id"))).select(
        F.col("row.id").alias(own), F.col("row.h").alias(hashed + "_")).distinct())
    return (docs.withColumn(hashed, F.xxhash64(text))
            .join(keep, F.col(key).eqNullSafe(F.col(own))
                  & (F.col(hashed) == F.col(hashed + "_")), "left_semi")
            .dropDuplicates([key, hashed]).drop(hashed))
