"""Packing documents into token windows next to their lexical neighbours.

Documents are dealt to shards of bounded size by content: a tree of planes, fitted to a sample,
cuts the space of term vectors where few documents lie, so a shard holds documents that share
heavy terms however many documents there are. A shard that grows too large, as of copies or of
long texts, is split at random. A shard holds a BM25 inverted index over its documents' token ids, weighed by
the frequencies in the whole table. A seed
document opens a window; the index returns its unused neighbours, best first, which fill the
window. A document that does not fit is cut, and its rest seeds the next window, so all windows
are full but a shard's last: that is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.base import slices, written
from tillscope.llm.groups import whole_runs
from tillscope.llm.tokens import SPECIAL, encoder, tokenizer_path

WINDOW = 1024
END = 0            # id behind every document
SHARD = 2_000      # documents of a shard, on average; twice as many at most, about
DIMENSIONS = 128   # of a term vector
PER_SHARD = 20     # documents of the sample for each shard
SAMPLE = 120_000   # documents of the sample at most
SEED = 42
K1, B = 1.2, 0.75


def weights_of(df: np.ndarray, n: int) -> np.ndarray:
    """BM25 weight of terms that ``df`` of ``n`` documents hold."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Index:
    """BM25 postings of a shard in three arrays, ordered by term.

    ``weight``: of each term id, and ``mean``: length of a document, in the whole table;
    without them, those of the shard. A document asks with all its terms.
    """

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray | None = None,
                 mean: float | None = None):
        n = self.n = len(docs)
        length = np.array([len(d) for d in docs])
        held = [np.unique(d, return_counts=True) for d in docs]
        term = np.concatenate([t for t, _ in held]).astype(np.int64) if n else np.empty(0, int)
        tf = np.concatenate([c for _, c in held]) if n else np.empty(0, int)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in held])
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        known, term, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = weights_of(df, n) if weight is None else weight[known]
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if mean is None else mean))
        score = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        # terms of many documents as columns, others as lists; a term of one document tells nothing
        column = np.full(len(df), -1)
        many = np.flatnonzero(df > max(8, n // 8))
        column[many] = np.arange(len(many))
        dense = column[term] >= 0
        self.table = np.zeros((n, len(many)), np.float32)
        self.table[doc[dense], column[term[dense]]] = score[dense]
        rare = ~dense & (df[term] > 1)
        self.doc, self.score = doc[rare], score[rare]
        count = np.bincount(term[rare], minlength=len(df))
        self.first, self.count = np.cumsum(count) - count, count
        order = np.argsort(doc[rare], kind="stable")
        self.terms = np.split(term[rare][order], np.cumsum(np.bincount(
            self.doc, minlength=n))[:-1]) if n else []

    def neighbours(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for the seed's terms."""
        out = (self.table @ (self.table[seed] > 0).astype(np.float32)).astype(np.float64)
        t = self.terms[seed]
        count = self.count[t]
        at = np.repeat(self.first[t] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return out + np.bincount(self.doc[at], self.score[at], minlength=self.n)


def packed_shard(docs: list[np.ndarray], window: int = WINDOW, weight: np.ndarray | None = None,
                 mean: float | None = None):
    """Pieces (document, start, length, sequence, offset) that cover all documents.

    ``docs``: ids of each document, the end id included, so none is empty. Of equal scores the
    first document is taken. Copies of a document that a window holds do not join it while any
    other document is free.
    """
    index = Index([d[:-1] for d in docs], weight, mean)
    known: dict[bytes, int] = {}
    content = np.array([known.setdefault(d.tobytes(), len(known)) for d in docs], np.int64)
    held = np.zeros(len(docs), bool)  # documents equal to one in the open window
    free = np.ones(len(docs), bool)
    following = 0  # the first document that may be unused
    pieces, sequence, filled, seed, scores = [], 0, 0, None, None
    for _ in range(len(docs)):
        best = -1
        if filled and seed is not None:
            if scores is None:
                scores = index.neighbours(seed)
                scores[~free | held] = 0
            best = int(scores.argmax())
            if scores[best] <= 0:
                best = -1
        if best < 0:  # an empty window, or no neighbour is left: the next seed
            while not free[following]:
                following += 1
            best, scores = following, None
            if held[best] and (other := free & ~held).any():
                best = int(other.argmax())
            seed = best
        free[best] = False
        held |= content == content[best]
        if scores is not None:
            scores[held] = 0
        start, size = 0, len(docs[best])
        while start < size:
            take = min(size - start, window - filled)
            pieces.append((best, start, take, sequence, filled))
            start += take
            filled += take
            if filled == window:
                sequence, filled = sequence + 1, 0
                seed, scores = (best, None) if start < size else (None, None)
                held = content == (content[best] if start < size else -1)
    if filled & (filled - 1):
        pieces = _at_powers(pieces, sequence, filled)
    return pieces


def _at_powers(pieces, sequence: int, filled: int):
    """The last sequence as several whose lengths are the powers of two in ``filled``."""
    done = [p for p in pieces if p[3] != sequence]
    rest = [list(p[:3]) for p in pieces if p[3] == sequence]
    while filled:
        size = 1 << (filled.bit_length() - 1)
        filled -= size
        offset = 0
        while offset < size:
            doc, start, length = rest[0]
            take = min(length, size - offset)
            done.append((doc, start, take, sequence, offset))
            offset += take
            rest[0] = [doc, start + take, length - take]
            if take == length:
                rest.pop(0)
        sequence += 1
    return done


def vectors(docs: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Unit vectors of documents: random directions of their terms, by frequency and weight."""
    planes = _directions(len(weight))
    out = np.zeros((len(docs), DIMENSIONS), np.float32)
    for i, d in enumerate(docs):
        term, tf = np.unique(d, return_counts=True)
        out[i] = ((1 + np.log(tf)) * weight[term]).astype(np.float32) @ planes[term]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


_known: dict[int, np.ndarray] = {}


def _directions(terms: int) -> np.ndarray:
    if terms not in _known:
        _known[terms] = np.random.default_rng(SEED).standard_normal(
            (terms, DIMENSIONS), dtype=np.float32)
    return _known[terms]


def fitted(sample: np.ndarray, shards: int):
    """A tree of planes with about ``shards`` leaves: (plane, bound, below, above) per node.

    A child below 0 is the leaf ``-1 - child``. A node is cut at the widest gap near its middle
    along its direction of greatest variance; a node whose vectors are equal is a leaf.
    """
    nodes, leaves = [], 0

    def grow(rows: np.ndarray, count: int) -> int:
        nonlocal leaves
        if count > 1 and len(rows) > 3:
            centred = rows - rows.mean(0)
            _, axes = np.linalg.eigh(centred.T @ centred)
            plane = np.ascontiguousarray(axes[:, -1])
            at = np.sort(rows @ plane)
            low, high = int(len(at) * 0.4), max(int(len(at) * 0.4) + 1, int(len(at) * 0.6))
            gap = np.diff(at[low:high + 1])
            if gap.max() < 1e-4:  # copies in the middle: the widest gap anywhere
                low, gap = 0, np.diff(at)
            if gap.max() >= 1e-4:
                k = low + int(gap.argmax())
                bound = (at[k] + at[k + 1]) / 2
                above = rows @ plane > bound
                share = min(count - 1, max(1, round(count * (~above).mean())))
                nodes.append(None)
                me = len(nodes) - 1
                nodes[me] = (plane, bound, grow(rows[~above], share),
                             grow(rows[above], count - share))
                return me
        leaves += 1
        return -leaves

    root = grow(sample, shards)
    if root < 0:
        return None
    plane, bound, below, above = zip(*nodes)
    return np.array(plane, np.float32), np.array(bound, np.float32), np.array(below), \
        np.array(above)


def leaf_of(rows: np.ndarray, tree) -> np.ndarray:
    """Number of the leaf of each vector."""
    at = np.zeros(len(rows), np.int64)
    if tree is None:
        return at
    plane, bound, below, above = tree
    while (on := np.flatnonzero(at >= 0)).size:
        node = at[on]
        up = (rows[on] * plane[node]).sum(1) > bound[node]
        at[on] = np.where(up, above[node], below[node])
    return -1 - at


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
           window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents: key, start, length, ids (binary, little-endian 32 bit),
    doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Rows are packed as they are, repeated and null
    keys too. An empty table gives no rows.
    """
    path = path or tokenizer_path()
    with open(path, "rb") as ranks:
        # two bytes an id between the steps where the vocabulary allows it
        last = max(*(int(x.split()[1]) for x in ranks if x.strip()), *SPECIAL.values())
    code = "<u2" if last < 1 << 16 else "<u4"
    end = np.array([END], code).tobytes()

    def encoded(batches):
        for batch in slices(batches):
            ids = [encoder(path).ids(t) for t in batch.column(2).to_pylist()]
            # documents of these that hold each term, with the first of them
            term, df = np.unique(np.concatenate([np.unique(i) for i in ids]),
                                 return_counts=True)
            rest = [None] * (len(ids) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([i.astype(code).tobytes() + end for i in ids], pa.binary()),
                 pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([term.astype("<u4").tobytes(), *rest], pa.binary()),
                 pa.array([df.astype("<u4").tobytes(), *rest], pa.binary())],
                names=["id", "row", "ids", "tokens", "terms", "df"])

    kind = dict(docs.dtypes)[key]
    known = written(docs.select(
        F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.col(text).alias("text")).mapInArrow(
            encoded, f"id {kind}, row long, ids binary, tokens long, terms binary, df binary"))

    def frequencies(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for term, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = np.bincount(np.frombuffer(term, "<u4"), np.frombuffer(df, "<u4"),
                                  len(total)).astype(np.int64)
                one[:len(total)] += total
                total = one
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])],
                                         names=["term", "df"])

    n, tokens = known.agg(F.count("*"), F.sum("tokens")).first()
    counted = known.select("terms", "df").filter("terms is not null") \
        .mapInArrow(frequencies, "term long, df long") \
        .groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(counted["term"].max()) + 1 if len(counted) else 1)
    df[counted["term"]] = counted["df"]
    weight, mean = weights_of(df, n), (tokens or 0) / max(1, n)

    def sketched(batches):
        for batch in slices(batches):
            rows = [np.frombuffer(r, code)[:-1] for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in vectors(rows, weight)], pa.binary()),
                 pa.array([len(r) for r in rows], pa.int64())], names=["v", "tokens"])

    shards = max(1, math.ceil(n / shard))
    tree, parts = None, np.ones(1, np.int64)
    if shards > 1:
        share = min(1.0, min(SAMPLE, PER_SHARD * shards + 2_000) / n)
        some = known.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = some.select("ids").mapInArrow(sketched, "v binary, tokens long").toPandas()
        held = sample["tokens"].to_numpy()
        sample = np.frombuffer(b"".join(sample["v"]), np.float32).reshape(-1, DIMENSIONS)
        tree = fitted(sample, shards)
        # leaves that the sample shows to be large are split at random: into the mean number of
        # documents, and of tokens no more than two shards have on average
        leaf = leaf_of(sample, tree)
        scale = n / max(1, len(sample))
        size = np.bincount(leaf) * scale
        most = np.bincount(leaf, held) * scale / (2 * shard * max(1, mean))
        parts = np.maximum(np.where(size > 1.5 * shard, np.ceil(size / shard), 1),
                           np.ceil(most)).astype(np.int64)

    def leaves(batches):
        for batch in slices(batches):
            rows = [np.frombuffer(r, code)[:-1] for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf_of(vectors(rows, weight), tree)), *batch.columns],
                names=["leaf", *batch.schema.names])

    dealt = known.select("id", "row", "ids").mapInArrow(leaves, f"leaf long, id {kind}, row long, ids binary")
    salt = F.pmod(F.xxhash64("id", "row"), F.get(F.lit(parts.tolist()), F.col("leaf").cast("int")))
    dealt = dealt.select((F.col("leaf") * (1 << 16) + salt).alias("key"), "id", "row", "ids")

    def run(batches):
        for table in whole_runs(batches):
            number = table.column("key").to_numpy()
            cut = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(number)]):
                group = table.slice(a, b - a)
                ids = [np.frombuffer(r, code) for r in group.column("ids").to_pylist()]
                doc, start, length, sequence, offset = np.array(
                    packed_shard(ids, window, weight, mean), np.int64).T
                yield pa.RecordBatch.from_arrays([
                    group.column("id").combine_chunks().take(pa.array(doc)), pa.array(start),
                    pa.array(length), pa.array([
                        ids[d][s:s + n].astype("<u4").tobytes() for d, s, n in zip(
                            doc.tolist(), start.tolist(), length.tolist())], pa.binary()),
                    pa.array(np.array([len(i) for i in ids])[doc]),
                    pa.array(sequence + (int(number[a]) << 24)), pa.array(offset)],
                    names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return (dealt.repartition("key").sortWithinPartitions("key", "id", "row").mapInArrow(
        run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, "
             "sequence_id long, offset long"))
