"""Language-model scores by context-tree weighting over bytes.

A text is its words with A-Z lower-cased, joined by one blank and closed by a line feed. A byte
is eight binary decisions, each a node of a binary tree of 255; every decision has a tree of
contexts, the last 0 to ``DEPTH`` bytes before it. A context's Krichevsky-Trofimov estimate
and the product of its children's weighted probabilities are mixed half and half, down from the
root, so that every depth has a say in a probability.

The model grows with the corpus and is never in one place. Documents are written as blocks of
some megabytes; a block sends each distinct run of ``DEPTH`` + 1 bytes (a gram) and each distinct
word once, with its count, to the shard that owns it. A shard owns whole subtrees: contexts are
dealt by their last three bytes, so that a subtree has at most 2**24 grams. Weighted
probabilities of subtrees rise level by level, a context having 256 children at most; only the
children of the root (256 contexts of 255 decisions) meet on the driver. The shards then answer
each block's grams and words, and a block scores its own texts with them.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.base import fresh, written
from tillscope.llm.groups import whole_runs

DEPTH = 5           # context bytes; a gram of DEPTH + 1 bytes fits a signed 64-bit number
OWNED = 3           # context bytes by which grams are dealt to shards
BLOCK = 32 << 20    # bytes of text that a block holds, about
PIECE = 1 << 20     # a longer text is cut between words
CHUNK = 4 << 20     # bytes or grams worked on at a time
SHARDS = 4096       # at most; otherwise one for each block
END = b"\n"         # closes a text; no word holds it
HEAD = END * DEPTH  # what stands before a text
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HALF = np.log(0.5)


def pieces_of(text: str | None) -> list[bytes]:
    """The canonical text in pieces, each with the ``DEPTH`` bytes that precede it in front."""
    raw = b" ".join(text.encode().translate(LOWER).split()) + END if text else END
    if len(raw) <= PIECE:
        return [HEAD + raw]
    raw, out, start = HEAD + raw, [], DEPTH
    while start < len(raw):
        end = raw.find(b" ", start + PIECE) + 1 or len(raw)
        out.append(raw[start - DEPTH:end])
        start = end
    return out


def words_of(piece: bytes) -> list[bytes]:
    """Words of a piece, and the end if the text ends in it."""
    words = piece[DEPTH:].split()
    if piece.endswith(END):
        words.append(END)
    return words


def grams_of(pieces: list[bytes]) -> np.ndarray:
    """One number for each byte of the pieces: its context, the nearest byte first, then it."""
    buffer = np.frombuffer(b"".join(pieces), np.uint8)
    out = np.zeros(len(buffer) - DEPTH, np.int64)
    for d in [*range(1, DEPTH + 1), 0]:
        out <<= 8
        out |= buffer[DEPTH - d:len(buffer) - d]
    if len(pieces) > 1:
        keep = np.ones(len(out), bool)
        edge = np.cumsum([len(p) for p in pieces])[:-1]
        keep[(edge[:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
        out = out[keep]
    return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Distinct keys in ascending order, and the sum of each one's counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(n, first) if len(n) else n


def _firsts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else \
        np.empty(0, np.int64)


def packed(key: np.ndarray) -> bytes:
    """Ascending numbers by their differences, which compress well."""
    return np.diff(key, prepend=0).astype("<i8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<i8"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers, by Stirling's series from x + 8."""
    small = np.zeros(len(x))
    for i in range(8):
        small += np.log(x + i)
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - small


class Level:
    """Contexts of one depth: decisions, their estimates and their weighted probabilities.

    ``entry``: context << 8 | next byte, ascending, and its count ``n``. ``child``: keys
    (context << 8 | decision) of the next depth's decisions and the logarithm of their weighted
    probability; none at the greatest depth.
    """

    def __init__(self, entry: np.ndarray, n: np.ndarray, child=None):
        self.entry, self.n = entry, n
        node, total, ones = [], [], []
        for k in range(8):
            at = entry >> (8 - k)
            first = _firsts(at)
            at = at[first]
            node.append((at >> k) << 8 | 1 << k | at & (1 << k) - 1)
            total.append(np.add.reduceat(n, first) if len(n) else n)
            ones.append(np.add.reduceat(n * (entry >> (7 - k) & 1), first) if len(n) else n)
        node, total, ones = map(np.concatenate, (node, total, ones))
        order = np.argsort(node)
        self.node, total, ones = node[order], total[order], ones[order]
        own = (log_gamma(total - ones + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi)
               - log_gamma(total + 1.0))
        if child is None:
            self.weighted, self.weight = own, np.ones(len(own))
        else:
            key, weighted = child
            at = np.searchsorted(self.node, key >> 16 << 8 | key & 255)
            below = np.bincount(at, weighted, len(self.node))
            self.weighted = np.logaddexp(HALF + own, HALF + below)
            self.weight = np.exp(np.minimum(HALF + own - self.weighted, 0.0))
        self.one = (ones + 0.5) / (total + 1.0)

    def above(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries and counts of the contexts one byte shorter."""
        return summed([self.entry >> 16 << 8 | self.entry & 255], [self.n])

    def mixed(self, entry: np.ndarray, known: np.ndarray, left: np.ndarray):
        """``known``: probability so far of each decision of the entries, by shorter contexts;
        ``left``: the weight that these leave. Both with this depth taken in."""
        byte, context = entry & 255, entry >> 8 << 8
        known, left = known.copy(), left.copy()
        for k in range(8):
            at = np.searchsorted(self.node, context | 1 << k | byte >> (8 - k))
            p = np.where(byte >> (7 - k) & 1, self.one[at], 1 - self.one[at])
            known[:, k] += left[:, k] * self.weight[at] * p
            left[:, k] *= 1 - self.weight[at]
        return known, left


def subtree(gram: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of depth ``OWNED`` to ``DEPTH`` over whole subtrees."""
    levels = [Level(gram, n)]
    for _ in range(DEPTH - OWNED):
        below = levels[-1]
        levels.append(Level(*below.above(), (below.node, below.weighted)))
    return levels[::-1]


def _binary(rows) -> pa.Array:
    return pa.array(rows, pa.binary())


def _frame(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    owner = (gram >> 8 * (DEPTH - OWNED + 1)).astype(np.uint64)
    return ((owner * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def blocks_of(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """Written table of pieces: block, row (one for each row of ``docs``), id, train, piece."""
    kind = docs.schema[key].dataType
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"),
                       F.coalesce(train, F.lit(False)).alias("train"),
                       F.col(text).alias("text"))

    def cut(batches):
        block, held, count = None, 0, 0
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                index, number, pieces = [], [], []
                for i, (row, one) in enumerate(zip(batch.column(0).to_pylist(),
                                                   batch.column(3).to_pylist())):
                    for piece in pieces_of(one):
                        if block is None or held > BLOCK:
                            # the task's part of the row number, and a count
                            block, held, count = (row >> 33 << 33) + count, 0, count + 1
                        held += len(piece)
                        index.append(i)
                        number.append(block)
                        pieces.append(piece)
                take = batch.select([0, 1, 2]).take(pa.array(index, pa.int64()))
                yield _frame({"block": pa.array(number, pa.int64()), "row": take.column(0),
                              "id": take.column(1), "train": take.column(2),
                              "piece": _binary(pieces)})
    out = slim.mapInArrow(cut, f"block long, row long, id {kind.simpleString()}, train boolean, "
                               "piece binary")
    return written(out, compression="zstd")


def sendings(pieces: DataFrame, shards: int, counted: bool) -> DataFrame:
    """What each block sends to the shards: part, block, keys, n.

    ``part``: shard of grams, or ``shards`` + shard of words. Grams are packed, words joined by
    blanks; ``n``: how often they occur in training texts, if ``counted``.
    """
    def rows(block, grams, words):
        gram, n = summed(*zip(*grams))
        shard = _shard_of(gram, shards)
        order = np.argsort(shard, kind="stable")
        gram, n = gram[order], n[order]
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        part, keys, counts = [], [], []
        for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if a < b:
                part.append(s)
                keys.append(packed(gram[a:b]))
                counts.append(n[a:b].astype("<i8").tobytes())
        dealt: list[list] = [[] for _ in range(shards)]
        for word in words:
            dealt[zlib.crc32(word) % shards].append(word)
        for s, some in enumerate(dealt):
            if some:
                part.append(shards + s)
                keys.append(b" ".join(some))
                counts.append(np.array([words[w] for w in some], "<i8").tobytes())
        out = {"part": pa.array(part, pa.int32()),
               "block": pa.array([block] * len(part), pa.int64()), "keys": _binary(keys)}
        if counted:
            out["n"] = _binary(counts)
        return _frame(out)

    def run(batches):
        block, grams, words, held = None, [], Counter(), {True: [], False: []}

        def work():
            for train, some in held.items():
                if some:
                    key, n = np.unique(grams_of(some), return_counts=True)
                    grams.append((key, n if train else np.zeros_like(n)))
                    some.clear()
            if len(grams) > 4:
                grams[:] = [summed(*zip(*grams))]

        size = 0
        for batch in batches:
            for b, train, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                       batch.column(2).to_pylist()):
                if b != block and block is not None:
                    work()
                    yield rows(block, grams, words)
                    grams.clear()
                    words.clear()
                    size = 0
                block = b
                held[train].append(piece)
                if train:
                    words.update(words_of(piece))
                else:
                    for w in words_of(piece):
                        words[w] += 0
                size += len(piece)
                if size > CHUNK:
                    work()
                    size = 0
        if block is not None:
            work()
            yield rows(block, grams, words)
    schema = "part int, block long, keys binary" + (", n binary" if counted else "")
    return pieces.select("block", "train", "piece").mapInArrow(run, schema)


def _levelled(context: list[int], bytes_: list[bytes], counts: list[bytes], nodes: list[bytes],
              weighted: list[bytes]) -> Level:
    """The level above that of some contexts, given by row: next bytes and counts, decisions
    and weighted probabilities."""
    def spread(raw):
        part = [np.frombuffer(r, np.uint8).astype(np.int64) for r in raw]
        return np.repeat(np.array(context, np.int64), [len(p) for p in part]) << 8, \
            np.concatenate(part)
    high, byte = spread(bytes_)
    entry, n = summed([high >> 16 << 8 | byte], [np.frombuffer(b"".join(counts), "<i8")])
    high, node = spread(nodes)
    return Level(entry, n, (high | node, np.frombuffer(b"".join(weighted), "<f8")))


RISING = "s long, byte binary, n binary, node binary, weighted binary"


def _rising(level: Level) -> dict:
    """A row for each context of a level, as ``_levelled`` takes them."""
    at, node_at = level.entry >> 8, level.node >> 8
    first, node_first = _firsts(at), _firsts(node_at)

    def cut(values, first, kind):
        raw = values.astype(kind)
        return _binary([x.tobytes() for x in np.split(raw, first[1:])] if len(first) else [])
    return {"s": pa.array(at[first], pa.int64()), "byte": cut(level.entry & 255, first, "u1"),
            "n": cut(level.n, first, "<i8"), "node": cut(level.node & 255, node_first, "u1"),
            "weighted": cut(level.weighted, node_first, "<f8")}


def counted(sent: DataFrame, shards: int) -> DataFrame:
    """Sums of what the blocks sent: part, keys, n; of grams a row for each context of
    ``OWNED`` bytes, with that context as ``s`` and what rises from it."""
    shift = 8 * (DEPTH - OWNED + 1)

    def of_grams(part, key, n):
        level = subtree(key, n)[0]
        out = _rising(level)
        edge = _firsts(key >> shift)
        own = {"part": pa.array([part] * len(edge), pa.int32()),
               "keys": _binary([packed(k) for k in np.split(key, edge[1:])]),
               "counts": _binary([c.astype("<i8").tobytes() for c in np.split(n, edge[1:])])}
        return _frame(own | out)

    def run(batches):
        for part, rows in _parts(batches):
            if part < shards:
                keys, counts, size = [], [], 0
                for _, _, key, n in rows:
                    keys.append(unpacked(key))
                    counts.append(np.frombuffer(n, "<i8"))
                    size += len(keys[-1])
                    if size > CHUNK:
                        key, n = summed(keys, counts)
                        keys, counts, size = [key], [n], 0
                key, n = summed(keys, counts)
                # a few contexts at a time, always whole
                edge = np.append(_firsts(key >> shift), len(key))
                a = 0
                while a < len(key):
                    b = int(edge[min(len(edge) - 1, np.searchsorted(edge, a + CHUNK // 8))])
                    yield of_grams(part, key[a:b], n[a:b])
                    a = b
            else:
                words = Counter()
                for _, _, key, n in rows:
                    for w, c in zip(key.split(b" "), np.frombuffer(n, "<i8").tolist()):
                        words[w] += c
                none = pa.nulls(1, pa.binary())
                yield _frame({
                    "part": pa.array([part], pa.int32()),
                    "keys": _binary([b" ".join(words)]),
                    "counts": _binary([np.array(list(words.values()), "<i8").tobytes()]),
                    "s": pa.nulls(1, pa.int64()), "byte": none, "n": none, "node": none,
                    "weighted": none})
    return (sent.repartition("part").sortWithinPartitions("part").mapInArrow(
        run, "part int, keys binary, counts binary, " + RISING))


def _parts(batches):
    """(part, its rows) of batches sorted by part; rows are read as they are needed."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    row = next(rows, None)
    while row is not None:
        part, ahead = row[0], [row]

        def of_part():
            while ahead[0] is not None and ahead[0][0] == part:
                yield ahead[0]
                ahead[0] = next(rows, None)
        yield part, of_part()
        for _ in of_part():
            pass
        row = ahead[0]


def risen(level: DataFrame) -> DataFrame:
    """The contexts one byte shorter, in the same form; a context has 256 children at most."""
    def run(batches):
        for table in whole_runs(batches):
            yield _frame(_rising(_levelled(*(table.column(c).to_pylist() for c in (
                "s", "byte", "n", "node", "weighted")))))
    return (level.select(F.shiftright("s", 8).alias("key"), "s", "byte", "n", "node", "weighted")
            .repartition("key").sortWithinPartitions("key").mapInArrow(run, RISING))


def _mixture(known: np.ndarray, left: np.ndarray, at: np.ndarray):
    return {"known": _binary([k.tobytes() for k in np.split(known, at)]),
            "left": _binary([x.tobytes() for x in np.split(left, at)])}


def modelled(grams: DataFrame) -> DataFrame:
    """part, keys, values: log10 of the probability of each gram's byte in its context."""
    two = written(risen(grams))
    one = risen(two)
    # at most 256 contexts of one byte
    rows = list(zip(*sorted(one.collect()))) or [[], [], [], [], []]

    if rows[0]:
        root = _levelled(*rows)
        ones = {c: np.frombuffer(b, np.uint8).astype(np.int64) | c << 8
                for c, b in zip(rows[0], rows[1])}
        first = np.zeros((len(root.entry), 8))
        known, left = root.mixed(root.entry, first, first + 1)
        entry = np.sort(np.concatenate(list(ones.values())))
        at = np.searchsorted(root.entry, entry & 255)
        above = entry, known[at], left[at]
    else:
        above = None

    def level_of(table):
        """The level of the rows themselves, children's shares from the stored ones."""
        s, byte, n, node, weighted = (table.column(c).to_pylist() for c in (
            "s", "byte", "n", "node", "weighted"))
        entry = np.concatenate([np.frombuffer(b, np.uint8).astype(np.int64) | c << 8
                                for c, b in zip(s, byte)])
        out = Level(entry, np.frombuffer(b"".join(n), "<i8"))
        key = np.concatenate([np.frombuffer(b, np.uint8).astype(np.int64) | c << 8
                              for c, b in zip(s, node)])
        stored = np.frombuffer(b"".join(weighted), "<f8")[np.argsort(key)]
        # at the greatest depth weighted is the estimate itself; here both are known
        out.weight = np.exp(np.minimum(HALF + out.weighted - stored, 0.0))
        out.weighted = stored
        return out

    if above is not None:
        first_level = level_of(pa.table(dict(zip(
            ("s", "byte", "n", "node", "weighted"), (list(r) for r in rows)))))
        above = (above[0], *first_level.mixed(*above))

    def fall(batches):
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]).sort_by("s")
                level = level_of(table)
                at = np.searchsorted(above[0], level.entry >> 16 << 8 | level.entry & 255)
                known, left = level.mixed(level.entry, above[1][at], above[2][at])
                edge = _firsts(level.entry >> 8)[1:]
                yield _frame({"two": table.column("s").combine_chunks(),
                              "bytes": table.column("byte").combine_chunks(),
                              **_mixture(known, left, edge)})
    falling = written(two.mapInArrow(fall, "two long, bytes binary, known binary, left binary"))

    def score(batches):
        for whole in batches:
            rows, size, start = whole.to_pylist(), 0, 0
            for i, row in enumerate(rows):
                size += len(row["keys"]) // 8
                if size > CHUNK // 8 or i == len(rows) - 1:
                    yield scored_rows(rows[start:i + 1])
                    start, size = i + 1, 0

    def scored_rows(rows):
        rows.sort(key=lambda r: r["s"])
        gram = [unpacked(r["keys"]) for r in rows]
        key, n = np.concatenate(gram), np.concatenate(
            [np.frombuffer(r["counts"], "<i8") for r in rows])
        tops = {r["two"]: r for r in rows}
        tops = [tops[t] for t in sorted(tops)]
        entry = np.concatenate([np.frombuffer(r["bytes"], np.uint8).astype(np.int64)
                                | r["two"] << 8 for r in tops])
        known, left = (np.concatenate([np.frombuffer(r[c]) for r in tops]).reshape(-1, 8)
                       for c in ("known", "left"))
        at = np.searchsorted(entry, key >> 8 * (DEPTH - 1) << 8 | key & 255)
        known, left = known[at], left[at]
        for depth, level in enumerate(subtree(key, n), OWNED):
            known, left = level.mixed(key >> 8 * (DEPTH - depth + 1) << 8 | key & 255, known, left)
        value = np.log10(known).sum(1).astype("<f4")
        edge = np.cumsum([len(g) for g in gram])[:-1]
        return _frame({"part": pa.array([r["part"] for r in rows], pa.int32()),
                       "keys": _binary([r["keys"] for r in rows]),
                       "values": _binary([v.tobytes() for v in np.split(value, edge)])})
    both = grams.select("part", "s", "keys", "counts").join(
        falling, F.shiftright("s", 8) == F.col("two"))
    return both.mapInArrow(score, "part int, keys binary, values binary")


def answered(sent: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """For each sending the same keys with their values: block, words (or grams), keys, values."""
    both = model.select("part", F.lit(-1).cast("long").alias("block"),
                        F.lit(0).alias("kind"), "keys", "values").unionByName(
        sent.select("part", "block", F.lit(1).alias("kind"), "keys",
                    F.lit(None).cast("binary").alias("values")))

    def run(batches):
        for part, rows in _parts(batches):
            keys, values, known = [], [], None
            for _, block, kind, key, value in rows:
                if kind == 0:
                    keys.append(key)
                    values.append(value)
                    continue
                if known is None and part < shards:
                    known = np.concatenate([unpacked(k) for k in keys])
                    order = np.argsort(known)
                    known = known[order]
                    value = np.frombuffer(b"".join(values), "<f4")[order]
                    keys, values = None, value
                elif known is None:
                    known = dict(zip(b" ".join(keys).split(b" "),
                                     np.frombuffer(b"".join(values), "<i8").tolist()))
                    keys = values = None
                if part < shards:
                    out = values[np.searchsorted(known, unpacked(key))].tobytes()
                else:
                    out = np.array([known[w] for w in key.split(b" ")], "<i8").tobytes()
                yield _frame({"block": pa.array([block], pa.int64()),
                              "kind": pa.array([int(part >= shards)], pa.int32()),
                              "keys": _binary([key]), "values": _binary([out])})
    return (both.repartition("part").sortWithinPartitions("part", "kind")
            .mapInArrow(run, "block long, kind int, keys binary, values binary"))


def scored(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_tokens, n_known, n_bytes, train_tokens, base_score, score,
    bits_per_byte.

    The model learns from the rows for which ``train`` is true. ``score``: log10 of the whole
    text's probability by the context trees, the end included; ``bits_per_byte``: its code
    length. ``base_score``: that of its words by add-one counts. Null and empty texts are an end
    alone. Repeated rows, ids and null ids are rows of their own; nothing else of ``docs`` is
    read, so other columns do not matter. An empty table gives no rows; without training rows
    every byte costs eight bits.
    """
    pieces = blocks_of(docs, key, text, train)
    blocks = pieces.agg(F.count_distinct("block")).first()[0]
    shards = max(1, min(SHARDS, blocks))
    sums = written(counted(sendings(pieces, shards, True), shards))

    def totals(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = np.frombuffer(raw, "<i8")
                yield _frame({"tokens": pa.array([int(n.sum())], pa.int64()),
                              "distinct": pa.array([int((n > 0).sum())], pa.int64())})
    words = sums.filter("s is null").select("part", "keys", "counts")
    tokens, distinct = words.select("counts").mapInArrow(
        totals, "tokens long, distinct long").agg(
            F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    model = written(modelled(sums.filter("s is not null")).unionByName(
        words.withColumnRenamed("counts", "values")))
    answers = answered(sendings(pieces, shards, False), model, shards)
    kind = docs.schema[key].dataType.simpleString()
    none = F.lit(None)
    mixed = answers.select("block", "kind", none.cast("long").alias("row"),
                           none.cast(kind).alias("id"), "keys", "values").unionByName(
        pieces.select("block", F.lit(2).alias("kind"), "row", "id",
                      F.col("piece").alias("keys"), none.cast("binary").alias("values")))
    base = float(np.log10(tokens + distinct + 1))

    def run(batches):
        at = None
        grams, logs, words = [], [], {}
        held, size, ready = [], 0, None

        def flush():
            pieces = [h[2] for h in held]
            length = np.array([len(p) - DEPTH for p in pieces])
            value = ready[1][np.searchsorted(ready[0], grams_of(pieces))]
            score = np.add.reduceat(value.astype(np.float64), np.cumsum(length) - length)
            n, known, simple = [], [], []
            for p in pieces:
                found = words_of(p)
                c = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                n.append(len(c))
                known.append(int((c > 0).sum()))
                simple.append(float(np.log10(c + 1.0).sum()) - len(c) * base)
            out = _frame({"row": pa.array([h[0] for h in held], pa.int64()),
                          "id": pa.array([h[1] for h in held], id_type[0]),
                          "n_tokens": pa.array(n, pa.int64()),
                          "n_known": pa.array(known, pa.int64()),
                          "n_bytes": pa.array(length, pa.int64()),
                          "base_score": pa.array(simple), "score": pa.array(score)})
            held.clear()
            return out

        id_type = [None]
        for batch in batches:
            id_type[0] = batch.schema.field("id").type
            for block, kind, row, one, keys, values in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if block != at:
                    if held:
                        yield flush()
                    at, grams, logs, words, ready, size = block, [], [], {}, None, 0
                if kind == 0:
                    grams.append(unpacked(keys))
                    logs.append(np.frombuffer(values, "<f4"))
                elif kind == 1:
                    words.update(zip(keys.split(b" "), np.frombuffer(values, "<i8").tolist()))
                else:
                    if ready is None:
                        gram = np.concatenate(grams)
                        order = np.argsort(gram)
                        ready, grams = (gram[order], np.concatenate(logs)[order]), []
                        logs = []
                    held.append((row, one, keys))
                    size += len(keys)
                    if size > CHUNK // 2:
                        yield flush()
                        size = 0
        if held:
            yield flush()
    parts = mixed.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        run, f"row long, id {kind}, n_tokens long, n_known long, n_bytes long, "
             "base_score double, score double")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base_score", "score")]
    own = fresh("row", docs)
    return (parts.groupBy(F.col("row").alias(own)).agg(F.first("id").alias(key), *sums)
            .select(key, "n_tokens", "n_known", "n_bytes",
                    F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
                    (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes"))
                    .alias("bits_per_byte")))
