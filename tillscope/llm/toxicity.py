"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a seed lexicon and of a lexicon learned from labelled
texts (words and word beginnings that occur in toxic texts only), how near hits stand to
second-person words, capitals, punctuation, obfuscation and repeated letters. The model is
fitted in NumPy on a bounded sample of labelled rows; scoring is one pass over the texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.base import fresh, held_out, slices, written

SAMPLE = 10_000        # labelled rows that a model is fitted on, the smallest by hash
TERMS = 3_000          # learned terms, the most frequent
PREFIXES = (4, 5, 6)
NEAR = 5               # words between a hit and a second-person word
CACHE = 100_000        # words whose marks a task keeps

#: Common insults, and second-person words of some languages.
SEED_WORDS = frozenset(
    "idiot idiots stupid moron morons dumb loser losers scum trash pathetic worthless clown "
    "disgusting filth garbage imbecile fool jerk freak hate kill".split())
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous "
    "votre vos usted ustedes tus ti tuyo su".split())
LEET = str.maketrans("013457@$!", "oieastasi")
LETTERS = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_][\d@$!*#%&]+[^\W\d_]|[^\W\d_][*#$%&]{2,}|^[\d@$!]+[^\W\d_]{3}")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")

SEEDED, LEARNED, BEGINS, PERSON, CAPS, MASKED, DRAWN = (1 << i for i in range(7))
NAMES = ("words", "seeded", "learned", "begins", "any_hit", "hits", "near_person", "person",
         "capitals", "shouted", "punctuation", "masked", "drawn", "masked_hits")


def terms_of(text: str) -> set[str]:
    """Distinct words, and beginnings marked by a star."""
    words = set(LETTERS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


class Marks(dict):
    """Word as it stands -> what counts about it, packed: flags, capitals, punctuation, length."""

    def __init__(self, lexicon):
        super().__init__()
        self.words = frozenset(t for t in lexicon if not t.endswith("*"))
        self.begins = frozenset(t[:-1] for t in lexicon if t.endswith("*"))

    def __missing__(self, word):
        if len(self) > CACHE:
            self.clear()
        flags, lower = 0, word.lower()
        for bare in LETTERS.findall(lower):
            flags |= SEEDED * (bare in SEED_WORDS) | LEARNED * (bare in self.words)
            flags |= PERSON * (bare in SECOND_PERSON)
            flags |= BEGINS * any(bare[:n] in self.begins for n in PREFIXES)
        if OBFUSCATED.search(lower):
            flags |= MASKED
            for bare in LETTERS.findall(lower.translate(LEET)):
                flags |= SEEDED * (bare in SEED_WORDS)
        flags |= DRAWN * (REPEATED.search(lower) is not None)
        upper = sum(map(str.isupper, word))
        flags |= CAPS * (upper > 1 and word.isupper())
        other = sum(not (c.isalnum() or c == "_") for c in word)
        value = self[word] = flags | min(upper, 65535) << 8 | min(other, 65535) << 24 \
            | min(len(word), 65535) << 40
        return value


def features(text: str | None, marks: Marks) -> np.ndarray:
    """The dense features in the order of ``NAMES``; zeros for null and wordless texts."""
    words = text.split() if text else []
    if not words:
        return np.zeros(len(NAMES))
    v = np.fromiter(map(marks.__getitem__, words), np.int64, len(words))
    n = len(v)
    chars = (v >> 40).sum()

    def share(flag):
        return np.count_nonzero(v & flag) / n
    hit = np.flatnonzero(v & (SEEDED | LEARNED | BEGINS))
    person = np.flatnonzero(v & PERSON)
    near = 0
    if len(hit) and len(person):
        right = np.searchsorted(person, hit)
        gap = np.minimum(np.abs(hit - person[np.minimum(right, len(person) - 1)]),
                         np.abs(hit - person[np.maximum(right - 1, 0)]))
        near = np.count_nonzero(gap <= NEAR)
    return np.array([np.log1p(n), share(SEEDED), share(LEARNED), share(BEGINS), len(hit) / n,
                     np.log1p(len(hit)), near / n, share(PERSON),
                     ((v >> 8) & 65535).sum() / chars, share(CAPS),
                     ((v >> 24) & 65535).sum() / chars, share(MASKED), share(DRAWN),
                     np.count_nonzero((v & MASKED > 0) & (v & SEEDED > 0)) / n])


class Trees:
    """Boosted trees of fixed depth on quantile bins, logistic loss."""

    def __init__(self, x, y, rounds=60, depth=3, rate=0.15, bins=32, smooth=2.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
        self.depth, self.rate, self.trees = depth, rate, []
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        binned = self._binned(x)
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(depth):
                width = 1 << level
                best, gain = np.zeros((width, 2), np.int64), np.full(width, 1e-9)
                for f in range(x.shape[1]):
                    cell = node * bins + binned[:, f]
                    gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)
                    hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    score = (gs ** 2 / (hs + smooth)
                             + (total_g - gs) ** 2 / (total_h - hs + smooth)
                             - total_g ** 2 / (total_h + smooth))
                    at = score.argmax(1)
                    top = score[np.arange(width), at]
                    better = top > gain
                    best[better] = np.column_stack((np.full(width, f), at))[better]
                    gain[better] = top[better]
                # a node without a gain sends all its rows left
                best[gain <= 1e-9] = (0, bins)
                splits.append(best)
                node = 2 * node + (binned[np.arange(len(y)), best[node, 0]] > best[node, 1])
            leaves = 1 << depth
            value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + smooth)
            self.trees.append((splits, value * rate))
            margin = margin + value[node] * rate

    def _binned(self, x):
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)])

    def margin(self, x):
        binned, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for best in splits:
                node = 2 * node + (binned[rows, best[node, 0]] > best[node, 1])
            out += value[node]
        return out


class Isotonic:
    """Non-decreasing step fit of 0/1 outcomes to margins, by pooling adjacent violators."""

    def __init__(self, margin, y):
        order = np.argsort(margin, kind="stable")
        x, starts = np.unique(margin[order], return_index=True)
        blocks = []  # mean, weight, distinct margins
        for part in np.split(y[order], starts[1:]):
            blocks.append([part.mean(), len(part), 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w, c = blocks.pop()
                n = blocks[-1][1] + w
                blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * w) / n, n, blocks[-1][2] + c]
        self.x, self.y = x, np.repeat([b[0] for b in blocks], [b[2] for b in blocks])

    def __call__(self, margin):
        return np.interp(margin, self.x, self.y)


class Model:
    """Lexicon, trees and calibration, fitted on (text, label) rows by halves.

    Each half's features use the lexicon of the other, and the calibration uses margins of
    trees that did not see the row, so none of them learns from its own labels.
    """

    def __init__(self, lexicons, x, y, half):
        self.lexicon = lexicons
        self.constant = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if len(set(half.tolist())) == 2 and 0 < y.mean() < 1:
            margin = np.empty(len(y))
            for k in (0, 1):
                margin[half == k] = Trees(x[half != k], y[half != k]).margin(x[half == k])
            self.calibrate = Isotonic(margin, y)
            self.trees = Trees(x, y)

    def scores(self, x):
        if self.trees is None:
            return np.full(len(x), self.constant)
        return self.calibrate(self.trees.margin(x))


def chosen_terms(counts: dict, toxic: int, clean: int) -> list[str]:
    """Terms that toxic texts hold far more often than clean ones, the most frequent first."""
    found = []
    for term, (t, c) in counts.items():
        odds = np.log((t + 0.5) / (toxic - t + 0.5)) - np.log((c + 0.5) / (clean - c + 0.5))
        if t >= 3 and t >= 4 * c and odds >= 3:
            found.append((-t, term))
    return [term for _, term in sorted(found)[:TERMS]]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows that are not held out, the smallest by hash.

    Several labels of one key count as toxic if any does; null labels are none.
    """
    chosen = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
              .groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
              .orderBy(F.xxhash64("k"), "k").limit(sample)
              .withColumn("half", F.pmod(F.xxhash64(F.col("k"), F.lit(1)), F.lit(2))))
    # at most ``sample`` rows of three numbers
    train = written(docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
                    .join(F.broadcast(written(chosen)), "k")
                    .repartition(32, "k").select("k", "y", "half", "text"))

    def count(batches):
        seen = defaultdict(Counter)
        for batch in batches:
            for y, half, text_ in zip(*(batch.column(c).to_pylist() for c in ("y", "half", "text"))):
                seen[half, int(y > 0)].update(terms_of(text_ or ""))
        rows = [(h, y, t, n) for (h, y), c in seen.items() for t, n in c.items()]
        yield pa.RecordBatch.from_pylist(
            [dict(half=h, y=y, term=t, n=n) for h, y, t, n in rows],
            pa.schema([("half", pa.int64()), ("y", pa.int64()), ("term", pa.string()),
                       ("n", pa.int64())]))

    toxic = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0))
    per_term = (train.mapInArrow(count, "half long, y long, term string, n long")
                .groupBy("half", "term").agg(toxic.alias("t"), F.sum("n").alias("n"))
                .filter("t >= 2"))
    per_term = per_term.groupBy("term").agg(
        *[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}")
          for h in (0, 1) for c in ("t", "n")])
    # mostly toxic in either half; at most the terms of the bounded sample
    rows = per_term.filter("t0 >= 4 * (n0 - t0) and t0 > 0 or t1 >= 4 * (n1 - t1) and t1 > 0 "
                           "or t0 + t1 >= 4 * (n0 + n1 - t0 - t1)").collect()
    totals = {(r.half, r.y): r.n for r in train.groupBy("half", F.expr("int(y > 0)").alias("y"))
              .agg(F.count("*").alias("n")).collect()}

    def lexicon(halves):
        counts = {r.term: (sum(r[f"t{h}"] for h in halves),
                           sum(r[f"n{h}"] - r[f"t{h}"] for h in halves)) for r in rows}
        return chosen_terms(counts, sum(totals.get((h, 1), 0) for h in halves),
                            sum(totals.get((h, 0), 0) for h in halves))

    other = {h: lexicon([1 - h]) for h in (0, 1)}

    def featured(batches):
        marks = {h: Marks(t) for h, t in other.items()}
        for batch in batches:
            x = [features(t, marks[h]).tolist() for t, h in zip(
                batch.column("text").to_pylist(), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("y"), batch.column("half"),
                 pa.array(x, pa.list_(pa.float64()))], names=["k", "y", "half", "x"])
    kinds = dict(train.dtypes)
    got = sorted(train.mapInArrow(
        featured, f"k {kinds['k']}, y {kinds['y']}, half long, x array<double>").collect())
    x = np.array([r.x for r in got]).reshape(len(got), len(NAMES))
    return Model(lexicon([0, 1]), x, np.array([float(r.y > 0) for r in got]),
                 np.array([r.half for r in got], int))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text, null texts scored as empty.

    Rows are scored one by one; an existing column ``score`` is replaced.
    """
    docs = docs.drop(score)
    where = docs.columns.index(text)

    def run(batches):
        marks = Marks(model.lexicon)
        for batch in slices(batches):
            x = np.stack([features(t, marks) for t in batch.column(where).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.scores(x))], names=[*batch.schema.names, score])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{score}` double")


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``least``; same columns."""
    name = fresh("toxic_score", docs)
    return scored(docs, fit(docs, labels), score=name).filter(F.col(name) < least).drop(name)
