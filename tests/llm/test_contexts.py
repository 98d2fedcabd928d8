"""Context-tree weighting against a direct recursion over all contexts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from tillscope.llm import ctw


def canonical(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return b" ".join(raw.split()) + b"\n"


class Direct:
    """Counts of every context in one dictionary; probabilities by recursion."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            raw = ctw.HEAD + canonical(t)
            for i in range(ctw.DEPTH, len(raw)):
                for d in range(ctw.DEPTH + 1):
                    context = raw[i - d:i]
                    if d:
                        self.children[context[1:]].add(context)
                    node = 1
                    for k in range(7, -1, -1):
                        bit = raw[i] >> k & 1
                        self.counts[context, node][bit] += 1
                        node = 2 * node + bit
        self.memory = {}

    def estimate(self, key):
        a, b = self.counts[key] if key in self.counts else (0, 0)
        lg = math.lgamma
        return lg(a + .5) + lg(b + .5) - lg(a + b + 1) - math.log(math.pi)

    def weighted(self, context, node):
        key = context, node
        if key not in self.counts:
            return 0.0
        if key not in self.memory:
            own = self.estimate(key)
            if len(context) < ctw.DEPTH:
                below = sum(self.weighted(c, node) for c in self.children[context])
                own = np.logaddexp(own, below) + math.log(.5)
            self.memory[key] = own
        return self.memory[key]

    def probability(self, raw, i, depth, node, bit):
        context = raw[i - depth:i]
        counts = self.counts[context, node] if (context, node) in self.counts else (0, 0)
        own = (counts[bit] + .5) / (sum(counts) + 1)
        if depth == ctw.DEPTH:
            return own
        share = math.exp(math.log(.5) + self.estimate((context, node))
                         - self.weighted(context, node))
        return share * own + (1 - share) * self.probability(raw, i, depth + 1, node, bit)

    def score(self, text):
        raw, total = ctw.HEAD + canonical(text), 0.0
        for i in range(ctw.DEPTH, len(raw)):
            node = 1
            for k in range(7, -1, -1):
                bit = raw[i] >> k & 1
                total += math.log10(self.probability(raw, i, 0, node, bit))
                node = 2 * node + bit
        return total


TEXTS = ["The cat sat on the mat.", "the cat sat on the rug", "A dog\n\tsat on the   mat", None, "",
         "läuft über über", "the cat sat on the mat.", "unseen \U0001f600 words", "x"]


def base_of(text, train):
    def tokens(t):
        return canonical(t)[:-1].split() + [b"\n"]
    count = Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return (len(tokens(text)), sum(count[w] > 0 for w in tokens(text)), n,
            sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(text)))


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_recursion(spark, monkeypatch, small):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t for i, t in rows if i % 3]
    got = ctw.scored(docs, F.col("doc_id") % 3 != 0).collect()
    direct = Direct(train)
    assert sorted(r.doc_id for r in got) == list(range(len(TEXTS)))
    for r in got:
        n, known, tokens, base = base_of(TEXTS[r.doc_id], train)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, direct.score(TEXTS[r.doc_id]), rel_tol=1e-5)
        assert r.n_bytes == len(canonical(TEXTS[r.doc_id]))
        assert math.isclose(r.bits_per_byte * r.n_bytes, -r.score / math.log10(2), rel_tol=1e-9)


def test_probabilities_of_all_bytes_sum_to_one():
    texts = [t for t in TEXTS if t]
    grams, n = np.unique(ctw.grams_of([p for t in texts for p in ctw.pieces_of(t)]),
                         return_counts=True)
    context = int(grams[len(grams) // 2]) >> 8 << 8
    every = np.union1d(grams, context + np.arange(256))
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, grams)] = n
    levels = ctw.subtree(every, count)
    known, left = np.zeros((256, 8)), np.ones((256, 8))
    for depth, level in enumerate(levels, ctw.OWNED):
        entry = context + np.arange(256)
        known, left = level.mixed(entry >> 8 * (ctw.DEPTH - depth + 1) << 8 | entry & 255,
                                  known, left)
    assert math.isclose(known.prod(1).sum(), 1, rel_tol=1e-9)


def test_pieces_and_blocks_do_not_change_scores(spark):
    long = " ".join(f"w{i % 97} Und{i % 31}" for i in range(3000))
    whole = ctw.pieces_of(long)
    saved, ctw.PIECE = ctw.PIECE, 1000
    try:
        cut = ctw.pieces_of(long)
    finally:
        ctw.PIECE = saved
    assert len(whole) == 1 and len(cut) > 20
    assert (ctw.grams_of(cut) == ctw.grams_of(whole)).all()
    assert [w for p in cut for w in ctw.words_of(p)] == ctw.words_of(whole[0])
    docs = spark.createDataFrame([(i, long[i:]) for i in range(60)], "doc_id long, text string")
    train = F.col("doc_id") % 2 == 0
    one = {r.doc_id: r.score for r in ctw.scored(docs.coalesce(1), train).collect()}
    many = {r.doc_id: r.score for r in ctw.scored(docs.repartition(7), train).collect()}
    assert one.keys() == many.keys()
    assert all(math.isclose(one[k], many[k], rel_tol=1e-6) for k in one)


def test_odd_rows_columns_and_empty_tables(spark, odd, crowded, nothing):
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    for docs in (odd, crowded.withColumn("row", F.lit(1)).withColumn("block", F.lit("b"))):
        got = ctw.scored(docs, train).collect()
        assert len(got) == len(ROWS)
        assert all(r.score < 0 and r.n_tokens > 0 for r in got)
        by_id = {r.doc_id: r for r in got}
        assert by_id[3].n_tokens == by_id[4].n_tokens == by_id[5].n_tokens == 1
        assert by_id[1].score == by_id[2].score
    taught = sum(base_of(t, [])[0] for i, t, *_ in ROWS
                 if i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    assert got[0].train_tokens == taught
    assert ctw.scored(nothing, train).count() == 0
    untrained = ctw.scored(odd, F.lit(False)).collect()
    assert all(math.isclose(r.bits_per_byte, 8, rel_tol=1e-6) for r in untrained)
