"""Toxicity and language models: parts against brute force, held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from tillscope.llm import langid, toxicity
from tillscope.llm.base import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), held_out().alias("h"))
    for r in df.collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    margin = np.round(rng.standard_normal(300), 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-margin))).astype(float)
    fit = toxicity.Isotonic(margin, y)
    assert (np.diff(fit.y) >= 0).all()
    # min-max formula of the isotonic regression
    x = np.unique(margin)
    s = [y[margin == v].sum() for v in x]
    n = [(margin == v).sum() for v in x]
    for k in range(len(x)):
        best = max(min(sum(s[i:j + 1]) / sum(n[i:j + 1]) for j in range(k, len(x)))
                   for i in range(k + 1))
        assert fit(np.array([x[k]]))[0] == pytest.approx(best)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = toxicity.Trees(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_features():
    marks = toxicity.Marks(["grob", "fies*"])
    x = dict(zip(toxicity.NAMES, toxicity.features("You are an 1diot GROB fiesling!! sooo", marks)))
    assert x["words"] == pytest.approx(np.log1p(7))
    assert x["seeded"] == pytest.approx(1 / 7) and x["learned"] == pytest.approx(1 / 7)
    assert x["begins"] == pytest.approx(1 / 7) and x["shouted"] == pytest.approx(1 / 7)
    assert x["person"] == pytest.approx(1 / 7) and x["drawn"] == pytest.approx(1 / 7)
    assert x["near_person"] == pytest.approx(3 / 7)
    assert not toxicity.features(None, marks).any() and not toxicity.features(" ", marks).any()


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).join(labels, "doc_id").select("score", "toxic").collect()
    assert all(0 <= r.score <= 1 for r in got)
    clean = [r for r in got if r.toxic == 0]
    toxic = [r for r in got if r.toxic == 1]
    assert sum(r.score >= 0.5 for r in clean) <= 0.02 * len(clean)
    assert np.mean([r.score for r in toxic]) > np.mean([r.score for r in clean]) + 0.4


def test_toxicity_odd_rows(crowded, nothing, spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(crowded, labels)
    out = toxicity.scored(crowded, model)
    assert out.count() == len(ROWS)
    assert toxicity.without_toxic(crowded, labels.limit(0)).columns == crowded.columns
    assert toxicity.without_toxic(crowded, labels.limit(0)).count() == len(ROWS)
    assert toxicity.without_toxic(nothing, labels).count() == 0


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    net = langid.Network(["a", "b", "c"], seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data = rng.integers(97, 103, (3, langid.WINDOW)).astype(np.uint8)
    target = np.array([0, 1, 2])
    weight = np.ones((langid.WINDOW, 3))
    weight[40:, 1] = 0
    _, g = net.gradients(data, target, weight)
    for name in net.w:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.w[name].shape)
            if name.startswith("x"):
                at = (int(data[0, 0]), at[1])
            old, step = net.w[name][at], 1e-2
            net.w[name][at] = old + step
            up, _ = net.gradients(data, target, weight)
            net.w[name][at] = old - step
            down, _ = net.gradients(data, target, weight)
            net.w[name][at] = old
            assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def test_every_byte_is_labelled_and_pooled():
    net = langid.Network(["a", "b"])
    texts = [b"x" * 150, b"", b"hello", bytes(range(97, 123)) * 9]
    data, length, owner = langid.windows(texts)
    assert length.sum() == sum(map(len, texts))
    p = net.positions(data)
    for i, text in enumerate(texts):
        own = [p[t, w] for w in np.flatnonzero(owner == i) for t in range(length[w])]
        assert len(own) == len(text)
        want = np.mean(own, 0) if own else np.zeros(2)
        assert np.allclose(net.documents(texts, rows=3)[i], want, atol=1e-5)


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identified(docs, langid.fit(docs)).filter(held_out() & F.col("lang").isNotNull())
    right = [r.lang == r.lang_pred for r in out.collect()]
    assert np.mean(right) > 0.95


def test_language_odd_rows(crowded, nothing):
    none = langid.identified(crowded, langid.fit(nothing))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    out = langid.identified(crowded, langid.fit(crowded)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert (r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
        assert 0 <= r.score <= 1
    assert langid.identified(nothing, None).count() == 0
