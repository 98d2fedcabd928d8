"""Periodic runs against a search over all starts and periods."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, ROWS
from tillscope.llm import periods

FOLDER = "/root/testdata/sf0.001"


def direct(words):
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.text("ab", max_size=40),
    st.builds(lambda p, n: p * n, st.text("abcd", min_size=1, max_size=7), st.integers(1, 9)),
    st.builds(lambda n: "".join(f"{chr(200 + i)}" for i in range(n)), st.integers(0, 9))),
    max_size=6))
def test_runs_equal_direct_search(parts):
    texts = [list("".join(parts)), [], list("".join(parts[::-1])), *map(list, parts)]
    assert periods.runs_of(texts) == [direct(t) for t in texts]


def test_runs_of_larger_texts():
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        words = rng.choices(range(rng.choice([2, 3, 50, 2000])), k=rng.randrange(2500))
        for _ in range(rng.randrange(4)):
            q = rng.choice([1, 2, 3, 7, 40, 64, 65, 200])
            loop = rng.choices(range(9), k=q)
            at = rng.randrange(len(words) + 1)
            words[at:at] = (loop * 12)[:rng.randrange(3 * q, 9 * q)]
        texts.append(words)
    assert periods.runs_of(texts) == [direct(t) for t in texts]


def test_hostile_texts():
    assert periods.runs_of([["a"] * 200_000]) == [[(0, 200_000, 1)]]
    fib, last = ["a"], ["a", "b"]
    while len(last) < 30_000:
        fib, last = last, last + fib
    assert periods.runs_of([last]) == [[]]  # no fourth power in it
    thue = [bin(i).count("1") % 2 for i in range(1 << 16)]
    assert periods.runs_of([thue]) == [[]]
    nested = (["a"] * 8 + ["b"]) * 50
    runs = periods.runs_of([nested])[0]
    assert (0, 450, 9) in runs and runs.count((0, 8, 1)) == 1 and len(runs) == 51


def brute(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = direct(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x).hexdigest() for x in (
        "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(),
        b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha)


def test_query_equals_brute_force(spark):
    from tillscope.llm.queries import QUERIES

    df = QUERIES["op12_periodic_runs"](spark, FOLDER)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                          "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(brute(r.doc_id, r.text) for r in docs)
    assert any(r[1] for r in got)


def test_odd_rows_columns_and_empty_tables(spark, odd, crowded, nothing):
    number = F.crc32(F.col("doc_id").cast("string"))
    want = sorted((brute(r[0], r[1]) for r in ROWS if r[1] != LONG), key=str)
    for docs in (odd, crowded.withColumn("best", F.lit(1))):
        out = periods.digest(periods.found(docs, number=number))
        rows = list(map(tuple, out.collect()))
        assert len(rows) == len(ROWS)
        assert sorted((r for r in rows if r[0] != 6), key=str) == want
    assert periods.digest(periods.found(nothing, number=number)).count() == 0
    spread = spark.createDataFrame([(1, "a b a b a b a b c", "x")], "doc_id int, text string, runs string")
    r = periods.found(spread).first()
    assert r.collapsed == "a b c" and [tuple(x) for x in r.runs] == [(0, 8, 2)]


@pytest.mark.parametrize("number", [0, 10, 120, 770])
def test_trial_loops(number):
    words = [str(i) for i in range(100)]
    out = periods.with_loops(words, number)
    a = number // 10 % 100
    p = 1 + (100 - a) // (3 + number // 10 % 8)
    assert out == [words[i] if i < a else words[a + (i - a) % p] for i in range(100)]
