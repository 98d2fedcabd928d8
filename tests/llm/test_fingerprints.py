"""SimHash, order MinHash, embeddings and components against brute force."""

import hashlib
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from tillscope.llm import hyperplanes, order_minhash, simhash
from tillscope.llm.components import components
from tillscope.llm.groups import smallest_labels

MASK = 2 ** 64 - 1


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    links = [tuple(map(int, p)) for p in rng.integers(0, 400, (260, 2))]
    links += [(i, i + 1) for i in range(1000, 1090)] + [(2000, i) for i in range(1900, 1990)]
    links += links[:20] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == union(nodes, [x for x in links if x[0] != x[1]])


def simple_print(text, size=4):
    raw = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in raw).split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, odd):
    got = simhash.near_duplicates(odd).select("doc_id", F.hex("fp"), "component_id").collect()
    prints = [(i, simple_print(t)) for i, t, *_ in ROWS]
    assert sorted((str(r[0]), int(r[1], 16)) for r in got) == sorted(
        (str(i), p) for i, p in prints)
    keyed = [(k, p) for k, (i, p) in enumerate(prints)]
    links = [(a, b) for a, p in keyed for b, q in keyed if a < b and (p ^ q).bit_count() <= 4]
    root = union(range(len(prints)), links)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    assert sorted((str(i), str(least.get(root[k]))) for k, (i, _) in enumerate(prints)) == \
        sorted((str(r[0]), str(r[2])) for r in got)


def planted(n_random=600, family=90, words=1, seed=3):
    """Random fingerprints, and a family that differs from one of them in few bits."""
    rng = np.random.default_rng(seed)
    out = [int.from_bytes(rng.bytes(8 * words)) for _ in range(n_random)]
    for k in range(family):
        flips = rng.choice(64 * words, 1 + k % 5, replace=False)
        out.append(out[k % 3] ^ sum(1 << int(f) for f in flips))
    return sorted(set(out))


@pytest.mark.parametrize("rows, large", [(10, 4096), (2 ** 20, 4096), (10, 12), (10, 40)])
def test_no_link_between_fingerprints_is_lost(spark, rows, large):
    prints = planted()
    raw = [p.to_bytes(8) for p in prints]
    levels = simhash.exact_tables(64, 4, rows)
    # few levels, so that the last one has large buckets too
    levels = levels[:3] if large < 40 else levels
    edges = simhash.linked(spark.createDataFrame([(r,) for r in raw], "fp binary"), levels, 4,
                           large)
    got = {bytes(a): bytes(b) for a, b in components(edges).collect()}
    want = union(raw, [(raw[i], raw[j]) for i in range(len(raw)) for j in range(i)
                       if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert {k: got.get(k, k) for k in raw} == want


@pytest.mark.parametrize("rows", [2, 2 ** 22, 2 ** 26, 2 ** 40])
def test_each_level_has_a_table_on_which_close_pairs_agree(rows):
    levels = simhash.exact_tables(64, 4, rows)
    assert min(map(len, levels[-1])) == simhash.LONGEST
    assert all(min(map(len, a)) <= min(map(len, b)) for a, b in zip(levels, levels[1:]))
    rng = np.random.default_rng(9)
    for tables in levels:
        for _ in range(30):
            spoiled = set(rng.choice(64, 4, replace=False).tolist())
            assert any(spoiled.isdisjoint(t.tolist()) for t in tables)


def test_a_family_of_many_fingerprints_is_cut_into_small_buckets(spark):
    # 3,000 fingerprints with one half in common: all are in one bucket of the first tables
    rng = np.random.default_rng(4)
    low = np.unique(rng.integers(0, 2 ** 20, 3000))
    raw = [int(0xABCDEF12345 << 20 | int(x)).to_bytes(8) for x in low]
    levels = simhash.exact_tables(64, 4, len(raw))
    frame = spark.createDataFrame([(r,) for r in raw], "fp binary")
    first = simhash.keyed(frame, levels[0]).groupBy("key").count().agg(F.max("count")).first()[0]
    assert first == len(raw)
    edges = simhash.linked(frame, levels, 4, 500)
    got = {bytes(a): bytes(b) for a, b in components(edges).collect()}
    near = np.bitwise_count(low[:, None] ^ low[None, :]) <= 4
    label = smallest_labels(len(low), *np.nonzero(near))
    assert [got.get(r, r) for r in raw] == [raw[i] for i in label]


def one_of_each(rows):
    """Smallest ids of the components by all distances of brute-force fingerprints."""
    prints = [(i, simple_print(t)) for i, t in rows]
    root = union([i for i, _ in rows], [(a, b) for a, p in prints for b, q in prints
                                        if a < b and (p ^ q).bit_count() <= 4])
    return sorted(set(root.values()))


def test_near_copies_leave_one_row(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows, bases = [], []
    for i in range(40):
        bases.append([vocabulary[k] for k in rng.integers(0, 3000, 1200)])
        rows.append((i, " ".join(bases[-1])))
    for i in range(60):  # one changed word of 1,200, some forty, some none at all
        words = list(bases[i % 10])
        for k in rng.integers(0, 1200, (1, 40, 0)[i % 3]):
            words[int(k)] = f"other{i}"
        rows.append((100 + i, " ".join(words)))
    want = one_of_each(rows)
    assert want[:40] == list(range(40)) and 0 < len(want) - 40 < 40
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows],
                                 "doc_id long, text string, lang string, source string, "
                                 "n_chars long")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_near_copies_in_a_large_bucket(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in rng.integers(0, 5000, 304)]
    rows = [(int(i), " ".join(words[:k] + [f"x{i}"] + words[k + 1:]))
            for i, k in enumerate(rng.integers(5, 295, 300))]
    want = one_of_each(rows)
    assert len(want) < 20
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_simhash_stage_on_odd_rows(crowded, nothing):
    kept = simhash.deduplicated(crowded)
    assert kept.columns == crowded.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "9", "None"]
    assert simhash.deduplicated(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


# --- order MinHash -----------------------------------------------------------------------


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def chain(numbers, seed, kind="<q"):
    for x in numbers:
        seed = xxhash.xxh64_intdigest(struct.pack(kind, x), seed & MASK)
    return signed(seed)


def order_print(text, k=2, size=64, pick=2):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in words]
    if not w:
        return []
    grams = [chain(w[i:i + k], 42) for i in range(len(w) - k + 1)] if len(w) >= k \
        else [chain(w, 42)]
    n = len(grams)
    bits = int(np.ceil(np.log2(n + size + 1)))
    seen, ring = {}, []
    for i, g in enumerate(grams):
        at = g >> bits
        number = seen[at] = seen.get(at, -1) + 1
        h = signed(xxhash.xxh64_intdigest(struct.pack("<i", number), chain([g], 42) & MASK))
        ring.append(((h >> bits << bits) + i, i))
    ring.sort()
    out = []
    for m in range(size):
        mark = ((m - size // 2) * (2 ** 64 // size) >> bits << bits) + n + m
        first = sum(r < mark for r, _ in ring)
        places = sorted(ring[(first + j) % n][1] for j in range(min(pick, n)))
        value = 42
        for p in places:
            value = chain([value, grams[p]], 42)
        out.append(value)
    return out


def test_order_minhash_equals_brute_force(odd, crowded):
    texts = [t for _, t, *_ in ROWS if t is None or len(t) < 1000] \
        + ["a a a a b a a", "b a", "a b", "x"]
    spark = odd.sparkSession
    df = order_minhash.fingerprinted(spark.createDataFrame([(t,) for t in texts], "text string"))
    for row in df.collect():
        assert row.fingerprint == order_print(row.text), row.text
    assert "fingerprint" in order_minhash.fingerprinted(crowded.drop("fingerprint")).columns


def test_next_document_and_edit(odd, nothing):
    got = order_minhash.compared_with_next(odd).collect()
    assert len(got) == len(ROWS)
    whole = sorted({(-1 if i is None else i, t or "") for i, t, *_ in ROWS})
    after = {a: b for a, b in zip(whole, whole[1:] + whole[:1])}
    want = {}
    for (i, t), (_, u) in after.items():
        n = len(t)
        want[i] = (n, hashlib.sha256((t[:n - n // 2] + u[:n // 2]).encode()).hexdigest())
    for r in got:
        assert (r.n_chars, r.edited_sha256) == want[-1 if r.doc_id is None else r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    assert by[6].near_edited > by[6].near_next
    assert order_minhash.compared_with_next(nothing).count() == 0


def test_texts_without_blanks_go_by_characters(spark):
    rng = np.random.default_rng(4)
    text = "".join(chr(0x3042 + int(i)) for i in rng.integers(0, 80, 480))
    edits = [text, text[:200] + "x" + text[201:], text[:200] + text[201:], text[240:] + text[:240],
             "".join(rng.permutation(list(text))), "A" * 100 + text[:50]]
    df = order_minhash.fingerprinted(
        spark.createDataFrame([(i, t) for i, t in enumerate(edits)], "i int, text string"))
    whole, changed, cut, moved, mixed, other = [r.fingerprint for r in df.orderBy("i").collect()]
    assert len(set(whole)) > 50

    def near(x):
        return sum(a == b for a, b in zip(whole, x)) / len(whole)
    assert near(changed) > 0.9 and near(cut) > 0.9
    assert 0.2 < near(moved) < 0.9 and near(mixed) < 0.2 and near(other) < 0.5


def test_fingerprints_are_texts(odd):
    got = order_minhash.compared_with_next(odd)
    assert dict(got.dtypes)["fingerprint"] == dict(got.dtypes)["edited_fingerprint"] == "string"
    by = {r.doc_id: r for r in got.collect()}
    assert by[4].fingerprint == "" and re.fullmatch("[0-9a-f]{512}", by[1].fingerprint)


def test_order_counts(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[200:] + words[:200]), " ".join(reversed(words))]
    df = order_minhash.fingerprinted(
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), k=1)
    a, moved, back = [r.fingerprint for r in df.orderBy("i").collect()]
    same = sum(x == y for x, y in zip(a, moved)) / len(a)
    assert 0.2 < same < 0.8  # pairs across the cut change places
    assert sum(x == y for x, y in zip(a, back)) == 0


# --- embeddings --------------------------------------------------------------------------


def brute(rows, cosine=0.98):
    n, links = len(rows), []
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or not good(a) or not good(b) or len(a) != len(b):
                continue
            x, y = np.array(a, float), np.array(b, float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((i, j))
    return links


def good(v):
    return v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)


def vectors():
    rng = np.random.default_rng(9)
    rows, key = [], 0
    for label in (1, 2):
        for _ in range(12):
            base = rng.standard_normal(16)
            for k in range(6):
                v = base + rng.standard_normal(16) * 0.03 * k
                rows.append((key, [float(x) for x in v.astype(np.float32)], label))
                key += 1
    rows += [(key + i, list(rows[0][1]), 1) for i in range(30)]  # equal vectors
    key += 30
    rows += [(key, [0.0] * 16, 1), (key + 1, None, 1), (key + 2, [float("nan")] + [1.0] * 15, 1),
             (key + 3, [None] + [1.0] * 15, 1), (key + 4, list(rows[0][1]), None),
             (key + 5, [float("inf")] + [1.0] * 15, 1), (key + 6, [], 2), (key + 7, [1.0, 2.0], 2)]
    return rows


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links = brute(rows)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    low = smallest_labels(len(rows), *np.array(links).T)
    want = [(i, int(degree[i]), int(low[i]), bool(low[i] == i)) for i in range(len(rows))]
    for tile in (hyperplanes.TILE, 4):  # the second cuts large buckets into tiles
        monkeypatch.setattr(hyperplanes, "TILE", tile)
        got = hyperplanes.linked_vectors(df).orderBy("vec_id").collect()
        found = sum(g[1] for g in got) / degree.sum()
        assert found >= 0.99, found
        assert [tuple(g) for g in got if g[1] == want[g[0]][1]] == \
            [w for g, w in zip(got, want) if g[1] == w[1]]
    assert hyperplanes.linked_vectors(df.limit(0)).count() == 0


def test_near_dedup_tells_rows_apart_by_key_and_text(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta"), (1, "one two three four five six seven"),
            (None, "red orange yellow green blue indigo violet"),
            (None, "red orange yellow green blue indigo violet"), (None, "north east south west up down"),
            (2, "north east south west up down"), (3, "x y z"), (3, "x y z"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()), key=str)
    assert [g for g in got if g[1]] == sorted(
        [rows[0], rows[1], rows[2], rows[5], rows[6]], key=str)
    assert len([g for g in got if not g[1]]) == 1
