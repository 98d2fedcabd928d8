"""Line dedup, source mix, URL rules, packing and token rollups."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from tillscope.llm import lines, mixing, packing, rollup, urls
from tillscope.llm.tokens import Encoder, tokenizer_path


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        host = [None, "hot", "hot", "b"][i % 4] if i < 296 else f"rare{i}"
        own = [f"line {rng.integers(0, 400)}" for _ in range(5)]
        common = [["menu", " menu ", "", "footer", f"line {i % 7}"][k] for k in range(i % 5)]
        rows.append((i, "\n".join(own + common) if i % 50 else None, host))
    df = spark.createDataFrame(rows, "page_id long, text string, host string")
    holding, pages = Counter(), Counter()
    for _, text, host in rows:
        pages[host] += 1
        holding.update({(host, x.strip(" ")) for x in (text or "").split("\n")})
    want = {}
    for i, text, host in rows:
        want[i] = [x for x in (text or "").split("\n")
                   if not x.strip(" ") or holding[host, x.strip(" ")] < 3
                   or holding[host, x.strip(" ")] <= 0.1 * pages[host]]
    got = lines.dropped(df, lines.lines_of_text(F.col("text")), "host").collect()
    assert {r.page_id: r.kept for r in got} == want
    assert sum(r.dropped for r in got) > 100


def test_lines_of_html(spark):
    html = "<p> one </p><script>var a='<b>';</script>two<!-- x --><br>three<style>p{}</style> "
    row = spark.createDataFrame([(html,), (None,), ("",)], "html string") \
        .select(lines.lines_of_html(F.col("html"))).collect()
    assert [r[0] for r in row] == [["one", "two", "three"], [], []]


def test_line_stage_keeps_rows_and_columns(crowded, nothing):
    out = lines.cleaned(crowded, least=2, ratio=0.1)
    assert out.columns == crowded.columns and out.count() == len(ROWS)
    assert {r.text for r in out.filter("doc_id in (1, 2)").collect()} == {""}
    assert {r.n_chars for r in out.filter("doc_id in (1, 2)").collect()} == {0}
    assert out.filter("doc_id = 3").first().text is None
    assert lines.cleaned(nothing).count() == 0


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "b", "c", "d", None][min(4, i % 11)])
            for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    own, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.times <= 3
        own[r.source] += r["size"]
        taken[r.source] += r["size"] * r.times
        target[r.source] = r.target
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(total)
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    open_ = [s for s in target if target[s] < 3 * own[s] - 1e-6]
    for s in target:
        assert target[s] <= 3 * own[s] + 1e-6
        assert abs(taken[s] - target[s]) <= 40
    level = {target[s] / weights[s] for s in open_}
    assert max(level) - min(level) < 1e-6 * max(level)
    again = mixing.mixed(df.repartition(7)).collect()
    assert {(r.doc_id, r.times) for r in got} == {(r.doc_id, r.times) for r in again}


def test_budgets_are_nested(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2]) for i in range(1000)],
                               "doc_id long, text string, source string")
    small = {r.doc_id: r.times for r in mixing.mixed(df, share=0.3).collect()}
    large = {r.doc_id: r.times for r in mixing.mixed(df, share=0.6).collect()}
    assert all(small[k] <= large[k] for k in small)


def test_mix_on_odd_rows(crowded, nothing):
    out = mixing.mixed(crowded)
    assert out.count() == len(ROWS)
    again = mixing.repeated(crowded)
    assert again.columns == crowded.columns
    assert again.count() == out.agg(F.sum("times")).first()[0]
    assert mixing.mixed(nothing).count() == 0 and mixing.repeated(nothing).count() == 0


GLOBS = ["abc", "a*c", "a**c", "**x**", "*.b/**", "", "**", "*", "a*b*c**d", "ü*"] + \
    ["long" * 20 + "**", "q**" + "r" * 70]


def test_automaton_equals_regular_expressions():
    rng = np.random.default_rng(8)
    strings = ["".join(rng.choice(list("abcdx./ü"), rng.integers(0, 9))) for _ in range(3000)]
    strings += ["long" * 20 + "x", "q" + "r" * 70, "qzz/" + "r" * 70, "long" * 19, ""]
    hits = urls.Globs(GLOBS).match([s.encode() for s in strings])
    for k, glob in enumerate(GLOBS):
        rule = re.compile("".join(
            {"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in
            re.findall(r"\*\*|\*|[^*]+", glob)), re.S)
        assert [bool(rule.fullmatch(s)) for s in strings] == hits[:, k].tolist(), glob


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"),
             ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    cases = [
        ("https://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://com/", "com", "/", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://a.org/x.com/", "a.org", "/x.com/", None, "allow"),
        ("http://a.net/es/casino", "a.net", "/es/casino", "net/es/", "block"),
        ("ftp://a.org/casino://b", "a.org", "/casino://b", None, "block"),
        ("http://a.org?x=http://b.com/", "a.org", "", None, "allow"),
        ("no scheme casino", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("", "", "", None, "allow"), ("://h/p\nq#", "h", "/p\nq", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)],
                               "page_id long, url string, host string")
    out = urls.judged(df, rules, ["**casino**"])
    got = [(r.url, r.host, r.path, r.rule, r.verdict) for r in out.orderBy("page_id").collect()]
    assert got == cases
    assert urls.judged(df.limit(0), rules, []).count() == 0


SPELLINGS = {  # host and path: canonical form
    ("a.org", "/x"): "a.org/x", ("u:p@a.org:8080", "/x"): "a.org/x", ("a.org.", ""): "a.org",
    ("a.org:", "/%63asino"): "a.org/casino", ("a.org", "/%2563"): "a.org/%63",
    ("a.org", "/%%34%zz%"): "a.org/%4%zz%", ("a.org", "//b///c"): "a.org/b/c",
    ("a.org", "/b/../../c/./d"): "a.org/c/d", ("a.org", "/b/%2e%2E/ads/."): "a.org/ads/",
    ("a.org", "/b/.."): "a.org/", ("a.org", "/.hid/..x/y."): "a.org/.hid/..x/y.",
    ("a.org", "/%e9%00%7f"): "a.org/%e9%00%7f", ("", ""): "", ("@:1", "/."): "/",
    ("a.org", "/é%41\n"): "a.org/éA\n",
}


def test_canonical_form():
    for (host, path), want in SPELLINGS.items():
        assert urls.canonical(host, path) == want
        assert urls.canonical(want.partition("/")[0], want[len(want.partition("/")[0]):]) == want \
            or "%" in path


def test_globs_meet_the_canonical_form_as_the_sql_says(spark, tmp_path):
    import duckdb

    from tillscope.llm import queries
    from tillscope.llm.queries import QUERIES

    found = [f"http://{h}{p}" for h, p in SPELLINGS]
    found += ["http://a.org/%70oker", "http://a.org/x/..//ads/./1", "http://a.xxx.:80/", None, "",
              "http://a.org/b/%2E%2e/login%31", "http://u@m.net:1/es/", "http://a.org/x.zi%70",
              "http://a.org/casin%6f?q", "http://a.org/pok/../er", "http://a.xxx:80", "x%3A//a"]
    (spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
     .coalesce(1).write.parquet(f"{tmp_path}/pages.parquet"))
    out = QUERIES["op7_url_filter"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in out.collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in con.execute(
        f"select * from ({queries.ORACLE['op7_url_filter']}) order by page_id").fetchall()] == got
    verdicts = {found[r[0]]: r[4] for r in got}
    assert verdicts["http://a.org/%70oker"] == verdicts["http://a.xxx.:80/"] == "block"
    assert verdicts["http://a.org/x.zi%70"] == verdicts["http://a.org/x/..//ads/./1"] == "block"
    assert verdicts["http://a.org/pok/../er"] == verdicts["http://a.org/x"] == "allow"


def test_thousands_of_globs_and_a_very_long_url(spark):
    blocked = [f"*.site{n}.org/**" for n in range(3000)] + ["**" + "z" * 200]
    long = "http://a.org/" + "y" * 200_000 + "z" * 200
    given = ["http://www.site2999.org/x", "http://www.site3000.org/x", "http://m.site7.org:8/y", long,
             long + "y", "http://star*.org/a", "http://starry.org/a"]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").coalesce(1)
    out = urls.judged(df, [("block", "star*.org", "/")], blocked).orderBy("page_id").collect()
    assert [r.verdict for r in out] == ["block", "allow", "block", "block", "allow", "block", "allow"]


def covered(pieces, docs, window):
    """Every id in one piece; sequences gapless and at most ``window`` long."""
    own, sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, seq, offset in pieces:
        assert length > 0
        own[doc].append((start, length))
        sequence[seq].append((offset, length))
    for d, ids in enumerate(docs):
        at = 0
        for start, length in sorted(own[d]):
            assert start == at
            at += length
        assert at == len(ids)
    sizes = []
    for parts in sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        sizes.append(at)
    return sizes


def test_packing_covers_all_ids_without_padding():
    rng = np.random.default_rng(6)
    for n in (1, 2, 40):
        docs = [np.append(rng.integers(1, 300, rng.integers(0, 3000 if i % 9 == 0 else 300)), 0)
                for i in range(n)]
        sizes = covered(packing.packed_shard(docs), docs, 1024)
        assert all(s & (s - 1) == 0 for s in sizes)
        assert len([s for s in sizes if s < 1024]) <= 10


def test_a_window_takes_the_nearest_unused_document():
    groups = [np.arange(100 * g + 1, 100 * g + 61) for g in range(4)]
    rng = np.random.default_rng(1)
    docs = [np.append(rng.permutation(groups[i % 4]), 0) for i in range(16)]  # four topics
    pieces = packing.packed_shard(docs, window=256)
    order = list(dict.fromkeys(p[0] for p in sorted(pieces, key=lambda p: p[3:])))
    same = sum(a % 4 == b % 4 for a, b in zip(order, order[1:]))
    assert same >= 11  # 12 at best
    scores = packing.Index([d[:-1] for d in docs]).neighbours(0)
    assert set(np.flatnonzero(scores)) == {0, 4, 8, 12}


def test_bm25_scores():
    docs = [np.array(x) for x in ([1, 1, 2], [1, 3], [2, 2, 4, 5], [6])]
    got = packing.Index(docs).neighbours(0)
    mean = np.mean([len(d) for d in docs])
    want = np.zeros(4)
    for t in (1, 2):
        df = sum(t in d for d in docs)
        for i, d in enumerate(docs):
            tf = (d == t).sum()
            want[i] += np.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (
                tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    assert np.allclose(got, want)


def test_packing_odd_rows(crowded, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed(crowded, shard=4).collect()
    texts = Counter()
    for r in got:
        assert len(r.ids) == 4 * r.length
    ends = [r for r in got if r.start + r.length == r.doc_tokens]
    assert len(ends) == len(ROWS)
    for i, t, *_ in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        raw = np.array(ids, "<u4").tobytes()
        mine = [r for r in got if r.doc_id == i and r.doc_tokens == len(ids)]
        assert mine and all(r.ids == raw[4 * r.start:4 * (r.start + r.length)] for r in mine)
        texts[i] += 1
    assert zlib.crc32(got[0].ids) >= 0
    assert packing.packed(nothing).count() == 0


def test_documents_of_a_topic_share_a_shard(spark):
    rng = np.random.default_rng(3)
    topics = [[f"t{g}word{i}" for i in range(40)] for g in range(8)]
    rows = [(i, " ".join([*rng.choice(topics[i % 8], 30), *rng.choice(["of", "the", "and"], 9)]))
            for i in range(320)]
    rows += [(1000 + i, "a copy of one and the same text") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    place = {r.doc_id: r.sequence_id >> 24 for r in packing.packed(df, shard=40).collect()}
    assert len(place) == len(rows)
    most = [Counter(place[i] for i in range(g, 320, 8)).most_common(1)[0][1] for g in range(8)]
    assert np.mean(most) >= 20, most  # of 40; about 6 if dealt at random
    assert max(Counter(place.values()).values()) <= 100  # copies do not load one shard


def test_a_long_seed_asks_with_all_its_terms():
    docs = [np.arange(1, 101), *[np.array([i, i]) for i in range(1, 101)]]
    assert (packing.Index(docs).neighbours(0)[1:] > 0).all()


def test_pieces_encode_like_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = Encoder(tokenizer_path())
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list(" \n\ta1'é,　x"), rng.integers(0, 14))) for _ in range(4000)]
    texts += ["a  b", " ", "it's 12 km<|endoftext|> ", " <|endoftext|>\n x<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 500, "  a", "日本語 テスト 😀 "]
    for t in texts:
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == \
            slow.encode(t, add_special_tokens=False).ids, repr(t)
    assert fast.encode(None) == b""


def test_rollup_commits_once(spark, tmp_path):
    state = rollup.STATE
    feed = spark.createDataFrame([
        (None, ("a", "en", "v1", 10)), (None, ("a", None, "v1", 5)), (None, ("a", "en", "v1", None)),
        (("a", "en", "v1", 10), ("b", "en", "v2", 12)), (("a", None, "v1", 5), None),
        (None, None)], f"before {state}, after {state}")
    totals = rollup.Rollup(spark, str(tmp_path))
    assert totals.totals().count() == 0
    assert totals.commit("one", rollup.signed(feed)) is True
    assert totals.commit("one", rollup.signed(feed)) is False
    want = {("a", "en", "v1", 1, 0), ("b", "en", "v2", 1, 12)}
    assert {tuple(r) for r in totals.totals().collect()} == want
    # sums without a commit, as a lost driver leaves them, do not count
    spark.read.parquet(totals.deltas).withColumn("attempt", F.lit("lost")) \
        .withColumn("batch", F.lit("two")).write.mode("append").parquet(totals.deltas)
    again = rollup.Rollup(spark, str(tmp_path))
    assert {tuple(r) for r in again.totals().collect()} == want
    again.commit("three", rollup.signed(feed.limit(0)))
    assert {tuple(r) for r in again.totals().collect()} == want


def test_counts_of_odd_rows(crowded):
    got = rollup.counted(crowded.withColumn("tokens", F.lit("x"))).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.tokens for r in got}[3] == 0


def test_copies_keep_apart_in_windows():
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, 40, rng.integers(5, 30)), 0) for _ in range(120)]
    docs = [texts[i] for i in rng.permutation(np.repeat(np.arange(120), 3))]
    pieces = packing.packed_shard(docs, 128)
    windows: dict = {}
    for doc, _, _, sequence, _ in pieces:
        windows.setdefault(sequence, []).append(doc)
    twice = sum(len(w) - len({docs[d].tobytes() for d in set(w)}) for w in windows.values()
                if len(set(w)) == len(w))
    assert twice <= 8  # at the very end, where nothing but copies is free
    same = packing.packed_shard([texts[0]] * 9, 64)  # nothing but copies
    assert sum(p[2] for p in same) == 9 * len(texts[0])


def test_stage_cuts_planted_lines_and_keeps_copies(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)

    def doc(n=12):
        return [" ".join(f"w{i}" for i in rng.integers(0, 5000, 9)) for _ in range(n)]
    copied, rows = doc(), []
    for source, n in (("small", 300), ("hot", 2000)):
        for i in range(n):
            text = doc()
            if i % 50 == 0:
                text[int(rng.integers(0, 12))] = "Subscribe to our newsletter"
            rows.append((len(rows), "\n".join(text), "en", source, 0))
        for i in range(n // 5):  # copies, half of them with one line changed
            text = list(copied)
            if i % 2:
                text[int(rng.integers(0, 12))] = doc(1)[0]
            rows.append((len(rows), "\n".join(text), "en", source, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                 "n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert len(got) == len(rows)
    lost = 0
    for i, text, *_ in rows:
        want = "\n".join(x for x in text.split("\n") if x != "Subscribe to our newsletter")
        lost += got[i] != want
    assert lost == 0
