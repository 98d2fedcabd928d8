"""The registered corpus queries and the pipeline."""

import re

import pytest

import __spark_entry__ as E
import corpus_pipeline
from tests.check_oracle import compare, connect
from tillscope.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(connect(FOLDER), spark, FOLDER, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_native_queries_have_no_python(spark):
    for name in ("op3_source_mix", "op10_order_minhash"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        for word in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"):
            assert word not in plan, (name, word)


def test_rollup_equals_brute_force(spark):
    from collections import Counter

    from tillscope.llm.tokens import Encoder, tokenizer_path

    encoder, want = Encoder(tokenizer_path()), Counter()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    for r in docs:
        key = (r.source, r.lang)
        want[key, "documents"] += 1
        want[key, "tokens"] += len(encoder.encode(r.text)) // 4
    got = QUERIES["op6_token_rollup"](spark, FOLDER).collect()
    assert {r.tokenizer for r in got} == {"byte_bpe_50k/1"}
    assert {((r.source, r.lang), r.documents, r.tokens) for r in got} == {
        (k, n, want[k, "tokens"]) for (k, what), n in want.items() if what == "documents"}


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        rows = docs.count()
        assert (rows == before) == (name == "line dedup"), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.filter("start = 0").count() == rows


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    for table in (odd, nothing):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        docs.count()
