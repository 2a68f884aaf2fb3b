"""Chunks of any size give what one walk gives; composition is associative; one huge text occupies many tasks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexassay.llm import sentences
from tests.conftest import SMALL

from .test_llm import _composed, _questions

BITS = ["Mr. Lee left. ", "他说：“走吧。快走！”后来下雨了。", "已知${a. b! c}$成立。", "$" + "x. y " * 200 + "$", "(1)", "12. ", "例12", "解：", "“没有结束。", "«Oui. Non.» ", "e.g. this, ", "A. B. Smith came. ", "\n", "​", "…", "...", "?!", "《等一等！》", "It cost 3.50. ", "“Well?” asked X. ", "'tis’s ", "$", "」", "”", "U.S. ", "  ", "[第3题]", "word " * 30]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40), st.sampled_from([16, 40, 100, 400, 1000, 8192]))
def test_any_chunks_equal_one_walk(bits, chunk):
    text = "".join(bits)
    assert _composed(text, chunk) == sentences.sentence_spans(text)


def test_formulas_and_quotations_across_chunk_ends():
    for inner in ("x + 1. y " * 100, "他走了。" * 300):
        for a, b in (("$", "$"), ("“", "”"), ("《", "》"), ("«", "»"), ("", "")):
            text = f"一句。设{a}{inner}{b}成立。又一句。"
            for chunk in (16, 60, 256, 900):
                assert _composed(text, chunk) == sentences.sentence_spans(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(BITS), min_size=3, max_size=40), st.integers(0, 30))
def test_composition_is_associative(bits, at):
    fs = [sentences.chunk_function(c) for c in sentences.split_chunks("".join(bits), 20)]
    at = min(at, len(fs))
    assert sentences.compose(fs) == sentences.compose([sentences.compose(fs[:at]), sentences.compose(fs[at:])])


@pytest.mark.parametrize("chunk, fan_in", [(30, 2), (100, 4), (100, 1024)])
def test_blocks_of_chunks_through_spark(spark, chunk, fan_in):
    rng = random.Random(chunk)
    text = lambda n: "".join(rng.choice(BITS) for _ in range(n))
    rows = [(i, 1.0, text(40), None, [text(20), None, "", "短。", text(30)], None) for i in range(6)] + [(99, 1.0, None, None, None, None)]
    got = sorted(map(tuple, sentences.sentences(_questions(spark, rows), chunk, fan_in).collect()))
    want = sorted((i, f, k, a, b) for i, _, d, _, items, _ in rows for f, k, t in [("description", -1, d), *[("solutions", k, t) for k, t in enumerate(items or [])]] for a, b in sentences.sentence_spans(t))
    assert got == want


def test_one_huge_text_is_spread_over_tasks(spark):
    one = "Mr. Lee said: “Go. Stay!” and the ferry left at 3.45 p.m. yesterday. "
    df = spark.range(1).select(F.col("id").alias("row_id"), F.repeat(F.lit(one), 60_000).alias("text"))
    parts = sentences._long_texts(df, ["row_id"], 8192)
    assert parts.count() == 60_000
    tasks = sentences.spread_chunks(df, ["row_id"], 8192).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and sum(r["count"] for r in tasks) == -(-60_000 * len(one) // 8192)


def test_tables_give_the_same_in_small_chunks(spark):
    q = spark.read.parquet(f"{SMALL}/questions.parquet")
    assert sorted(map(tuple, sentences.sentences(q, 64, 8).collect())) == sorted(map(tuple, sentences.sentences(q).collect()))
