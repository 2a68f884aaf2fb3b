"""The stack automaton on the ends of texts, and what each part of it decides."""

import pytest
from pyspark.sql import functions as F

from lexassay.llm import truncation
from tests.conftest import SMALL

WHOLE = [(100 + i, f"一句完整的话，第{i}句。", "s") for i in range(5)]


def _cut(spark, rows):
    d = spark.createDataFrame(rows + WHOLE, "doc_id long, text string, source string").withColumn("head", F.lit("clash")).withColumn("quote", F.lit("clash"))
    return {r[0] for r in truncation.cut_documents(d).collect()}


@pytest.mark.parametrize(
    "text, cut",
    [
        ("He said: “We went to the market (near the river.\nThen we came home.", True),
        ("He said: “We went to the market (near the river).\nThen we came home.”", False),
        ("他说：“我们走吧。\n后来下雨了。", True),
        ("他说：“我们走吧。后来下雨了。”", False),
        # an opening far back is a stray sign
        ("他说：“我们走吧。" + "后来下雨了。" * 9, False),
        ("The fare is (in total 3.50", True),
        ("The fare is low (see p. 4).", False),
        ("The fare is low. (end)", False),
        ("The fare is low.\n(end)", False),
        ("The fare is lo (more)", True),
        ("The fare is low. <b>Well", True),
        ("The fare is low. Well </b", True),
        ("The fare is low. Ca\\u00e", True),
        ("The fare is low; rises &am", True),
        ("The fare is 5 &amp; up.", False),
        ("“Well?” asked Lee.", False),
        ("She asked “Well?”", False),
        ("已知${y= 3.", True),
        ("已知${y= 3}$。", False),
        ("“+ 38}$，活塞的成”一句值得注意。", False),
        ("a" * 30_000 + ". He said", True),
        ("“" + "a" * 30_000 + ".", True),
        ("   \n ", False),
        ("\x00�", True),
    ],
)
def test_ends(spark, text, cut):
    assert (1 in _cut(spark, [(1, text, "s")])) == cut


def test_the_automaton_reads_the_whole_text():
    text = "(" + "甲。\n" * 5000
    w = truncation.walk(text)
    assert w["open"] == [None, 5000] and not w["sentence"]
    assert truncation.walk(text + ")")["open"] == [None, None]
    assert truncation.walk("“a (b “c” d) e”")["closed"][0][0] == 2


def test_sources_are_judged_by_their_own_habits(spark):
    # source a closes its pairs, source b lists with open brackets only
    rows = [(i, f"The harbour (It is of town {'x' * i}.) is old.", "a") for i in range(40)] + [(50, "The harbour (It is of town.", "a")]
    rows += [(200 + i, f"1( the harbour is of town {'x' * i}.", "b") for i in range(40)]
    got = _cut(spark, rows)
    assert 50 in got and not [x for x in got if x >= 200]


def test_a_source_without_end_marks_is_not_flagged_whole(spark):
    rows = [(i, f"the harbour of town {'x' * (i % 37)} number {i} is old and large", "bare") for i in range(60)]
    rows += [(200 + i, f"The harbour of town {i} is old.", "s") for i in range(40)] + [(300, "The harbour of to", "s")]
    got = _cut(spark, rows)
    assert 300 in got and not [x for x in got if x < 60]


def test_rates_count_every_document(spark):
    d = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "One two", "s"), (4, "One.", None), (4, "One.", None)], "doc_id long, text string, source string")
    assert {tuple(r) for r in truncation.cut_rates(d).collect()} == {("s", 3, 1, 1 / 3), (None, 2, 0, 0.0)}
    assert truncation.cut_rates(d.limit(0)).count() == 0


def test_the_automaton_decides(spark, monkeypatch):
    """Without what the automaton holds at the end no text away from a limit is found."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    with_it = truncation.cut_documents(d).count()
    empty = {"open": [None, None], "closed": [[0] * 10, [0] * 10], "sentence": False, "weak": False, "hanging": False, "escape": False, "formula": False}
    texts = [r[0] for r in d.select("text").where("text is not null").collect()]
    monkeypatch.setattr(truncation, "walk", lambda s: empty)
    structures = [truncation.structure(t) for t in texts]
    assert with_it > 0 and not any(x["sentence"] or x["escape"] or x["formula"] or x["quote"] is not None for x in structures)
