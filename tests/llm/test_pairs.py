"""Defective responses: each defect, alignment at any length, and what the alignments decide."""

import pytest
from pyspark.sql import functions as F

from lexassay.llm import pairs
from tests.conftest import SMALL

def test_defects():
    d = pairs.defect
    prompt = "【题1-2】在岚坞村东部，弹簧先削弱滑块，改造后又影响新建的光电管。小球的结论是否成立？"
    assert d(prompt, None, True) == "empty"
    assert d(prompt, ["", None], True) == "empty"
    assert d(prompt, ["（略）"], True) == "empty"
    assert d(prompt, ["……"], False) == "empty"
    assert d(prompt, ["很抱歉，该内容超出服务范围，恕不作答。"], True) == "refusal"
    assert d(prompt, ["Sorry, I cannot answer this question as it is outside my scope."], True) == "refusal"
    assert d(prompt, [prompt], True) == "copy"
    assert d(prompt, ["The old ferry was lost near the bridge and nobody followed it."], True) == "language"
    assert d(prompt, ["由木板的变化率略有下降可以推"], True) == "truncated"
    assert d(prompt, ["由木板的变化率略有下降可以推断，钢丝会影响弹簧。故选：D"], True) is None
    assert d(prompt, ["B"], False) is None
    assert d(None, ["B"], False) is None
    assert d("Translate the sentences above into Chinese. The old ferry was lost near the bridge.", ["渡船在桥边丢失了，没有人跟着它走过去。"], True) is None


PROMPT = "In Velmouth the old ferry carried nine lamps to the northern harbour. The keeper counted them twice before noon. Which lamp was lost?"


@pytest.mark.parametrize(
    "response, kind",
    [
        (PROMPT + " It was a very fine day.", "copy"),  # a tail
        (PROMPT + " " + "And so it went on and on for many other days. " * 6, None),  # more than a tail
        ("The keeper counted them twice before noon. Which lamp was lost?", None),  # less than most of it
        ("In Velmouth the old ferry carried nine lamps to the northern harbour. The keeper", "copy"),
        (PROMPT.upper().replace(" ", "  "), "copy"),
        (PROMPT.replace("lamps", "boats").replace("twice", "once"), "copy"),
        (PROMPT + " The answer is B", None),
        ("The lamp that the keeper of the old harbour lost was the ninth one, before noon.", None),
        (None, "empty"),
        (" - … ", "empty"),
        ("-" * 500, "empty"),
        ("（答案略）", "empty"),
        ("Sorry, I cannot answer this question.", "refusal"),
        ("Sorry, I cannot answer this question, " + "because the picture is missing, " * 40 + "please ask a teacher.", "refusal"),
        ("很抱歉，" + "由于题目信息不全，" * 100 + "无法给出答案。", "refusal"),
        ("The ferry could not be repaired, so the keeper had to answer for it. He gave the ninth lamp to a boy, who took it home.", None),
        ("The ninth lamp, because the keeper counted them tw", "truncated"),
        ("Der alte Hafen war nicht weit von der Stadt und die Lampe ist in dem Wasser.", "language"),
    ],
)
def test_kinds(response, kind):
    assert pairs.defect(PROMPT, [response], True) == kind


def test_long_texts_are_compared_whole():
    words = [f"w{i}" for i in range(6_000)]
    whole, other = " ".join(words), " ".join(reversed(words))
    assert pairs.is_copy(whole + " end", pairs.Prompt(whole)) and not pairs.is_copy(other, pairs.Prompt(whole))


def test_the_longest_common_subsequence_decides(spark, monkeypatch):
    """Where shingles are shared, the alignment tells copies from texts that reuse wording."""
    reuse = "The keeper of the northern harbour. The old ferry carried nine lamps. Before noon the keeper slept, twice, and nine boats of the town sank, one by one, without a sound or a light."
    assert pairs.defect(PROMPT, [reuse], True) is None
    q = spark.read.parquet(f"{SMALL}/questions.parquet")
    rows = q.select(F.col("query.description").alias("d"), F.col("query.solutions").alias("s")).where("d is not null and s is not null").collect()
    judge = lambda: [pairs.is_copy("\n".join(x or "" for x in r["s"]), pairs.Prompt(r["d"])) for r in rows]
    before = judge()
    monkeypatch.setattr(pairs, "common_subsequence", lambda a, b: len(a) + len(b))
    assert judge() != before


def test_alignment_scores_fall_with_gaps():
    near, far = (pairs.aligned(t, ("refusing", "answering"), 8, 40) for t in ("cannot answer", "cannot in any way answer"))
    assert near > far > 0.5 > pairs.aligned("cannot " + "x" * 60 + " answer", ("refusing", "answering"), 8, 40)
    assert pairs.aligned("answer cannot", ("refusing", "answering"), 8, 40) == 0
