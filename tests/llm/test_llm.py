"""The operators for training text against definitions, brute force and edge cases."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexassay.llm import canonical as C
from lexassay.llm import leakage, mixture, pairs, queries, sentences, truncation
from tests.conftest import SMALL

POOL = [chr(c) for a, b in C.RANGES for c in range(a, b) if not 0xD800 <= c < 0xE000]


# --- canonical ------------------------------------------------------------------------------------------


def test_canonical_equals_its_definition():
    rng = random.Random(5)
    marks = [c for c in POOL if unicodedata.combining(c)]
    for _ in range(20_000):
        t = "".join(rng.choice(rng.choice((POOL, marks, "aeé ，中한가각\u200b\r\nＡｶﾞﾊﾟ"))) for _ in range(rng.randint(1, 9)))
        c = C.canonical(t)
        assert c == C.canonical_reference(t)
        assert C.canonical(c) == c


@pytest.mark.parametrize("a, b", [("Ａ．", "A."), ("e\u0301", "é"), ("a\u200bb", "ab"), ("x\u00a0y", "x y"), ("ѕеа", "sea"), ("⼤⽔", "大水"), ("\uf967", "不"), ("ｶﾞ", "ガ"), ("µ", "μ"), ("Å", "Å"), ("a\u200b\u0301", "á"), ("1\u3000 2", "1  2")])
def test_drawn_the_same(a, b):
    assert C.canonical(a) == C.canonical(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("é", "e"), ("²", "2"), ("①", "1"), ("末", "未"), ("a b", "a  b"), ("ø", "o"), ("、", ","), ("a\nb", "a b")])
def test_drawn_differently(a, b):
    assert C.canonical(a) != C.canonical(b)


def _questions(spark, rows):
    schema = "row_id long, _id double, d string, a string, s array<string>, t string"
    q = spark.createDataFrame(rows, schema)
    return q.select("row_id", F.struct("_id", F.col("d").alias("description"), F.col("a").alias("answers"), F.col("s").alias("solutions"), F.col("t").alias("type"), F.array().cast("array<struct<stem:string,options:map<string,string>>>").alias("stems")).alias("query"), F.lit("clash").alias("field"), F.lit("clash").alias("text"))


def test_same_looking_pairs(spark):
    rows = [
        (1, 7.0, "ab c", "A", ["x", "y"], None),
        (2, 7.0, "ab\u00a0c", "Ａ", ["x", "ｙ"], None),
        (3, 8.0, "ab c", "Ａ", ["x", "y", ""], None),
        (4, None, None, None, None, None),
        (5, 9.0, "\u200b", "\u200b", [], None),
        (6, 9.0, " ", "", [None], None),
        (2, 7.0, "ab\u00a0c", "Ａ", ["x", "ｙ"], None),
    ]
    got = sorted(map(tuple, C.same_looking_pairs(C.question_texts(_questions(spark, rows))).collect()))
    assert got == [(1, 2, "answers"), (1, 2, "description"), (1, 2, "solutions"), (2, 3, "description")]
    assert C.same_looking_pairs(C.question_texts(_questions(spark, rows).limit(0))).count() == 0


def test_same_looking_pairs_equal_brute_force(spark):
    q = spark.read.parquet(f"{SMALL}/questions.parquet")
    texts = C.question_texts(q).collect()
    want = set()
    by = {}
    for r in texts:
        raw = tuple(x or "" for x in r["items"])
        c = tuple(map(C.canonical_reference, raw))
        if any(not x.isspace() for x in "".join(c)):
            by.setdefault((r["field"], r["scope"], c), set()).add((r["row_id"], raw))
    for (f, _, _), g in by.items():
        want |= {(a, b, f) for a, x in g for b, y in g if a < b and x != y}
    got = C.same_looking_pairs(C.question_texts(q)).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want


# --- sentences ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        (" \n\t ", []),
        ("Mr. Lee left at 3.45 p.m. The ferry (see p. 8) was old.", 2),
        ("Before 3.45 p.m., Lee left.", 1),
        ('"It is old!" asked Lee. "We go," said Lee, "we stay." Then he left.', 3),
        ("他说：“走吧。快走！”后来下雨了。", 2),
        ("“走吧？”小蔚问小禾。", 1),
        ("《等一等！》一文认为如此。", 1),
        ("12．设长为3．5米。求和……的值", 2),
        ("（1）[2-3]甲。乙", 2),
        ("J. K. Smith came. So did A. B.", 2),
        ("第一行\n第二行", 2),
        ("解：\n由此可知。", 1),
        ("${a. b! c}$成立.故选C", 2),
        ("Really?! Yes...but no。", 2),
        ("先生は「数は3ですか。」と聞きました。", 1),
        ("“没有结束。还有一句。", 2),
    ],
)
def test_sentences(text, want):
    got = sentences.sentence_spans(text)
    assert len(got) == (want if isinstance(want, int) else len(want)), [text[a:b] for a, b in got]


def _composed(text, chunk):
    parts = sentences.split_chunks(text, chunk)
    state, before, torn = sentences.LABELS, 0, {}
    for p in parts:
        to, n = sentences.chunk_function(p)
        for number, a, b in sentences.chunk_pieces(p, state, before):
            x, y = torn.get(number, (a, b))
            torn[number] = (min(a, x), max(b, y))
        before, state = before + n[state], to[state]
    return sorted(torn.values())


def test_composed_chunks_equal_one_walk(spark):
    q = spark.read.parquet(f"{SMALL}/questions.parquet").select("query.description").where("description is not null").limit(60).collect()
    whole = "".join(r[0] for r in q)
    for text in [r[0] for r in q] + [whole, "“" + "一句。" * 60, "x" * 500]:
        for chunk in (60, 150):
            assert _composed(text, chunk) == sentences.sentence_spans(text)


def test_long_texts_through_spark(spark):
    one = "他说：“走吧。快走！”后来下雨了。Mr. Lee left. "
    rows = [(1, 1.0, one * 40, None, [one * 30, None, "", "短。"], None), (2, 1.0, None, None, None, None)]
    df = _questions(spark, rows)
    got = sorted(map(tuple, sentences.sentences(df, chunk=100).collect()))
    want = sorted((1, f, i, a, b) for f, i, t in [("description", -1, one * 40), ("solutions", 0, one * 30), ("solutions", 3, "短。")] for a, b in sentences.sentence_spans(t))
    assert got == want
    assert sorted(map(tuple, sentences.sentences(df).collect())) == want


@settings(max_examples=150, deadline=None)
@given(st.text("ab。.!\n“”《》(1) \u200b", max_size=40))
def test_spans_are_ordered_and_cover_all_that_is_drawn(text):
    spans = sentences.sentence_spans(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    outside = "".join(text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]))
    assert not outside.replace("\u200b", "").strip()


# --- pairs ----------------------------------------------------------------------------------------------


def test_defective_responses(spark):
    rows = [(1, 1.0, "在岚坞村东部，弹簧先削弱滑块，改造后又影响新建的光电管。", "略", ["因为弹簧变弱。故选：D", ""], "选择题"), (2, None, None, None, None, None), (3, 1.0, "x", "B", ["很抱歉，题目信息不全，恕不作答。"], "选择题")]
    got = sorted(map(tuple, pairs.defective_responses(_questions(spark, rows)).collect()))
    assert got == [(1, "answers", "empty"), (2, "answers", "empty"), (2, "solutions", "empty"), (3, "solutions", "refusal")]
    assert pairs.defective_responses(_questions(spark, rows).limit(0)).count() == 0


# --- leakage --------------------------------------------------------------------------------------------


def _plain_align(a, b):
    best, row = (0, 0), [(0, 0)] * (len(b) + 1)
    for x in a:
        new = [(0, 0)]
        for j, y in enumerate(b, 1):
            d = row[j - 1]
            hit = (d[0] + leakage.MATCH, d[1] + 1) if x == y else (d[0] + leakage.MISMATCH, d[1])
            c = max(hit, (row[j][0] + leakage.GAP, row[j][1]), (new[-1][0] + leakage.GAP, new[-1][1]))
            new.append(c if c[0] > 0 else (0, 0))
            best = max(best, new[-1])
        row = new
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=15), st.text("abc", min_size=1, max_size=15))
def test_alignment_equals_plain_smith_waterman(a, b):
    assert leakage.align(a, leakage.np.ones(len(a), leakage.np.int64), b) == _plain_align(a, b)[1]


def test_leaks(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(20)] + [(99, None), (98, "")]
    t = items[4][1].split()
    docs = [
        (1, text(50) + " " + items[3][1].upper().replace(" ", ", ") + " " + text(20)),
        (2, text(10) + " " + " ".join(t[5:20]) + " " + text(10)),
        (3, text(10) + " " + " ".join(t[5:11]) + " " + text(10)),
        (4, " ".join("changed" if i in (9, 18) else w for i, w in enumerate(t))),
        (5, None),
        (6, ""),
        *[(100 + i, text(60)) for i in range(40)],
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    e = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, leakage.leaks(d, e).collect())) == [(1, 3), (2, 4), (4, 4)]
    assert leakage.leaks(d.limit(0), e).count() == 0
    assert leakage.leaks(d, e.limit(0)).count() == 0


def test_a_passage_of_one_item_in_many_documents_is_no_stock(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(40)) for i in range(20)]
    passage = " ".join(items[7][1].split()[:24])
    docs = [(i, f"{text(20)} {passage} {text(20)}") for i in range(9)] + [(100 + i, text(60)) for i in range(40)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, leakage.leaks(d, e).collect())) == [(i, 7) for i in range(9)]


# --- mixture --------------------------------------------------------------------------------------------


def test_mixture_reaches_its_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "small").when(F.col("id") % 3 == 1, "big").otherwise(F.when(F.col("id") % 2 == 0, "big")).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 40).cast("int")).alias("text"), F.lit(1).alias("copy"))
    targets = spark.createDataFrame([("small", 0.6, 3), ("big", 0.4, 1), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    p = mixture.plan(docs, targets, queries.TOKENIZER)
    by = {w["source"]: w for w in p}
    assert abs(by["small"]["share"] - 0.6) < 0.01 and abs(by["big"]["share"] - 0.4) < 0.01
    m = mixture.mixture(docs, p)
    n = {r["source"]: r for r in m.groupBy("source").agg(F.max("copy").alias("most"), F.count("*").alias("n"), F.sum(mixture.token_count(F.col("text"), queries.TOKENIZER)).alias("tokens")).collect()}
    for s in ("small", "big"):
        assert n[s]["most"] <= by[s]["max_repeats"]
        assert (n[s]["n"], n[s]["tokens"]) == (by[s]["documents_drawn"], by[s]["tokens_drawn"])
    assert m.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    again = mixture.mixture(docs, mixture.plan(docs, targets, queries.TOKENIZER))
    assert m.select("doc_id", "copy").collect() == again.select("doc_id", "copy").collect()
    assert mixture.mixture(docs.limit(0), mixture.plan(docs.limit(0), targets, queries.TOKENIZER)).count() == 0


def test_poisson_inversion_has_the_right_mean():
    flat = dict.fromkeys(range(mixture.BUCKETS), 10)
    m = mixture.solve_mean(flat, 0.7 * 10 * mixture.BUCKETS, 4)
    c = mixture.thresholds(m, 4)
    assert abs(sum(mixture.uses(b, c) for b in flat) / mixture.BUCKETS - 0.7) < 0.001
    assert mixture.uses(0, mixture.thresholds(float("inf"), 3)) == 3


# --- truncation -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, cut",
    [
        ("一句完整的话。", False),
        ("一句话没有说", True),
        ("甲。\nA．甲\nB．乙\nC．丙\nD．丁", False),
        ("甲。\n关键词：混合物；残渣", False),
        ("甲。\n故选C", False),
        ("The old ferry was lost.\nSee also Fig. 19", False),
        ("沿途商帮低于预期……", False),
        ("In Greyhaven the old fer...", True),
        ("It took 4 hours to carr [more]", True),
        ("由铸币的来源可以�", True),
        ("The apples nea&nb", True),
        ("直线满足${\\frac{4}{11}+", True),
        ("直线满足${y= 2x}$．", False),
        ("Lee lost No. 29, a map, and met Dr.", True),
        (None, False),
        ("", False),
    ],
)
def test_cut_texts(spark, text, cut):
    fill = [(100 + i, "一句完整的话。", "s") for i in range(5)]
    d = spark.createDataFrame([(1, text, "s"), *fill], "doc_id long, text string, source string").withColumn("head", F.lit("clash"))
    assert (1 in {r[0] for r in truncation.cut_documents(d).collect()}) == cut


def test_field_limits_decide_inside_closing_lines(spark):
    body = "甲" * 20 + "。"
    rows = [(i, body + "乙" * 9, "s") for i in range(8)] + [(50, "乙" * 20 + "。\n来源：" + "丙" * 5, "s"), (51, "甲" * 3 + "。\n来源：丙", "s"), (52, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r[0] for r in truncation.cut_documents(d).collect()} == {*range(8), 50}
    rates = {r["source"]: (r["documents"], r["cut"]) for r in truncation.cut_rates(d).collect()}
    assert rates["s"] == (10, 9)
    assert truncation.cut_documents(d.limit(0)).count() == 0


def test_copies_make_no_closing_and_no_limit(spark):
    cut, complete = "甲" * 12 + "。\n乙丙丁戊", "甲" * 15 + "。\n来源：丙"
    rows = [*[(i, cut, "s") for i in range(6)], *[(10 + i, complete, "t") for i in range(6)], *[(20 + i, "己" * (i + 5) + "。", "s") for i in range(5)]]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r[0] for r in truncation.cut_documents(d).collect()} == {*range(6)}


def test_byte_limits_decide_inside_closing_lines(spark):
    closing = "甲" * 20 + "。\n来源：" + "丙" * 4
    rows = [(i, "甲" * (10 + i) + "a" * (70 - 3 * i), "s") for i in range(8)] + [(50, closing + "a" * (100 - len(closing.encode())), "s"), (51, closing, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r[0] for r in truncation.cut_documents(d).collect()} == {*range(8), 50}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    df = queries.queries()[name](spark, SMALL)
    assert len(df.collect()) > 0
