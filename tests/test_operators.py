"""Small cases with known results, edge cases, and comparisons with plain versions."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexassay.functions import latex, replies
from lexassay.functions.dims import pinyin_syllables
from lexassay.operators import cleaning, corpus, dictionary, edits, multivalue, nested, records, reports, rules, scorers, similarity, tokenizing

values = multivalue.split_values


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        ("  ", []),
        ("A；；C", [(1, "A"), (3, "C")]),
        ("C|B|", [(1, "C"), (2, "B")]),
        ("B、D；B", [(1, "B"), (2, "D"), (3, "B")]),
        ('"188";"[-6, 4)";"813米"', [(1, "188"), (2, "[-6, 4)"), (3, "813米")]),
        ('12 , "[-2, 1)" , 224', [(1, "12"), (2, "[-2, 1)"), (3, "224")]),
        ("（1）A（2）D", [(1, "A"), (2, "D")]),
        ("①400②35,333③(-7, 6)", [(1, "400"), (2, "35,333"), (3, "(-7, 6)")]),
        ("1．D\n2．D", [(1, "D"), (2, "D")]),
        ("1、D  2、B", [(1, "D"), (2, "B")]),
        ("[-9, 9)", [(1, "[-9, 9)")]),
        ("34,341", [(1, "34,341")]),
        ("8/9 ； 37,119 ； 7/11", [(1, "8/9"), (2, "37,119"), (3, "7/11")]),
        ("ignored quietly", [(1, "ignored quietly")]),
        ("C B A", [(1, "C"), (2, "B"), (3, "A")]),
        ("T/错误", [(1, "T"), (2, "错误")]),
        ("C##A", [(1, "C"), (2, "A")]),
        ('["B", "A"]', [(1, "B"), (2, "A")]),
        ('["A", "", null, "D"]', [(1, "A"), (4, "D")]),
        ("2．1小时", [(1, "2．1小时")]),
        ("\U000f0000;b", [(1, "\U000f0000"), (2, "b")]),
    ],
)
def test_values(text, want):
    assert values(text) == want


def test_numbers_follow_the_expected_count():
    assert values("163,155", 2) == [(1, "163"), (2, "155")]
    assert values("163,155", 1) == [(1, "163,155")]


def test_prose_is_one_value():
    assert len(values("据苍溪合作社统计，汛期主旨的方向为84.4处，比上次多96.")) == 1
    assert len(values('"We must go soon," said Ferrow, "we must replace it alone."')) == 1


def test_values_of_any_length_are_split():
    a, b = "the slow retreat of the northern glaciers since 1850", "the quick rise of the sea level in the last hundred years"
    assert values(f'"{a}"; "{b}"') == [(1, a), (2, b)]
    assert values(f"{a}; {b}") == [(1, a), (2, b)]
    assert values(f"“{a}” “{b}”") == [(1, a), (2, b)]
    zh = "北方大陆冰川在过去一百五十年里的缓慢后退", "沿海地区海平面在最近一百年里的快速上升"
    assert values("；".join(zh)) == list(enumerate(zh, 1))
    assert values("、".join(zh)) == list(enumerate(zh, 1))
    assert len(values("Before noon, Lee counted the nine lamps; the engine stayed bright.")) == 1
    assert values("The ferry sank.; The lamp was lost.") == [(1, "The ferry sank."), (2, "The lamp was lost.")]


def test_numbering_of_any_length():
    for mark in ("({})", "{}. ", "第{}空："):
        text = " ".join(mark.format(i) + "A" for i in range(1, 301))
        assert values(text) == [(i, "A") for i in range(1, 301)]
    circled = [chr(c) for a, b in ((0x2460, 0x2474), (0x3251, 0x3260), (0x32B1, 0x32C0)) for c in range(a, b)]
    assert values("".join(c + "B" for c in circled)) == [(i, "B") for i in range(1, 51)]


def test_more_spans_than_placeholders():
    n = 140_000
    assert len(values(";".join(['"a,b"'] * n))) == n


def test_long_fields_are_split_whole():
    assert len(values(";".join(["A"] * 20_000))) == 20_000


def test_answer_values_leaves_refusals_whole(spark):
    rows = [(1, "题目____。", "A；B"), (2, "题目____。", "抱歉，由于缺少配图，暂时不能给出解答，请换一道题再试。"), (3, None, None), (4, "x", "")]
    q = spark.createDataFrame(rows, "row_id long, d string, a string").select("row_id", F.struct(F.col("d").alias("description"), F.col("a").alias("answers"), F.array().cast("array<struct<stem:string,options:map<string,string>>>").alias("stems")).alias("query"), F.lit(1).alias("value"))
    assert sorted(map(tuple, multivalue.answer_values(q).collect())) == [(1, 1, "A"), (1, 2, "B")]
    assert multivalue.answer_values(q.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert replies.common_subsequence(a, b) == t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_common_substring(a, b):
    want = max([j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b], default=0)
    assert similarity._common_substring(a, b) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("a b c A D".split()), max_size=9), st.lists(st.sampled_from("a b c A D".split()), max_size=9))
def test_edits_turn_source_into_target(a, b):
    out = list(a)
    for s, e, _, cor in reversed(edits.edits(a, b)):
        out[s:e] = cor.split(" ") if cor else []
    assert out == b


def test_edit_round_trip(spark):
    df = spark.createDataFrame([(1, "He go to to school".split(), "He goes to school .".split()), (2, ["a"], []), (3, [], ["b"]), (4, None, ["b"])], "id int, a array<string>, b array<string>")
    e = df.withColumn("e", edits.token_edits("a", "b")).where("a is not null")
    r = e.select("id", "b", edits.applied(F.col("a"), F.col("e")).alias("x"), edits.parsed_m2(edits.m2_text(F.col("a"), F.col("e"))).alias("m"), F.size("e").alias("n")).collect()
    for x in r:
        assert x["x"] == x["b"]
        assert len([y for y in x["m"]["edits"] if y["type"] != "noop"]) == x["n"]


CALLS = [
    (1, json.dumps({"query": {"_id": 5, "stems": [{"stem": "s0", "options": {"A": "x", "B": "y"}}, {"options": [{"A": "p"}, {"B": "q"}]}], "answers": [["a", "b"], "c"]}, "data": {"5": [{"error_sent": "d", "error_detail": [{"error_type": None}, {"error_type": "t"}]}, {"error_sent": "e"}]}})),
    (2, json.dumps({"request": {"query": {"_id": "7", "stems": None, "answers": "plain"}}, "response": {"data": None}})),
    (3, json.dumps({"query": json.dumps({"_id": 9.0, "answers": ["u"]}), "data": {"9": []}})),
    (4, "{broken"),
    (5, None),
    (6, "[]"),
    (7, "{}"),
]


def test_call_entities(spark):
    log = spark.createDataFrame(CALLS, "log_id long, payload string").withColumn("value", F.lit("clash"))
    got = set(map(tuple, nested.call_entities(log).collect()))
    assert got == {
        (1, "stem", 0, "", "s0"),
        (1, "option", 0, "A", "x"),
        (1, "option", 0, "B", "y"),
        (1, "option", 1, "A", "p"),
        (1, "option", 1, "B", "q"),
        (1, "answer", 0, "0", "a"),
        (1, "answer", 0, "1", "b"),
        (1, "answer", 1, "0", "c"),
        (1, "error", 0, "0", ""),
        (1, "error", 0, "1", "t"),
        (2, "answer", 0, "0", "plain"),
        (3, "answer", 0, "0", "u"),
    }
    assert nested.call_entities(log.limit(0)).count() == 0


def test_child_rows_link_to_parents(spark):
    log = spark.createDataFrame(CALLS, "log_id long, payload string")
    calls = nested.parsed_calls(log)
    schema = nested.merged_schema(calls, ["query", "report"])
    assert schema["query", ".answers"] == {"array", "string"}
    nodes = nested.explode_levels(calls, "log_id", ["query", "report"], schema)
    stems = nested.level_table(nodes, "log_id", "query.stems[]", ["stem"])
    options = nested.level_table(nodes, "log_id", "query.stems[].options.*", [])
    joined = options.join(stems.select(F.col("node").alias("parent"), "stem"), "parent").select("name", "value", "stem").collect()
    assert sorted(map(tuple, joined)) == [("A", "x", "s0"), ("B", "y", "s0")]


def test_any_key_keeps_its_values_and_child_rows(spark):
    payload = '{"a-b": [{"x.y": 1, "z": {"it\'s": "deep", "q\\"\'": 2}}], "a.b": "v", "a[0]": [["w", null]], "": [3], "*": [4], "[]": [5]}'
    df = spark.createDataFrame([(1, payload), (2, None), (3, "[]"), (4, '{"a.b": [1]}')], "id long, t string").select("id", F.try_parse_json("t").alias("v"))
    schema = nested.merged_schema(df, ["v"])
    nodes = nested.explode_levels(df, "id", ["v"], schema).collect()
    got = {(r["node"], r["parent"], r["value"]): r["fields"] for r in nodes}
    assert got["1||", None, None]['v["a.b"]'] == "v"
    assert got['1|v["a-b"][]|0', "1||", None] == {'["x.y"]': "1", 'z["it\'s"]': "deep", 'z["q\\"\'"]': "2"}
    assert ('1|v["a[0]"][][]|0.0', '1|v["a[0]"][]|0', "w") in got and ('1|v["a[0]"][][]|0.1', '1|v["a[0]"][]|0', None) in got
    assert {('1|v[""][]|0', "1||", "3"), ('1|v["*"][]|0', "1||", "4"), ('1|v["[]"][]|0', "1||", "5"), ('4|v["a.b"][]|0', "4||", "1")} <= set(got)
    # every parent below the record is a node
    assert {r["parent"] for r in nodes if r["level"] and not r["parent"].endswith("||")} <= {r["node"] for r in nodes}
    assert len({r["node"] for r in nodes}) == len(nodes)


def test_answers_nested_deeper_are_kept(spark):
    log = spark.createDataFrame([(1, '{"query": {"answers": [["a", ["b", "c"]], "d"]}}')], "log_id long, payload string")
    assert sorted(map(tuple, nested.call_entities(log).collect())) == [(1, "answer", 0, "0", "a"), (1, "answer", 0, "1.0", "b"), (1, "answer", 0, "1.1", "c"), (1, "answer", 1, "0", "d")]


def _plain_brackets(text, a, b):
    lefts, bad = [], []
    for i, c in enumerate(text):
        if c == a:
            lefts.append(i)
        elif c == b:
            if lefts:
                lefts.pop()
            else:
                bad.append(i)
    return sorted(bad + lefts)


def test_brackets_equal_a_stack(spark):
    texts = ["(a)", ")(", "((a)", "(a))(", "（x）(y)】", "[(])", "", None, "《a》》《"]
    s = spark.createDataFrame([(i, "t", 0, t) for i, t in enumerate(texts)], "row_id long, section string, item int, text string")
    got = sorted((r["row_id"], r["start_at"]) for r in rules.brackets(s).collect())
    from lexassay.functions.dims import BRACKETS

    want = sorted((i, p) for i, t in enumerate(texts) if t for a, b in BRACKETS for p in _plain_brackets(t, a, b))
    assert got == want


def test_reports_number_and_nest(spark):
    s = spark.createDataFrame([(1, "d", -1, "对。。吗？？ www. abc"), (2, "d", -1, "fine")], "row_id long, section string, item int, text string")
    r = reports.nested(reports.union(rules.symbol_runs(s), rules.web_addresses(s), rules.symbol_runs(s))).collect()
    assert len(r) == 1 and [d["_id"] for d in r[0]["errors"][0]["error_detail"]] == [1, 2, 3]


def test_near_texts_against_all_pairs(spark):
    base = "在岚坞村东部，弹簧先削弱滑块，改造后又影响新建的光电管。"
    texts = [base, base, base.replace("弹簧", "钢丝"), base + "！", "完全不同的另一段文字，与前面的内容没有任何关系，只是为了对照。", None]
    df = spark.createDataFrame([(i, 7, t) for i, t in enumerate(texts)] + [(90, None, base), (91, 8, base)], "id long, c int, t string")
    got = sorted((r["id_a"], r["id_b"], r["distance"]) for r in similarity.similar_candidates(df, "c", "id", "t").collect())
    assert got == [(0, 2, 2), (0, 3, 1)]
    members = {r["id"]: r["class_id"] for r in similarity.near_members(df, "id", "t").collect()}
    assert members[1] == 0 and members[2] == 2


def test_suggestions_against_all_pairs(spark):
    words, known = ["recieve", "hte", "cat", "zzzzzz"], ["receive", "the", "cut", "cart", "bat"]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for w in words:
        best = min((lev(w, k), k) for k in known)
        if best[0] <= 2:
            want[w] = best
    f = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    got = {r["word"]: (r["distance"], r["suggestion"]) for r in dictionary.suggestions(f(words), f(known)).collect()}
    assert got == want


def test_suggestions_three_edits_away_and_of_any_length(spark):
    f = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    got = dictionary.suggestions(f(["governmnt", "gvrnmet", "x", "ab" * 17, "qqqqqqqq"]), f(["government", "a", "ab" * 16 + "c", "street"]))
    assert {r["word"]: (r["suggestion"], r["distance"]) for r in got.collect()} == {"governmnt": ("government", 1), "gvrnmet": ("government", 3), "x": ("a", 1), "ab" * 17: ("ab" * 16 + "c", 2)}


def test_tex_rules_on_their_views(spark):
    texts = [
        "See Equation 3.\nas in Figure 2, by eq \\ref{a}",
        "% an big a apple\nfine % a apple\nhalf 50\\% a apple",
        "\\begin{verbatim}a apple\\end{verbatim} x \\begin{equation}a apple -3\\end{equation} y",
        "so $a apple -3$ and -4",
        "\\documentclass{nature}\nas in Figure 2",
        "the the $x$",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").select("row_id", F.lit("text").alias("section"), F.lit(0).alias("item"), "text")
    views = {r["row_id"]: (r["code"], r["no_equations"], r["no_math"]) for r in rules.tex_views(d).collect()}
    assert views[1][0] == "\nfine \nhalf 50\\% a apple"
    assert views[2][0].startswith("\\begin{verbatim} \\end{verbatim} x ")
    assert views[2][1] == "\\begin{verbatim} \\end{verbatim} x \\begin{equation} xxx \\end{equation} y"
    assert views[3][1:] == (texts[3], "so $xxx$ and -4")
    got = {(r["row_id"], r["rule"]): r["hits"] for r in rules.tex_writing_rules(d).collect()}
    assert got == {(0, "full form in sentence"): 2, (0, "eq without brackets"): 2, (1, "a before vowel"): 1, (3, "bare minus"): 1, (5, "repeated word"): 1}


def test_pinyin(spark):
    assert 390 <= len(pinyin_syllables()) <= 430
    df = spark.createDataFrame([("nihao",), ("zhongguo",), ("xian",), ("street",), ("lve",)], "w string")
    assert [r[0] for r in df.select(dictionary.is_pinyin(F.col("w"))).collect()] == [True, True, True, False, True]


def test_longest_match():
    assert dictionary.longest_match({"頭": "头", "頭髮": "头发", "發": "发"})("頭髮發了") == "头发发了"


def test_ranks_and_vocabulary(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate("b a b c c b".split())], "doc_id long, pos int, token string")
    v = {r["symbol"]: (r["idx"], r["n"]) for r in corpus.vocabulary(rows).collect()}
    assert v["b"] == (3, 3) and v["c"] == (4, 2) and v["a"] == (5, 1) and len(v) == 8
    docs = spark.createDataFrame([(1, "b a b c c b".split()), (2, []), (3, None), (4, ["zz", "c"])], "doc_id long, t array<string>")
    want = {1: [3, 2, 3, 4, 4, 3, 1], 2: [1], 3: None, 4: [2, 4, 1]}
    for looked_up in (corpus.LOOKED_UP, 4, 0):
        assert {r["doc_id"]: r["ids"] for r in corpus.encoded(docs, "doc_id", "t", corpus.vocabulary(rows, threshold=2), looked_up).collect()} == want
    assert corpus.vocabulary(rows.limit(0)).count() == 8


def test_chunks(spark):
    tags = [["B-PER", "I-PER", "O", "B-LOC"], ["I-LOC", "I-LOC", "I-PER", "B-PER"], ["O"], [], None]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(tags)], "s int, tags array<string>")
    got = {r["s"]: None if r["c"] is None else [tuple(x) for x in r["c"]] for r in t.select("s", corpus.chunks(F.col("tags")).alias("c")).collect()}
    assert got == {0: [("PER", 0, 2), ("LOC", 3, 4)], 1: [("LOC", 0, 2), ("PER", 2, 3), ("PER", 3, 4)], 2: [], 3: [], 4: None}


def test_batches_keep_their_bounds(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 90 + 1).alias("size"))
    b = corpus.batches_by_size(df, "id", "size", 200, 8, 3).groupBy("part", "batch").agg(F.count("*").alias("n"), F.max("size").alias("m"), F.sum("size")).collect()
    assert sum(r["n"] for r in b) == 500
    assert all(r["n"] <= 8 and (r["n"] * r["m"] <= 200 or r["n"] == 1) for r in b)


@pytest.mark.parametrize("a, b", [("\\frac{1}{2}", "1/2"), ("\\frac{\\frac{a}{b}}{c+1}", "(a/b)/(c+1)"), ("\\sqrt{23}x\\leq 10", "√(23)x≤ 10"), ("a_{n}= 20n", "a_n= 20n"), ("\\angle ABC= 51^{\\circ}", "∠ ABC= 51°"), (None, None), ("", "")])
def test_plain_formulas(a, b):
    assert latex.plain(a) == b


def test_word_pieces():
    v = {"un", "##aff", "##able", "able"}
    assert tokenizing.greedy_pieces("unaffable", v, 8) == ["un", "##aff", "##able"]
    assert tokenizing.greedy_pieces("unx", v, 8) == ["[UNK]"]
    assert tokenizing.greedy_pieces("a" * 101, {"a", "##a"}, 3) == ["[UNK]"]


def test_small_sequence_operators(spark):
    df = spark.createDataFrame([("xu\u011b", "a@@ b c", ["x", "<unk>"], ["p", "q"], [0, 1])], "p string, b string, h array<string>, s array<string>, al array<int>")
    r = df.select(tokenizing.toned(F.col("p")), tokenizing.without_bpe(F.col("b")), tokenizing.unknowns_replaced(F.col("h"), F.col("s"), F.col("al")), tokenizing.basic_tokens(F.lit("He said: 好。"))).first()
    assert tuple(r) == ("xue3", "ab c", ["x", "q"], ["he", "said", ":", "好", "。"])
    e = spark.createDataFrame([([[1.0, 0.0], [0.0, 0.5], [0.0, 1.0]],)], "e array<array<double>>")
    assert e.select(tokenizing.best_path(F.col("e"), [[0.0, -2.0], [0.0, 0.0]])).first()[0] == [1, 1, 1]


def test_scores(spark):
    s = spark.createDataFrame([(1, 0, 10.0), (1, 1, 9.0), (2, 0, 10.0), (2, 1, 9.99)], "id int, mask int, score double")
    assert {tuple(r) for r in scorers.best_subset(s, "id").collect()} == {(1, 1), (2, 0)}
    h = spark.createDataFrame([(1, "a", -1.0), (1, "b", -2.0)], "id int, hyp string, score double")
    x = spark.createDataFrame([(1, "a", "x", -3.0), (1, "a", "y", -0.1), (1, "b", "z", -0.2)], "id int, hyp string, token string, log_p double")
    assert [(r["hyp"], r["token"]) for r in scorers.beam_step(h, x, "id", 1).orderBy("rank").collect()] == [("a", "y"), ("b", "z")]
    o = spark.createDataFrame([(1, i, c) for i, c in enumerate("MSSDMI")], "id int, pos int, op string")
    assert sorted((r["start_at"], r["end_at"]) for r in edits.operation_runs(o, "id", False).collect()) == [(1, 4), (5, 6)]
    assert sorted((r["start_at"], r["end_at"]) for r in edits.operation_runs(o, "id", True).collect()) == [(1, 3), (3, 4), (5, 6)]


def test_more_sequence_operators(spark):
    one = spark.range(1)
    a = lambda *x: F.array(*[F.lit(i).cast("long") for i in x])
    r = one.select(
        corpus.collated(a(5, 6, 1), 5, 0),
        corpus.collated(a(5, 6, 1), 5, 0, left=True, eos_first=1),
        corpus.truncated_ids(a(1, 9), 5),
        corpus.packed(F.array(*map(F.lit, (3, 4, 5, 9, 1))), 8),
        cleaning.cut_before_capitals(F.lit("It is.So be it. Yes")),
        records.canonical_answers(F.lit('[["a", "b"], "c"]')),
        records.canonical_answers(F.lit("plain")),
    ).first()
    assert list(r) == [[5, 6, 1, 0, 0], [0, 0, 1, 5, 6], [1, 2], [0, 0, 1, 2, 3], ["It is.", "So be it. Yes"], [["a", "b"], ["c"]], [["plain"]]]
    t = one.select(corpus.trimmed_pair(a(*range(9)), a(*range(3)), 6).alias("x")).select("x.*").first()
    assert (len(t["a"]), len(t["b"])) == (3, 3)


def test_more_scores(spark):
    s = spark.createDataFrame([(1, -1.0), (1, -3.0), (1, float("-inf"))], "id int, log_p double")
    assert scorers.sentence_scores(s, "id").first()["score"] == 2.0
    c = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.2), (1, "c", 0.1)], "id int, token string, p double")
    assert [scorers.sampled(c, "id", "p", F.lit(u), 2).first()["token"] for u in (0.0, 0.7, 0.8, 0.99)] == ["a", "a", "b", "b"]
    o = spark.createDataFrame([("x", "y", "y"), ("x", "y", "z"), ("x", "y", "x"), ("x", "x", "q"), ("x", "x", "x")], "original string, truth string, predicted string")
    assert scorers.outcomes(o).count() == 5
    e = spark.createDataFrame([(1, "d", 0, 5, 6)], "row_id int, section string, item int, start_at int, end_at int")
    t = spark.createDataFrame([(1, "d", 0, "0123456789abc")], "row_id int, section string, item int, text string")
    assert reports.with_context(e, t).first()["context"] == "123456789"


def test_previous_row_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("t"), (F.col("id") * 7).alias("v"))
    got = {(r["k"], r["t"]): r["b"] for r in corpus.with_previous(df, "k", ["t"], "v", "b").collect()}
    last = {}
    for i in range(1000):
        k = int(i % 3 == 0)
        assert got[k, i] == last.get(k)
        last[k] = i * 7
