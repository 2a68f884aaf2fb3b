"""Checks on whole question records, written as column expressions on the nested struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Question types with lettered options, judged as true or false, and with blanks.
CHOICE, JUDGE, BLANK = "选择题", "判断题", "填空题"
TRUE_WORDS, FALSE_WORDS = ("正确", "对", "√", "T", "true"), ("错误", "错", "×", "F", "false")


def validated(questions: DataFrame) -> DataFrame:
    """``row_id, code``: 0 for a record with all required parts, else the first that is missing or wrong.

    3 grade or subject, 4 id, 5 description, 6 stems, 7 answers, 8 solutions, 9 type.
    """
    q = F.col("query")
    code = (
        F.when(F.col("grade").isNull() | F.col("subject").isNull(), 3)
        .when(q["_id"].isNull(), 4)
        .when(q["description"].isNull(), 5)
        .when(q["stems"].isNull() | (F.size(q["stems"]) == 0), 6)
        .when(q["answers"].isNull(), 7)
        .when(q["solutions"].isNull(), 8)
        .when(q["type"].isNull(), 9)
        .otherwise(0)
    )
    return questions.select("row_id", code.alias("code"))


def letters(text: Column) -> Column:
    """Option letters in a short answer, width folded."""
    narrow = F.translate(text, "ＡＢＣＤＥＦ", "ABCDEF")
    return F.regexp_extract_all(narrow, F.lit("([A-F])"), F.lit(1))


def chosen(solution: Column) -> Column:
    """The letter a solution settles on: the last ``选/答案为/Answer/choose X``; empty if none."""
    narrow = F.translate(solution, "ＡＢＣＤＥＦ", "ABCDEF")
    found = F.regexp_extract_all(narrow, F.lit(r"(?:选|答案为|答案是|Answer|choose|answer is)[：: ]*([A-F])"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def choice_matches(questions: DataFrame) -> DataFrame:
    """Choice questions whose answer letters and solution letters differ: ``row_id, answer, solution, kind``.

    ``kind``: ``format`` no letter in the answer, ``count`` different numbers, ``mismatch`` another letter.
    Solutions without a letter are not judged.
    """
    q = F.col("query")
    c = questions.where((q["type"] == CHOICE) & q["answers"].isNotNull() & q["solutions"].isNotNull())
    c = c.select("row_id", F.array_join(letters(q["answers"]), "").alias("answer"), F.array_join(F.transform(q["solutions"], lambda s: chosen(F.coalesce(s, F.lit("")))), "").alias("solution"))
    kind = F.when(F.col("answer") == "", "format").when(F.length("answer") != F.length("solution"), "count").when(F.col("answer") != F.col("solution"), "mismatch")
    return c.where("solution <> ''").withColumn("kind", kind).where("kind is not null")


def judge_conflicts(questions: DataFrame) -> DataFrame:
    """``row_id, truth``: true-or-false answers by their words; ``none`` if neither or both appear."""
    q = F.col("query")
    c = questions.where((q["type"] == JUDGE) & q["answers"].isNotNull())
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: q["answers"].contains(w))
    t, f = has(TRUE_WORDS), has(FALSE_WORDS)
    return c.select("row_id", F.when(t & ~f, "true").when(f & ~t, "false").otherwise("none").alias("truth"))


def type_problems(questions: DataFrame) -> DataFrame:
    """``row_id, problem``: choice without options, or options without choice, or no blank in a blank question."""
    q = F.col("query")
    options = F.exists(F.coalesce(q["stems"], F.array().cast("array<struct<stem:string,options:map<string,string>>>")), lambda s: F.coalesce(F.size(s["options"]), F.lit(0)) > 0)
    options = F.coalesce(options, F.lit(False))
    blank = F.coalesce(q["description"].rlike("_{3,}"), F.lit(False))
    problem = F.when((q["type"] == CHOICE) & ~options, "choice without options").when((q["type"] != CHOICE) & options, "options without choice").when((q["type"] == BLANK) & ~blank, "no blank")
    return questions.select("row_id", problem.alias("problem")).where("problem is not null")


def unlabelled_items(questions: DataFrame) -> DataFrame:
    """``row_id, items, labelled``: solutions of which some but not all carry ``(n)``."""
    s = F.coalesce(F.col("query.solutions"), F.array().cast("array<string>"))
    n = F.size(F.filter(s, lambda x: F.coalesce(x.rlike("^[（(][0-9]+[）)]"), F.lit(False))))
    return questions.select("row_id", F.size(s).alias("items"), n.alias("labelled")).where("labelled > 0 and labelled < items")


def sub_question_buckets(questions: DataFrame) -> DataFrame:
    """``bucket, type, n``: where ``(n)`` labels appear, by question type."""
    q = F.col("query")
    label = "[（(][0-9]+[）)]"
    d = F.coalesce(q["description"].rlike(label), F.lit(False))
    a = F.coalesce(q["answers"].rlike(label), F.lit(False))
    s = F.coalesce(F.exists(q["solutions"], lambda x: F.coalesce(x.rlike(label), F.lit(False))), F.lit(False))
    bucket = F.when(d & a & s, "all").when(d & a, "question and answers").when(d & s, "question and solutions").when(a | s, "answers or solutions only").when(d, "question only").otherwise("none")
    return questions.groupBy(bucket.alias("bucket"), q["type"].alias("type")).agg(F.count("*").alias("n"))


def option_fills(questions: DataFrame) -> DataFrame:
    """Single-stem choice questions with one letter answered: ``row_id, filled``: the option's text in ``【】``."""
    q = F.col("query")
    c = questions.where((q["type"] == CHOICE) & (F.size(q["stems"]) == 1) & q["answers"].rlike("^[A-F]$"))
    option = F.try_element_at(q["stems"][0]["options"], q["answers"])
    return c.select("row_id", F.concat(F.lit("【"), option, F.lit("】")).alias("filled")).where("filled is not null")


def spelling_gate(requests: DataFrame) -> DataFrame:
    """``req_id, pos, sentence``: sentences of spelling requests of more than 10 and less than 100 characters."""
    s = requests.select("req_id", F.posexplode("query").alias("pos", "sentence")).where(F.col("sentence").isNotNull())
    s = s.select("req_id", "pos", F.trim("sentence").alias("sentence"))
    return s.where((F.length("sentence") > 10) & (F.length("sentence") < 100))


def blank_matches(questions: DataFrame) -> DataFrame:
    """Blank questions with answers that no solution contains: ``row_id, values, missing``.

    Values are split at ``; ；`` and line breaks; white space does not count.
    """
    q = F.col("query")
    bare = lambda c: F.regexp_replace(c, "[ \t\n\r]", "")
    c = questions.where((q["type"] == BLANK) & q["answers"].isNotNull() & (F.size(q["solutions"]) > 0))
    c = c.select("row_id", F.filter(F.transform(F.split(q["answers"], "[;；\n]"), bare), lambda v: v != "").alias("v"), bare(F.array_join(q["solutions"], "")).alias("s"))
    n = F.size(F.filter("v", lambda v: ~F.col("s").contains(v)))
    return c.select("row_id", F.size("v").alias("values"), n.alias("missing")).where("missing > 0")


def bracketed_matches(questions: DataFrame) -> DataFrame:
    """``row_id, items, found``: bracketed parts of a description and how many of them a solution repeats."""
    q = F.col("query")
    parts = F.array_distinct(F.regexp_extract_all(q["description"], F.lit("[（(]([^（()）]+)[）)]"), F.lit(1)))
    c = questions.where(q["description"].isNotNull() & (F.size(q["solutions"]) > 0)).select("row_id", parts.alias("p"), F.array_join(q["solutions"], "\n").alias("s")).where(F.size("p") > 0)
    return c.select("row_id", F.size("p").alias("items"), F.size(F.filter("p", lambda x: F.col("s").contains(x))).alias("found"))


def choice_evidence(questions: DataFrame) -> DataFrame:
    """How a solution supports a one-letter answer: ``row_id, evidence``, the first that holds.

    ``named`` the letter is chosen by a closing phrase, ``text`` the option's text appears, ``letter`` the letter
    appears, ``none``.
    """
    q = F.col("query")
    c = questions.where((q["type"] == CHOICE) & q["answers"].rlike("^[A-F]$") & (F.size(q["solutions"]) > 0) & (F.size(q["stems"]) > 0))
    s = F.array_join(q["solutions"], "\n")
    option = F.try_element_at(F.get(q["stems"], F.lit(0))["options"], q["answers"])
    c = c.select("row_id", q["answers"].alias("a"), s.alias("s"), option.alias("o"))
    found = F.when(chosen(F.col("s")) == F.col("a"), "named").when(F.col("o").isNotNull() & F.col("s").contains(F.col("o")), "text").when(F.col("s").contains(F.col("a")), "letter").otherwise("none")
    return c.select("row_id", found.alias("evidence"))


def canonical_answers(answers: Column) -> Column:
    """Answers in whatever shape as ``ARRAY<ARRAY<STRING>>``: a text, the text of a list, or of a list of lists."""
    v = F.when(F.trim(answers).startswith("["), F.try_parse_json(answers))
    items = F.try_variant_get(v, "$", "array<variant>")
    inner = F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), F.array(F.try_variant_get(x, "$", "string"))))
    return F.when(answers.isNotNull(), F.coalesce(inner, F.array(F.array(answers))))


def checker_of(subject: Column) -> Column:
    """The checker and spelling model a record goes to."""
    return F.when(subject.isNull(), "none").when(subject == "english", "english").when(subject.isin("history", "politics", "chinese"), "chinese, humanities").when(subject == "biology", "chinese, biology").when(subject.isin("physics", "math", "chemistry"), "chinese, sciences").otherwise("chinese, no spelling")
