"""Queries of vocabularies, metrics, similarity, edits, records and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexassay.functions import dims, latex
from lexassay.functions.lineage import broadcast_if_small
from lexassay.operators import cleaning, corpus, dictionary, edits, records, rules, scorers, similarity, tokenizing
from lexassay.operators.sections import question_sections
from lexassay.sources.tables import table

from . import text_queries
from .registry import query

TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[一-鿿]'), lambda x: lower(x))"
ROWS = f"""l AS (SELECT doc_id, {TOKENS} AS t FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, (i - 1) AS pos, t[i] AS token FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM l))"""
ITEM_ROWS = f"""il AS (SELECT item_id, {TOKENS} AS t FROM eval_items WHERE text IS NOT NULL),
ir AS (SELECT item_id, t[i] AS token FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM il))"""


def _rows(spark, folder) -> DataFrame:
    return corpus.token_rows(table(spark, folder, "documents").where(F.col("text").isNotNull()), "doc_id", cleaning.tokens(F.col("text")))


def _tokens(spark, folder) -> DataFrame:
    """Documents with their token arrays."""
    return table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", cleaning.tokens(F.col("text")).alias("t"))


def _item_rows(spark, folder) -> DataFrame:
    return corpus.token_rows(table(spark, folder, "eval_items").where(F.col("text").isNotNull()), "item_id", cleaning.tokens(F.col("text")))


_VOCAB = f"""WITH {ROWS}, c AS (SELECT token AS symbol, count(*) AS n FROM r GROUP BY token HAVING count(*) >= 2),
k AS (SELECT row_number() OVER (ORDER BY n DESC, symbol) + 2 AS idx, symbol, n FROM c)"""


@query(_VOCAB + """, f AS (SELECT (SELECT count(*) FROM k) AS c)
SELECT * FROM (VALUES (0, '<pad>', 0), (1, '</s>', 0), (2, '<unk>', 0)) v(idx, symbol, n) UNION ALL SELECT * FROM k
UNION ALL SELECT c + 3 + i, 'madeupword' || lpad(i::VARCHAR, 4, '0'), 0 FROM (SELECT c, unnest(range(0, (8 - (c + 3) % 8) % 8)) AS i FROM f)""")
def vocab_build(spark, folder):
    return corpus.vocabulary(_rows(spark, folder), threshold=2)


@query(f"WITH {ROWS}, {ITEM_ROWS} SELECT DISTINCT token FROM r INTERSECT SELECT DISTINCT token FROM ir")
def vocab_intersect(spark, folder):
    return _rows(spark, folder).select("token").distinct().join(_item_rows(spark, folder).select("token").distinct(), "token", "left_semi")


@query(f"WITH {ROWS}, {ITEM_ROWS} SELECT DISTINCT token FROM r EXCEPT SELECT DISTINCT token FROM ir")
def vocab_except(spark, folder):
    return _rows(spark, folder).select("token").distinct().join(_item_rows(spark, folder).select("token").distinct(), "token", "left_anti")


@query(f"WITH {ROWS}, {ITEM_ROWS} SELECT token FROM r UNION SELECT token FROM ir")
def vocab_union(spark, folder):
    return _rows(spark, folder).select("token").distinct().union(_item_rows(spark, folder).select("token").distinct()).distinct()


@query(_VOCAB + """, e AS (SELECT doc_id, list(coalesce(idx, 2) ORDER BY pos) AS ids FROM r LEFT JOIN k ON r.token = k.symbol GROUP BY doc_id)
SELECT doc_id, len(ids) + 1 AS n, md5(array_to_string(list_append(ids, 1), ',')) AS digest FROM e""")
def encode_lines(spark, folder):
    ids = corpus.encoded(_tokens(spark, folder).where(F.size("t") > 0), "doc_id", "t", corpus.vocabulary(_rows(spark, folder), threshold=2))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("digest"))


@query(f"""WITH {ROWS}, c AS (SELECT token, count(*) AS n FROM r GROUP BY token), stop AS (SELECT token FROM c ORDER BY n DESC, token LIMIT 50)
SELECT doc_id, count(*) AS n FROM r WHERE token NOT IN (SELECT token FROM stop) GROUP BY doc_id""")
def stopword_anti(spark, folder):
    rows = _rows(spark, folder)
    stop = rows.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(50).select("token")
    return rows.join(F.broadcast(stop), "token", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))  # 50 rows


@query(f"""WITH {ROWS}, g AS (SELECT doc_id, t[i] || ' ' || t[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(t))) AS i FROM l)), ig AS (SELECT DISTINCT t[i] || ' ' || t[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(t))) AS i FROM (SELECT {TOKENS} AS t FROM eval_items)))
SELECT doc_id, count(*) AS shared FROM (SELECT DISTINCT doc_id, gram FROM g) JOIN ig USING (gram) GROUP BY doc_id""")
def ngram_overlap(spark, folder):
    d = _tokens(spark, folder).where(F.size("t") > 1)
    i = table(spark, folder, "eval_items").where(F.col("text").isNotNull()).select(cleaning.tokens(F.col("text")).alias("t")).where(F.size("t") > 1)
    # the items' n-grams are broadcast while few: then a document's are filtered and counted where they are
    known = broadcast_if_small(i.select(F.explode(corpus.ngrams(F.col("t"), 2)).alias("gram")).distinct(), 1_000_000)
    grams = d.select("doc_id", F.explode(F.array_distinct(corpus.ngrams(F.col("t"), 2))).alias("gram"))
    return grams.join(known, "gram", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


def _bleu_sql() -> str:
    tok = "list_transform(regexp_extract_all({}, '[A-Za-z]+|[0-9]+|[一-鿿]'), lambda x: lower(x))"
    parts = []
    for k in range(1, 5):
        for t in "rh":
            parts.append(f"g{t}{k} AS (SELECT row_id, array_to_string({t}[i:i + {k - 1}], chr(1)) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, len({t}) - {k - 1} + 1)) AS i FROM p WHERE len({t}) >= {k}) GROUP BY ALL)")
        parts.append(f"s{k} AS (SELECT (SELECT coalesce(sum(least(a.c, b.c)), 0)::BIGINT FROM gh{k} a JOIN gr{k} b USING (row_id, g)) AS m{k}, (SELECT sum(c)::BIGINT FROM gh{k}) AS c{k})")
    logs = " + ".join(f"ln(m{k} / c{k})" for k in range(1, 5))
    return f"""WITH p AS (SELECT row_id, {tok.format("query.solutions[1]")} AS r, {tok.format("query.description")} AS h FROM questions WHERE query.description IS NOT NULL AND query.solutions[1] IS NOT NULL),
{", ".join(parts)}, n AS (SELECT sum(len(r))::BIGINT AS r, sum(len(h))::BIGINT AS h FROM p), s AS (SELECT * FROM n, s1, s2, s3, s4)
SELECT *, round(CASE WHEN m1 = 0 OR m2 = 0 OR m3 = 0 OR m4 = 0 THEN 0.0 ELSE 100 * least(1.0, exp(1 - r / h)) * exp(({logs}) / 4) END, 6) AS score FROM s"""


@query(_bleu_sql())
def bleu4(spark, folder):
    q = F.col("query")
    t = table(spark, folder, "questions").select(F.get(q["solutions"], F.lit(0)).alias("s"), q["description"].alias("d")).where("s is not null and d is not null")
    p = t.select(cleaning.tokens(F.col("s")).alias("ref"), cleaning.tokens(F.col("d")).alias("hyp"))
    return corpus.bleu(p, F.col("ref"), F.col("hyp"))


# A tag sequence for every document: figures are MISC, capitalised Latin words PER.
_TAGS = """t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[一-鿿]') AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i - 1 AS pos, t[i] AS w FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM t)),
g AS (SELECT doc_id, pos, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'I-MISC' WHEN regexp_matches(w, '^[A-Z][a-z]+$') THEN 'I-PER' ELSE 'O' END AS tag,
  CASE WHEN regexp_matches(w, '^[0-9]{2,}$') THEN 'B-MISC' WHEN regexp_matches(w, '^[A-Z][a-z]{3,}$') THEN 'I-PER' ELSE 'O' END AS hyp FROM w)"""


def _chunk_sql(col: str) -> str:
    return f"""(SELECT doc_id, kind, min(pos) AS start_at, max(pos) + 1 AS end_at FROM (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM
 (SELECT *, CASE WHEN starts_with(tag, 'B-') OR (kind IS NOT NULL AND kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY pos)) THEN 1 ELSE 0 END AS nw FROM
  (SELECT doc_id, pos, {col} AS tag, CASE WHEN {col} <> 'O' THEN string_split({col}, '-')[2] END AS kind FROM g))) WHERE kind IS NOT NULL GROUP BY doc_id, run, kind)"""


def _tags(spark, folder) -> DataFrame:
    """Documents with two arrays of tags."""
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+|[0-9]+|[一-鿿])"), F.lit(1))
    gold = F.transform("w", lambda w: F.when(w.rlike("^[0-9]+$"), "I-MISC").when(w.rlike("^[A-Z][a-z]+$"), "I-PER").otherwise("O"))
    hyp = F.transform("w", lambda w: F.when(w.rlike("^[0-9]{2,}$"), "B-MISC").when(w.rlike("^[A-Z][a-z]{3,}$"), "I-PER").otherwise("O"))
    return table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", w.alias("w")).select("doc_id", gold.alias("tag"), hyp.alias("hyp"))


@query(f"""WITH {_TAGS}, a AS {_chunk_sql("tag")}, b AS {_chunk_sql("hyp")},
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS correct, (SELECT count(*) FROM a) AS gold, (SELECT count(*) FROM b) AS predicted)
SELECT correct, gold, predicted, round(correct / predicted, 6) AS precision, round(correct / gold, 6) AS recall, round(2 * (correct / predicted) * (correct / gold) / (correct / predicted + correct / gold), 6) AS f1 FROM c""")
def chunk_f1(spark, folder):
    return corpus.chunk_scores(F.col("tag"), F.col("hyp"), _tags(spark, folder))


@query(f"WITH {_TAGS} SELECT count(*) AS tokens, round(avg((tag = hyp)::INT), 6) AS accuracy FROM g")
def token_accuracy(spark, folder):
    equal = F.size(F.filter(F.arrays_zip("tag", "hyp"), lambda z: z["tag"] == z["hyp"]))
    s = _tags(spark, folder).agg(F.sum(F.size("tag")).alias("tokens"), F.sum(equal).alias("equal"))
    return s.select("tokens", F.round(F.col("equal") / F.col("tokens"), 6).alias("accuracy"))


@query(f"""WITH {ROWS}, {ITEM_ROWS}, w AS (SELECT DISTINCT token AS word FROM r WHERE regexp_matches(token, '^[a-z]+$')), v AS (SELECT DISTINCT token AS word FROM ir WHERE regexp_matches(token, '^[a-z]+$'))
SELECT word, CASE WHEN word IN (SELECT word FROM v) THEN 'word'
  WHEN list_has_any((SELECT list(word) FROM v), list_transform(list_filter(['un', 're', 'non', 'dis', 'mis', 'over', 'under', 'anti', 'multi'], lambda p: starts_with(word, p) AND length(word) > length(p) + 2), lambda p: substr(word, length(p) + 1))) THEN 'prefix'
  WHEN list_has_any((SELECT list(word) FROM v), list_transform(list_filter(['ness', 'less', 'ful', 'ly', 'ing', 'ed', 's'], lambda s: ends_with(word, s) AND length(word) > length(s) + 2), lambda s: substr(word, 1, length(word) - length(s)))) THEN 'suffix'
  ELSE 'none' END AS accepted_by FROM w""")
def dict_cascade(spark, folder):
    latin = F.col("token").rlike("^[a-z]+$")
    words = _rows(spark, folder).where(latin).select(F.col("token").alias("word")).distinct()
    return dictionary.cascade(words, _item_rows(spark, folder).where(latin).select(F.col("token").alias("word")).distinct())


@query(f"""WITH {ROWS}, {ITEM_ROWS}, v AS (SELECT DISTINCT token AS s FROM ir WHERE regexp_matches(token, '^[a-z]+$')), w AS (SELECT DISTINCT token AS word FROM r WHERE regexp_matches(token, '^[a-z]+$') AND token NOT IN (SELECT s FROM v)),
d AS (SELECT word, s, levenshtein(word, s) AS d FROM w, v WHERE abs(length(word) - length(s)) <= 2)
SELECT word, s AS suggestion, d::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, s) AS n FROM d WHERE d <= 2) WHERE n = 1""")
def spell_suggest_top1(spark, folder):
    latin = F.col("token").rlike("^[a-z]+$")
    v = _item_rows(spark, folder).where(latin).select(F.col("token").alias("word")).distinct()
    w = _rows(spark, folder).where(latin).select(F.col("token").alias("word")).distinct().join(v, "word", "left_anti")
    return dictionary.suggestions(w, v, 2)


@query(f"""WITH {ROWS}, {ITEM_ROWS}, v AS (SELECT DISTINCT token AS s FROM ir WHERE regexp_matches(token, '^[a-z]+$')), w AS (SELECT DISTINCT token AS word FROM r WHERE regexp_matches(token, '^[a-z]+$') AND token NOT IN (SELECT s FROM v)),
d AS (SELECT word, s, levenshtein(word, s) AS d FROM w, v WHERE abs(length(word) - length(s)) <= 3)
SELECT word, s AS suggestion, d::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, s) AS n FROM d WHERE d <= 3) WHERE n = 1""")
def spell_suggest_within3(spark, folder):
    latin = F.col("token").rlike("^[a-z]+$")
    v = _item_rows(spark, folder).where(latin).select(F.col("token").alias("word")).distinct()
    w = _rows(spark, folder).where(latin).select(F.col("token").alias("word")).distinct().join(v, "word", "left_anti")
    return dictionary.suggestions(w, v)


def _candidate_texts(spark, folder) -> DataFrame:
    return table(spark, folder, "questions").select("row_id", F.col("query._id").alias("_id"), F.col("query.description").alias("text"))


def _described(spark, folder) -> DataFrame:
    return table(spark, folder, "questions").select("row_id", F.col("query.description").alias("text")).where("text is not null")


# DuckDB measures distances in bytes: tested against brute force instead.
@query()
def near_dup_pairs(spark, folder):
    return similarity.similar_candidates(_candidate_texts(spark, folder), "_id", "row_id", "text")


@query("SELECT row_id, min(row_id) OVER (PARTITION BY query.description) AS class_id FROM questions WHERE query.description IS NOT NULL")
def near_dup_members(spark, folder):
    return similarity.near_members(_described(spark, folder), "row_id", "text")


# Shapes and sounds of a few characters, given with the query.
_META = [("你", ["人尔"], ["ni3"]), ("尼", ["尸匕"], ["ni2"]), ("好", ["女子"], ["hao3", "hao4"]), ("号", ["口丂"], ["hao4", "hao2"]), ("末", ["木一"], ["mo4"]), ("未", ["木一"], ["wei4"])]
_META_SQL = ", ".join(f"('{c}', {s}, {p})" for c, s, p in _META)


@query(f"""WITH m(ch, shapes, sounds) AS (VALUES {_META_SQL}), p AS (SELECT a.ch AS a, b.ch AS b, a.shapes AS sa, b.shapes AS sb, a.sounds AS pa, b.sounds AS pb FROM m a JOIN m b ON a.ch < b.ch)
SELECT a, b, round(greatest((SELECT max(1 - levenshtein(x, y) / greatest(length(x), length(y))) FROM (SELECT unnest(sa) AS x) CROSS JOIN (SELECT unnest(sb) AS y)), (SELECT max(1 - levenshtein(x, y) / greatest(length(x), length(y))) FROM (SELECT unnest(pa) AS x) CROSS JOIN (SELECT unnest(pb) AS y))), 6) AS similarity FROM p""")
def char_similarity(spark, folder):
    m = spark.createDataFrame(_META, "ch string, shapes array<string>, sounds array<string>")
    pairs = m.select(F.col("ch").alias("a")).join(m.select(F.col("ch").alias("b")), F.col("a") < F.col("b"))
    return similarity.character_similarity(pairs, m)


@query("SELECT source, lang, subject, count(*) AS n FROM documents GROUP BY ALL")
def type_counts(spark, folder):
    return table(spark, folder, "documents").groupBy("source", "lang", "subject").agg(F.count("*").alias("n"))


_LABEL = "[（(][0-9]+[）)]"


@query(f"""WITH x AS (SELECT query.type AS type, coalesce(regexp_matches(query.description, '{_LABEL}'), false) AS d, coalesce(regexp_matches(query.answers, '{_LABEL}'), false) AS a, coalesce(len(list_filter(query.solutions, lambda e: coalesce(regexp_matches(e, '{_LABEL}'), false))) > 0, false) AS s FROM questions)
SELECT CASE WHEN d AND a AND s THEN 'all' WHEN d AND a THEN 'question and answers' WHEN d AND s THEN 'question and solutions' WHEN a OR s THEN 'answers or solutions only' WHEN d THEN 'question only' ELSE 'none' END AS bucket, type, count(*) AS n FROM x GROUP BY ALL""")
def five_bucket_case(spark, folder):
    return records.sub_question_buckets(table(spark, folder, "questions"))


@query("""SELECT row_id, CASE WHEN grade IS NULL OR subject IS NULL THEN 3 WHEN query._id IS NULL THEN 4 WHEN query.description IS NULL THEN 5 WHEN query.stems IS NULL OR len(query.stems) = 0 THEN 6 WHEN query.answers IS NULL THEN 7 WHEN query.solutions IS NULL THEN 8 WHEN query.type IS NULL THEN 9 ELSE 0 END AS code FROM questions""")
def validate_record(spark, folder):
    return records.validated(table(spark, folder, "questions"))


@query("""WITH c AS (SELECT row_id, array_to_string(regexp_extract_all(translate(query.answers, 'ＡＢＣＤＥＦ', 'ABCDEF'), '[A-F]'), '') AS answer,
  array_to_string(list_transform(query.solutions, lambda s: coalesce(regexp_extract_all(translate(coalesce(s, ''), 'ＡＢＣＤＥＦ', 'ABCDEF'), '(?:选|答案为|答案是|Answer|choose|answer is)[：: ]*([A-F])', 1)[-1], '')), '') AS solution
  FROM questions WHERE query.type = '选择题' AND query.answers IS NOT NULL AND query.solutions IS NOT NULL)
SELECT * FROM (SELECT *, CASE WHEN answer = '' THEN 'format' WHEN length(answer) <> length(solution) THEN 'count' WHEN answer <> solution THEN 'mismatch' END AS kind FROM c WHERE solution <> '') WHERE kind IS NOT NULL""")
def answer_match_choice(spark, folder):
    return records.choice_matches(table(spark, folder, "questions"))


@query("""WITH c AS (SELECT row_id, query.answers AS a FROM questions WHERE query.type = '判断题' AND query.answers IS NOT NULL),
x AS (SELECT row_id, len(list_filter(['正确', '对', '√', 'T', 'true'], lambda w: contains(a, w))) > 0 AS t, len(list_filter(['错误', '错', '×', 'F', 'false'], lambda w: contains(a, w))) > 0 AS f FROM c)
SELECT row_id, CASE WHEN t AND NOT f THEN 'true' WHEN f AND NOT t THEN 'false' ELSE 'none' END AS truth FROM x""")
def judge_match(spark, folder):
    return records.judge_conflicts(table(spark, folder, "questions"))


@query("""WITH x AS (SELECT row_id, query.type AS t, coalesce(len(list_filter(query.stems, lambda s: coalesce(cardinality(s.options), 0) > 0)) > 0, false) AS o, coalesce(regexp_matches(query.description, '_{3,}'), false) AS b FROM questions)
SELECT * FROM (SELECT row_id, CASE WHEN t = '选择题' AND NOT o THEN 'choice without options' WHEN t <> '选择题' AND o THEN 'options without choice' WHEN t = '填空题' AND NOT b THEN 'no blank' END AS problem FROM x) WHERE problem IS NOT NULL""")
def type_check(spark, folder):
    return records.type_problems(table(spark, folder, "questions"))


@query("""SELECT * FROM (SELECT row_id, coalesce(len(query.solutions), 0)::INT AS items, coalesce(len(list_filter(query.solutions, lambda x: coalesce(regexp_matches(x, '^[（(][0-9]+[）)]'), false))), 0)::INT AS labelled FROM questions) WHERE labelled > 0 AND labelled < items""")
def serial_check(spark, folder):
    return records.unlabelled_items(table(spark, folder, "questions"))


@query("""SELECT row_id, '【' || query.stems[1].options[query.answers] || '】' AS filled FROM questions WHERE query.type = '选择题' AND len(query.stems) = 1 AND regexp_matches(query.answers, '^[A-F]$') AND query.stems[1].options[query.answers] IS NOT NULL""")
def option_fill(spark, folder):
    return records.option_fills(table(spark, folder, "questions"))


@query("""WITH s AS (SELECT req_id, (i - 1)::INT AS pos, trim(query[i], ' ') AS sentence FROM (SELECT *, unnest(range(1, coalesce(len(query), 0) + 1)) AS i FROM spell_requests))
SELECT * FROM s WHERE length(sentence) > 10 AND length(sentence) < 100""")
def spelling_gate(spark, folder):
    return records.spelling_gate(table(spark, folder, "spell_requests"))


def _candidates_sql() -> str:
    return f"""WITH {ROWS}, c AS (SELECT doc_id, pos, token, ((doc_id * 31 + pos * 17) % 101) / 100.0 AS confidence FROM r WHERE regexp_matches(token, '^[0-9]+$'))"""


def _candidates(spark, folder) -> DataFrame:
    r = _rows(spark, folder).where(F.col("token").rlike("^[0-9]+$"))
    return r.withColumn("confidence", F.pmod(F.col("doc_id") * 31 + F.col("pos") * 17, F.lit(101)) / 100.0)


@query(_candidates_sql() + ", g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c) SELECT doc_id, pos::INT AS pos, token, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY confidence DESC, pos) AS n FROM g) WHERE n = 1")
def ngram_bias(spark, folder):
    return scorers.without_neighbours(_candidates(spark, folder), "doc_id").select("doc_id", "pos", "token", F.round("confidence", 6).alias("confidence"))


@query(_candidates_sql() + " SELECT doc_id, pos::INT AS pos, token, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, pos) AS n FROM c) WHERE n = 1")
def candidate_argmax(spark, folder):
    return scorers.best_candidates(_candidates(spark, folder), ["doc_id"], F.col("confidence"), ["pos"]).select("doc_id", "pos", "token", F.round("confidence", 6).alias("confidence"))


@query(_candidates_sql() + " SELECT doc_id, count(*) AS n FROM c WHERE 20.0 / 3 * confidence + 0.5 - 21.2 / 3 > 0 OR 0.2 * confidence + 0.5 - 0.7 > 0 GROUP BY doc_id")
def curve_filter(spark, folder):
    return _candidates(spark, folder).where(scorers.curve(F.col("confidence"), F.lit(0.5))).groupBy("doc_id").agg(F.count("*").alias("n"))


# Sentence pairs for edits: each English evaluation item and its text with every third word changed.
_PAIR = "SELECT item_id, string_split(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'), ' '), ' ') AS a FROM eval_items WHERE lang = 'en' AND text IS NOT NULL"


def _pairs(spark, folder) -> DataFrame:
    t = table(spark, folder, "eval_items").where("lang = 'en' and text is not null").select("item_id", F.split(F.trim(F.regexp_replace("text", "[ \t\n]+", " ")), " ").alias("a"))
    return t.withColumn("b", F.filter(F.transform("a", lambda w, i: F.when(i % 11 == 3, F.lit("")).when(i % 7 == 2, F.concat(w, F.lit("x"))).otherwise(w)), lambda w: w != ""))


@query(f"""WITH p AS ({_PAIR}) SELECT item_id, md5(array_to_string(list_filter(list_transform(a, lambda w, i: CASE WHEN (i - 1) % 11 = 3 THEN '' WHEN (i - 1) % 7 = 2 THEN w || 'x' ELSE w END), lambda w: w <> ''), ' ')) AS digest FROM p""")
def m2_apply(spark, folder):
    """Edits between source and target, applied to the source, must give the target."""
    p = _pairs(spark, folder).withColumn("e", edits.token_edits("a", "b"))
    return p.select("item_id", F.md5(F.array_join(edits.applied(F.col("a"), F.col("e")), " ")).alias("digest"))


# The edits of these pairs in SQL: maximal runs of changed words.
_EDITS = f"""p AS ({_PAIR}), w AS (SELECT item_id, a, i - 1 AS z, a[i] AS x, CASE WHEN (i - 1) % 11 = 3 THEN '' WHEN (i - 1) % 7 = 2 THEN a[i] || 'x' END AS y FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM p)),
c AS (SELECT *, z - row_number() OVER (PARTITION BY item_id ORDER BY z) AS run FROM w WHERE y IS NOT NULL),
g AS (SELECT item_id, any_value(a) AS a, min(z)::INT AS start, (max(z) + 1)::INT AS stop, string_agg(x, ' ' ORDER BY z) AS old, coalesce(string_agg(nullif(y, ''), ' ' ORDER BY z), '') AS cor FROM c GROUP BY item_id, run),
e AS (SELECT item_id, a, start, stop, cor, CASE WHEN cor = '' THEN CASE WHEN regexp_matches(old, '^[^\\p{{L}}\\p{{N}}]+$') THEN 'U:PUNCT' ELSE 'U:OTHER' END WHEN stop = start + 1 AND regexp_matches(old, '^\\p{{L}}+$') THEN 'R:SPELL' ELSE 'R:OTHER' END AS type, old FROM g),
n AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY start) - 1)::INT AS n FROM e)"""


def _edit_rows(spark, folder) -> DataFrame:
    return _pairs(spark, folder).withColumn("e", edits.token_edits("a", "b"))


@query(f'WITH {_EDITS} SELECT item_id, n, start, stop AS "end", type, cor FROM n')
def token_align(spark, folder):
    return _edit_rows(spark, folder).select("item_id", F.posexplode("e").alias("n", "e")).select("item_id", "n", "e.*")


@query(f'WITH {_EDITS} SELECT item_id, len(a)::INT AS tokens, n, start, stop AS "end", type, cor, 0 AS coder FROM n')
def m2_parse(spark, folder):
    m = _edit_rows(spark, folder).select("item_id", edits.parsed_m2(edits.m2_text(F.col("a"), F.col("e"))).alias("m"))
    return m.select("item_id", F.size("m.tokens").alias("tokens"), F.posexplode("m.edits").alias("n", "e")).select("item_id", "tokens", "n", "e.*")


@query(f"""WITH {_EDITS} SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY start) - 1)::INT AS n, start, stop AS "end", type, cor FROM e WHERE type <> 'R:SPELL'""")
def m2_filter(spark, folder):
    e = _edit_rows(spark, folder).select("item_id", F.filter("e", lambda x: x["type"] != "R:SPELL").alias("e"))
    return e.select("item_id", F.posexplode("e").alias("n", "e")).select("item_id", "n", "e.*")


@query(f"""WITH {_EDITS} SELECT item_id, n, (length(array_to_string(a[1:start], ' ')) + (start > 0)::INT)::INT AS start_at, (length(array_to_string(a[1:start], ' ')) + (start > 0)::INT + length(old))::INT AS end_at, type, cor FROM n""")
def edit_positions(spark, folder):
    return _edit_rows(spark, folder).select("item_id", F.posexplode(edits.character_spans(F.col("a"), F.col("e"))).alias("n", "s")).select("item_id", "n", "s.*")


@query("""WITH e AS (SELECT doc_id, least(length(text) % 6, 4) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n::INT AS n, unnest(range(0, (2 ** n)::BIGINT))::INT AS mask FROM e WHERE n > 0""")
def edit_powerset(spark, folder):
    d = table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", F.least(F.length("text") % 6, F.lit(4)).alias("n"))
    marks = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i))
    return d.select("doc_id", "n", F.explode(edits.subsets(marks)).alias("mask"))


_U = "((({0} * 1103515245 + 12345) % 2147483648))"


def _uniform_sql(*keys: str) -> str:
    x = "42::BIGINT"
    for k in keys:
        x = _U.format(f"(({x} + {k}) % 2147483648)")
    return _U.format(x) + " / 2147483648.0"


@query(f"WITH {ROWS} SELECT doc_id, count(*) AS n, sum(pos)::BIGINT AS places FROM r WHERE pos = 0 OR {_uniform_sql('doc_id', 'pos')} >= 0.1 GROUP BY doc_id")
def word_dropout(spark, folder):
    return corpus.dropped_words(_rows(spark, folder), "doc_id", 0.1).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query(f"WITH {ROWS}, s AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN pos = 0 THEN -1.0 ELSE pos + 3 * ({_uniform_sql('doc_id', 'pos')}) END, pos) - 1 AS new_pos FROM r) SELECT doc_id, sum(abs(new_pos - pos))::BIGINT AS moved, sum(new_pos * pos)::BIGINT AS product FROM s GROUP BY doc_id")
def local_shuffle(spark, folder):
    s = _tokens(spark, folder).where(F.size("t") > 0).select("doc_id", corpus.shuffled_words(F.col("doc_id"), F.col("t"), 3).alias("s"))
    total = lambda f: F.aggregate(F.transform("s", f), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("doc_id", total(lambda x, i: F.abs(i - x["pos"]).cast("long")).alias("moved"), total(lambda x, i: i.cast("long") * x["pos"]).alias("product"))


@query(_VOCAB + f""", m AS (SELECT doc_id, pos::INT AS pos, token, v, CASE WHEN v >= 0.9 THEN floor(w * (SELECT count(*) FROM k))::BIGINT + 3 END AS j FROM (SELECT *, {_uniform_sql('doc_id', 'pos')} AS u, {_uniform_sql('pos', '(doc_id + 7)')} AS v, {_uniform_sql('(doc_id + 3)', 'pos')} AS w FROM r) WHERE u < 0.15)
SELECT doc_id, pos, token AS label, CASE WHEN v < 0.8 THEN '[MASK]' WHEN v < 0.9 THEN token ELSE k.symbol END AS shown FROM m LEFT JOIN k ON k.idx = m.j""")
def masked_tokens(spark, folder):
    rows = _rows(spark, folder)
    vocab = corpus.vocabulary(rows, threshold=2, multiple=1).where(F.col("n") > 0)
    return corpus.masked_tokens(rows, "doc_id", vocab)


@query("SELECT (doc_id % 7)::INT AS shard, count(*) AS n, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY ALL")
def shard_every_k(spark, folder):
    return corpus.shards(table(spark, folder, "documents"), "doc_id", 7).groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_chars").alias("characters"))


@query("SELECT d.source, count(*) AS n, count(DISTINCT doc_id) AS documents FROM documents d JOIN mix_targets m USING (source), range(m.max_repeats) GROUP BY d.source")
def concat_upsample(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source").join(F.broadcast(table(spark, folder, "mix_targets").select("source", "max_repeats")), "source")  # fixed table of 9 rows
    return corpus.upsampled(d, F.col("max_repeats")).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query("SELECT d.doc_id, e.item_id FROM documents d JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM eval_items) e ON d.doc_id % e.n = e.k")
def round_robin_zip(spark, folder):
    e = table(spark, folder, "eval_items")
    n = e.agg(F.count("*").alias("n"))
    k = corpus.ranks(e.select("item_id"), [F.col("item_id")])
    d = table(spark, folder, "documents").select("doc_id").crossJoin(F.broadcast(n))  # one row
    return d.withColumn("rank", F.pmod("doc_id", "n")).join(k, "rank").select("doc_id", "item_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY coalesce(length(text), 0), doc_id) - 1) AS place, coalesce(length(text), 0)::INT AS size FROM documents")
def length_sorted(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return corpus.ranks(d, [F.col("size"), F.col("doc_id")]).select("doc_id", F.col("rank").alias("place"), "size")


@query("SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // 64) AS batch, doc_id FROM documents")
def batch_by_count(spark, folder):
    r = corpus.ranks(table(spark, folder, "documents").select("doc_id"), [F.col("doc_id")])
    return r.select(F.floor(F.col("rank") / 64).alias("batch"), "doc_id")


@query()
def length_batches(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return corpus.batches_by_size(d, "doc_id", "size", 4096, 16)


@query(f"WITH {ROWS}, s AS (SELECT doc_id, pos, token, coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY pos), '</s>') AS src FROM r) SELECT doc_id, (pos // 64)::BIGINT AS block_no, string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(src, ' ' ORDER BY pos) AS sources FROM s GROUP BY ALL")
def token_blocks(spark, folder):
    return _tokens(spark, folder).select("doc_id", F.explode(corpus.blocks(F.col("t"), 64)).alias("b")).select("doc_id", "b.*")


_CONFUSION = """w AS (SELECT q1.description AS a, q2.description AS b FROM (SELECT row_id, query.description, query._id FROM questions) q1 JOIN (SELECT row_id, query.description, query._id FROM questions) q2 ON q1._id = q2._id AND q1.row_id < q2.row_id AND length(q1.description) = length(q2.description) AND q1.description <> q2.description),
c AS (SELECT substr(a, i, 1) AS wrong, substr(b, i, 1) AS correct FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM w))"""


def _confusions(spark, folder) -> DataFrame:
    q = table(spark, folder, "questions").select("row_id", F.col("query._id").alias("_id"), F.col("query.description").alias("t")).where("_id is not null and t is not null")
    a, b = q.alias("a"), q.alias("b")
    # the length is a key of the join: texts of one id spread over their lengths
    j = a.join(b, (F.col("a._id") == F.col("b._id")) & (F.length("a.t") == F.length("b.t")) & (F.col("a.row_id") < F.col("b.row_id")) & (F.col("a.t") != F.col("b.t")))
    z = F.arrays_zip(F.split("a.t", "").alias("wrong"), F.split("b.t", "").alias("correct"))
    return j.select(F.explode(z).alias("z")).select("z.wrong", "z.correct")


@query(f"WITH {_CONFUSION} SELECT wrong, correct, count(*) AS n FROM c WHERE wrong <> correct GROUP BY ALL")
def confusion_pairs(spark, folder):
    return _confusions(spark, folder).where("wrong <> correct").groupBy("wrong", "correct").agg(F.count("*").alias("n"))


@query(f"""WITH {_CONFUSION}, t AS (SELECT wrong, max(n) AS top FROM (SELECT wrong, correct, count(*) AS n FROM c WHERE wrong <> correct GROUP BY ALL) GROUP BY wrong), k AS (SELECT correct AS wrong, count(*) AS right_n FROM c WHERE wrong = correct GROUP BY correct)
SELECT wrong, top, round(CASE WHEN right_n IS NULL THEN 1.0 ELSE least(top / right_n, 1.0) END, 6) AS p FROM t LEFT JOIN k USING (wrong)""")
def mask_probability(spark, folder):
    c = _confusions(spark, folder)
    top = c.where("wrong <> correct").groupBy("wrong", "correct").agg(F.count("*").alias("n")).groupBy("wrong").agg(F.max("n").alias("top"))
    right = c.where("wrong = correct").groupBy(F.col("correct").alias("wrong")).agg(F.count("*").alias("right_n"))
    return top.join(right, "wrong", "left").select("wrong", "top", F.round(F.coalesce(F.least(F.col("top") / F.col("right_n"), F.lit(1.0)), F.lit(1.0)), 6).alias("p"))


_TRAD = {"爲": "为", "學": "学", "國": "国", "開": "开", "關": "关", "認": "认", "標": "标", "東": "东", "數": "数", "線": "线", "變": "变", "電": "电", "氣": "气", "與": "与", "則": "则", "記": "记", "寫": "写", "對": "对", "導": "导", "結": "结"}


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[{''.join(_TRAD)}]'))::INT AS n, md5(translate(text, '{''.join(_TRAD)}', '{''.join(_TRAD.values())}')) AS digest FROM documents WHERE regexp_matches(text, '[{''.join(_TRAD)}]')")
def trad_simp(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").where(t.rlike(f"[{''.join(_TRAD)}]")).select("doc_id", F.size(F.regexp_extract_all(t, F.lit(f"([{''.join(_TRAD)}])"), F.lit(1))).alias("n"), F.md5(dictionary.converted(t, _TRAD)).alias("digest"))


@query(f"WITH {ROWS} SELECT DISTINCT token FROM r WHERE regexp_full_match(token, '(?:{'|'.join(sorted(dims.pinyin_syllables(), key=len, reverse=True))})+')")
def pinyin_words(spark, folder):
    w = _rows(spark, folder).where(F.col("token").rlike("^[a-z]+$")).select("token").distinct()
    return w.where(dictionary.is_pinyin(F.col("token")))


@query()
def essay_overlap(spark, folder):
    q = F.col("query")
    t = table(spark, folder, "questions").select("row_id", q["answers"].alias("a"), F.array_join(q["solutions"], "\n").alias("s")).where("length(a) > 30 and s is not null")
    return t.select("row_id", similarity.common_substring("a", "s").alias("longest"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_usage_window(spark, folder):
    return table(spark, folder, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, count(*) AS events, sum(changed)::BIGINT AS changes FROM (SELECT user_id, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS changed FROM events) GROUP BY user_id")
def change_detection(spark, folder):
    e = corpus.with_previous(table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", "before")
    e = e.withColumn("changed", F.coalesce((F.col("event_type") != F.col("before")).cast("int"), F.lit(0)))
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.sum("changed").alias("changes"))


@query("""SELECT bank_id, b.kind, count(*) AS n, sum((code = 0)::INT)::BIGINT AS fine FROM service_log l LEFT JOIN banks b USING (bank_id) GROUP BY bank_id, b.kind""")
def usage_by_bank(spark, folder):
    # Counted by bank before the join: a bank with a third of the calls is one row by then.
    n = table(spark, folder, "service_log").groupBy("bank_id").agg(F.count("*").alias("n"), F.sum((F.col("code") == 0).cast("int")).alias("fine"))
    return n.join(table(spark, folder, "banks").select("bank_id", "kind"), "bank_id", "left").select("bank_id", "kind", "n", "fine")


@query("""WITH d AS (SELECT s.s.error_sent AS section, unnest(s.s.error_detail).error_type AS t FROM (SELECT unnest(errors) AS s FROM reports) s) SELECT coalesce(t, '') AS error_type, section, count(*) AS n FROM d GROUP BY ALL""")
def error_types(spark, folder):
    s = table(spark, folder, "reports").select(F.explode("errors").alias("s"))
    return s.select(F.col("s.error_sent").alias("section"), F.explode("s.error_detail.error_type").alias("t")).groupBy(F.coalesce("t", F.lit("")).alias("error_type"), "section").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS questions, count(r.id) AS reported FROM (SELECT DISTINCT query._id::BIGINT AS id FROM questions WHERE query._id IS NOT NULL) q LEFT JOIN (SELECT DISTINCT _id AS id FROM reports) r USING (id)""")
def reported_share(spark, folder):
    q = table(spark, folder, "questions").select(F.col("query._id").cast("bigint").alias("id")).where("id is not null").distinct()
    r = table(spark, folder, "reports").select(F.col("_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return q.join(r, "id", "left").agg(F.count("*").alias("questions"), F.count("hit").alias("reported"))


@query("""WITH c AS (SELECT row_id, list_filter(list_transform(regexp_split_to_array(query.answers, '[;；\n]'), lambda v: regexp_replace(v, '[ \t\n\r]', '', 'g')), lambda v: v <> '') AS v, regexp_replace(array_to_string(query.solutions, ''), '[ \t\n\r]', '', 'g') AS s FROM questions WHERE query.type = '填空题' AND query.answers IS NOT NULL AND len(query.solutions) > 0)
SELECT * FROM (SELECT row_id, len(v)::INT AS values, len(list_filter(v, lambda x: NOT contains(s, x)))::INT AS missing FROM c) WHERE missing > 0""")
def answer_match_blank(spark, folder):
    return records.blank_matches(table(spark, folder, "questions"))


@query("""WITH c AS (SELECT row_id, list_distinct(regexp_extract_all(query.description, '[（(]([^（()）]+)[）)]', 1)) AS p, array_to_string(query.solutions, chr(10)) AS s FROM questions WHERE query.description IS NOT NULL AND len(query.solutions) > 0)
SELECT row_id, len(p)::INT AS items, len(list_filter(p, lambda x: contains(s, x)))::INT AS found FROM c WHERE len(p) > 0""")
def answer_match_paren(spark, folder):
    return records.bracketed_matches(table(spark, folder, "questions"))


@query("""WITH c AS (SELECT row_id, query.answers AS a, array_to_string(query.solutions, chr(10)) AS s, query.stems[1].options[query.answers] AS o FROM questions WHERE query.type = '选择题' AND regexp_matches(query.answers, '^[A-F]$') AND len(query.solutions) > 0 AND len(query.stems) > 0)
SELECT row_id, CASE WHEN coalesce(regexp_extract_all(translate(s, 'ＡＢＣＤＥＦ', 'ABCDEF'), '(?:选|答案为|答案是|Answer|choose|answer is)[：: ]*([A-F])', 1)[-1], '') = a THEN 'named' WHEN o IS NOT NULL AND contains(s, o) THEN 'text' WHEN contains(s, a) THEN 'letter' ELSE 'none' END AS evidence FROM c""")
def choice_evidence(spark, folder):
    return records.choice_evidence(table(spark, folder, "questions"))


@query()
def latex_plain(spark, folder):
    f = rules.formulas(question_sections(table(spark, folder, "questions")))
    return f.select("row_id", "section", "item", "n", latex.plain_formula(F.col("formula")).alias("plain"))


@query()
def word_pieces(spark, folder):
    """Pieces by a vocabulary of the corpus's most frequent words, characters and their continuations (bounded at 4000)."""
    rows = _rows(spark, folder)
    top = [r["token"] for r in rows.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(1000).collect()]
    vocab = sorted({w for t in top for w in (t, *(("##" if i else "") + c for i, c in enumerate(t)))})[:4000]
    d = table(spark, folder, "documents").where(F.col("text").isNotNull())
    p = d.select("doc_id", tokenizing.pieces(tokenizing.basic_tokens(F.col("text")), vocab).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.size(F.filter("p", lambda x: x == "[UNK]")).alias("unknown"))


@query(f"""WITH {_EDITS} SELECT item_id, n, CASE WHEN cor = '' THEN 'delete ' || old ELSE 'replace ' || old || ' with ' || cor END AS message FROM n""")
def edit_messages(spark, folder):
    p = _edit_rows(spark, folder)
    return p.select("item_id", F.posexplode(edits.messages(F.col("a"), F.col("e"))).alias("n", "message"))


@query("""SELECT item_id, CASE WHEN item_id * 7919 % 1000 < 100 THEN 'valid' ELSE 'train' END AS part FROM eval_items""")
def train_valid_split(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", F.when(F.col("item_id") * 7919 % 1000 < 100, "valid").otherwise("train").alias("part"))


@query("""SELECT CASE WHEN subject IS NULL THEN 'none' WHEN subject = 'english' THEN 'english' WHEN subject IN ('history', 'politics', 'chinese') THEN 'chinese, humanities' WHEN subject = 'biology' THEN 'chinese, biology' WHEN subject IN ('physics', 'math', 'chemistry') THEN 'chinese, sciences' ELSE 'chinese, no spelling' END AS checker, count(*) AS n FROM questions GROUP BY ALL""")
def route_subjects(spark, folder):
    return table(spark, folder, "questions").groupBy(records.checker_of(F.col("subject")).alias("checker")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT row_id, query.answers AS a, CASE WHEN starts_with(trim(query.answers), '[') AND json_valid(query.answers) THEN query.answers::JSON END AS j FROM questions WHERE query.answers IS NOT NULL),
i AS (SELECT row_id, i, j->i::BIGINT AS x FROM (SELECT *, unnest(range(json_array_length(j)::BIGINT))::INT AS i FROM a WHERE j IS NOT NULL))
SELECT row_id, 0 AS i, 0 AS j, a AS value FROM a WHERE j IS NULL
UNION ALL SELECT row_id, i, 0, x->>'$' FROM i WHERE json_type(x) <> 'ARRAY'
UNION ALL SELECT row_id, i, k, x->>k::BIGINT FROM (SELECT *, unnest(range(json_array_length(x)::BIGINT))::INT AS k FROM i WHERE json_type(x) = 'ARRAY')""")
def answers_variant(spark, folder):
    a = records.canonical_answers(F.col("query.answers"))
    return table(spark, folder, "questions").select("row_id", F.posexplode(a).alias("i", "x")).select("row_id", "i", F.posexplode("x").alias("j", "value"))


@query(f"""{text_queries._SENTENCES}, w AS (SELECT *, lead(sentence) OVER o AS s1, lead(sentence, 3) OVER o AS s3, {_uniform_sql("row_id", "n")} AS u FROM x WINDOW o AS (PARTITION BY row_id, section, item ORDER BY n))
SELECT row_id, section, item, n, sentence AS first, CASE WHEN u < 0.5 AND s3 IS NOT NULL THEN s3 ELSE s1 END AS second, NOT (u < 0.5 AND s3 IS NOT NULL) AS is_next FROM w WHERE s1 IS NOT NULL""")
def next_sentences(spark, folder):
    s = cleaning.marked_sentences(question_sections(table(spark, folder, "questions")))
    return corpus.next_sentence_pairs(s.select("row_id", "section", "item", "n", "sentence"), "row_id", ("section", "item"))
