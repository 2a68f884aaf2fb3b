"""Queries of the located text rules and the cleaning functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexassay.functions import dims
from lexassay.operators import cleaning, reports, rules
from lexassay.operators.sections import document_sections, legacy_view, question_sections
from lexassay.sources.tables import table

from .registry import query

# The sections of questions as SQL, used by most comparisons.
SECTIONS = """sections AS (
  SELECT row_id, 'description' AS section, -1 AS item, query.description AS text FROM questions
  UNION ALL SELECT row_id, 'stems', (i - 1)::INT, query.stems[i].stem FROM (SELECT row_id, query, unnest(range(1, coalesce(len(query.stems), 0) + 1)) AS i FROM questions)
  UNION ALL SELECT row_id, 'solutions', (i - 1)::INT, query.solutions[i] FROM (SELECT row_id, query, unnest(range(1, coalesce(len(query.solutions), 0) + 1)) AS i FROM questions)
  UNION ALL SELECT row_id, 'explanations', (i - 1)::INT, query.explanations[i] FROM (SELECT row_id, query, unnest(range(1, coalesce(len(query.explanations), 0) + 1)) AS i FROM questions)),
s AS (SELECT * FROM sections WHERE text IS NOT NULL)"""
CHARS = "ch AS (SELECT row_id, section, item, i - 1 AS pos, substr(text, i, 1) AS ch, text FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM s))"


# Texts with what the tables do not hold, for rules that would else be compared on no rows.
PLANTED = ["see www. example and www .site", "a++b, c^^2 and 50%%", "${(a+b}$, ${[x]]}$ and ${a^^2}$", "${y= 2x}$", "the the ferry was was lost", "fine"]
PLANTED_SECTIONS = SECTIONS.rsplit("s AS (", 1)[0] + "s AS (SELECT * FROM sections WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, 'planted', 0, '{t}')" for i, t in enumerate(PLANTED, 1)) + ") p(row_id, section, item, text))"


def _sections(spark, folder) -> DataFrame:
    return question_sections(table(spark, folder, "questions"))


def _planted(spark, sections: DataFrame) -> DataFrame:
    rows = spark.createDataFrame([(-i, "planted", 0, t) for i, t in enumerate(PLANTED, 1)], "row_id long, section string, item int, text string")
    return sections.select("row_id", "section", "item", "text").unionByName(rows)


def _first_place(pattern: str, rule: str, keep: str = "true", text: str = "text", target: str = "''", sections: str = SECTIONS) -> str:
    return f"""WITH {sections}, m AS (SELECT DISTINCT row_id, section, item, {text} AS text, unnest(list_distinct(regexp_extract_all({text}, '{pattern}'))) AS run FROM s)
SELECT row_id, section, '{rule}' AS rule, item, (instr(text, run) - 1)::INT AS start_at, (instr(text, run) - 1 + length(run))::INT AS end_at, run AS source, {target} AS target FROM m WHERE {keep}"""


SYMBOL_SQL = _first_place(f"[{dims.SYMBOLS}]{{2,}}", "symbol", "NOT contains(run, '……') AND NOT contains(run, '......')")


@query(SYMBOL_SQL)
def symbol_confusion(spark, folder):
    return rules.symbol_runs(_sections(spark, folder))


@query(_first_place(r"[^ \t\n] {3,}[^ \t\n]", "space", text=r"regexp_replace(text, '\$[^$]*\$', '#', 'g')"))
def space_runs(spark, folder):
    return rules.space_runs(_sections(spark, folder))


@query(f"""WITH {SECTIONS}, {CHARS}, k(kind, l, r) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(dims.BRACKETS))}),
b AS (SELECT row_id, section, item, pos, ch, kind, CASE WHEN ch = l THEN 1 ELSE -1 END AS d FROM ch JOIN k ON ch = l OR ch = r),
p AS (SELECT *, sum(d) OVER w AS p FROM b WINDOW w AS (PARTITION BY row_id, section, item, kind ORDER BY pos)),
x AS (SELECT *, least(0, coalesce(min(p) OVER (PARTITION BY row_id, section, item, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low,
  min(p) OVER (PARTITION BY row_id, section, item, kind ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM p)
SELECT row_id, section, 'bracket' AS rule, item, pos::INT AS start_at, (pos + 1)::INT AS end_at, ch AS source, '' AS target FROM x
WHERE (d = -1 AND p < low) OR (d = 1 AND (later IS NULL OR later >= p))""")
def bracket_report(spark, folder):
    return rules.brackets(_sections(spark, folder))


@query(f"""WITH {SECTIONS}, {CHARS} SELECT section, ch AS sign, count(*) AS n FROM ch WHERE ch IN ({", ".join(f"'{c}'" for p in dims.BRACKETS for c in p)}) GROUP BY ALL""")
def bracket_summary(spark, folder):
    signs = [c for p in dims.BRACKETS for c in p]
    return rules.characters(_sections(spark, folder)).where(F.col("ch").isin(signs)).groupBy("section", F.col("ch").alias("sign")).agg(F.count("*").alias("n"))


_NARROW = f"translate(ch, '{dims.FULL_WIDTH}', '{dims.HALF_WIDTH}')"


@query(f"""WITH {SECTIONS}, {CHARS} SELECT row_id, section, 'full width' AS rule, item, pos::INT AS start_at, (pos + 1)::INT AS end_at, ch AS source, {_NARROW} AS target
FROM ch WHERE regexp_matches(text, '[A-Za-z]') AND regexp_matches(ch, '^[Ａ-Ｚａ-ｚ]$')""")
def fullwidth_mix(spark, folder):
    return rules.full_width_letters(_sections(spark, folder))


@query(f"""WITH {SECTIONS}, {CHARS} SELECT row_id, section, 'chinese sign' AS rule, item, pos::INT AS start_at, (pos + 1)::INT AS end_at, ch AS source, translate(ch, '{"".join(dims.ZH_TO_EN)}', '{"".join(v.replace("'", "''") for v in dims.ZH_TO_EN.values())}') AS target
FROM ch WHERE NOT regexp_matches(text, '[一-鿿]') AND ch IN ({", ".join(f"'{c}'" for c in dims.ZH_TO_EN)})""")
def zh_punct_in_latin(spark, folder):
    return rules.chinese_signs(_sections(spark, folder))


WEB_SQL = _first_place(r"www(?:\. | \.)[A-Za-z0-9]+", "web address", target="replace(run, ' ', '')")


@query(_first_place(r"www(?:\. | \.)[A-Za-z0-9]+", "web address", target="replace(run, ' ', '')", sections=PLANTED_SECTIONS))
def url_format(spark, folder):
    return rules.web_addresses(_planted(spark, _sections(spark, folder)))


@query(_first_place(r"\^\^|\+\+|%%|@@|&&|\*\*|\$\$", "repeated sign", sections=PLANTED_SECTIONS))
def latex_repeat(spark, folder):
    return rules.repeated_formula_signs(_planted(spark, _sections(spark, folder)))


@query(f"""WITH {SECTIONS}, f AS (SELECT row_id, section, item, regexp_extract_all(text, '\\$\\{{(.*?)\\}}\\$', 1) AS f FROM s)
SELECT row_id, section, item, (i - 1)::INT AS n, f[i] AS formula FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM f)""")
def latex_extract(spark, folder):
    return rules.formulas(_sections(spark, folder))


_COUNT = "length(formula) - length(replace(formula, '{}', ''))"


@query(f"""WITH {PLANTED_SECTIONS}, g AS (SELECT row_id, section, item, regexp_extract_all(text, '\\$\\{{(.*?)\\}}\\$', 1) AS f FROM s),
f AS (SELECT row_id, section, item, (i - 1)::INT AS n, f[i] AS formula FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM g))
""" + " UNION ALL ".join([f"SELECT row_id, section, item, n, 'unpaired {a}{b}' AS problem FROM f WHERE {_COUNT.format(a)} <> {_COUNT.format(b)}" for a, b in (("(", ")"), ("[", "]"), ("{", "}"))] + [f"SELECT row_id, section, item, n, 'illegal sign' FROM f WHERE regexp_matches(formula, '{rules.ILLEGAL_IN_FORMULA}')", r"SELECT row_id, section, item, n, 'repeated sign' FROM f WHERE regexp_matches(formula, '\^\^|\+\+|%%|@@|&&|\*\*|\$\$')"]))
def latex_pairs(spark, folder):
    return rules.formula_checks(_planted(spark, _sections(spark, folder)))


@query(f"""WITH {SECTIONS}, t AS (SELECT row_id, section, item, regexp_replace(text, '\\$\\{{[^$]*\\}}\\$', '@', 'g') AS t FROM s),
c AS (SELECT row_id, section, item, ((length(t) - length(replace(t, '${{', ''))) / 2)::INT AS opened, ((length(t) - length(replace(t, '}}$', ''))) / 2)::INT AS closed FROM t)
SELECT * FROM c WHERE opened > 0 OR closed > 0""")
def latex_scheme(spark, folder):
    return rules.dollar_scheme(_sections(spark, folder))


def _writing_sql() -> str:
    parts = [f"SELECT doc_id AS row_id, 'text' AS section, 0 AS item, '{k}' AS rule, len(regexp_extract_all(text, '{p}'))::INT AS hits FROM documents" for k, p in rules.WRITING.items()]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE hits > 0"


@query(_writing_sql())
def tex_rules(spark, folder):
    return rules.writing_rules(document_sections(table(spark, folder, "documents")))


# Views with lazy matches and rules on lines: tested against Python's patterns instead.
@query()
def tex_rules_views(spark, folder):
    return rules.tex_writing_rules(document_sections(table(spark, folder, "documents")))


@query("""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z \t\n]+'), lambda x: lower(x)) AS w FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"({-i}, '{t}')" for i, t in enumerate(PLANTED, 1)) + """) p(doc_id, text)))
SELECT doc_id AS row_id, 'text' AS section, 0 AS item, (i - 1)::INT AS pos, w[i] AS word FROM (SELECT *, unnest(range(2, len(w) + 1)) AS i FROM w) WHERE w[i] = w[i - 1] AND regexp_matches(w[i], '^[a-z]{2,}$')""")
def repeated_words(spark, folder):
    docs = document_sections(table(spark, folder, "documents"))
    return rules.repeated_words(_planted(spark, docs).withColumn("section", F.lit("text")))


@query("""SELECT * FROM (SELECT doc_id AS row_id, 'text' AS section, 0 AS item, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ -~\t]')))::INT AS n_lines FROM documents WHERE text IS NOT NULL) WHERE n_lines > 0""")
def non_ascii_lines(spark, folder):
    return rules.non_ascii_lines(document_sections(table(spark, folder, "documents")))


@query(f"""WITH {SECTIONS}, l AS (SELECT row_id, section, item, list_transform(regexp_extract_all(text, '[（(]([0-9]{{1,2}})[）)]', 1), lambda x: x::INT) AS l FROM s)
SELECT row_id, section, item, len(l)::INT AS labels, list_max(l) AS highest FROM l WHERE len(l) > 0""")
def serial_labels(spark, folder):
    return rules.serial_labels(_sections(spark, folder))


@query("SELECT log_id, length(regexp_replace(regexp_replace(payload, '(\\\\rm)|</?[^<>]+>', ' ', 'g'), '&nbsp;', ' ', 'g')) AS n, md5(regexp_replace(regexp_replace(payload, '(\\\\rm)|</?[^<>]+>', ' ', 'g'), '&nbsp;', ' ', 'g')) AS digest FROM service_log")
def tag_filter(spark, folder):
    t = cleaning.without_tags(F.col("payload"))
    return table(spark, folder, "service_log").select("log_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


@query(f"SELECT doc_id, md5(translate(text, '0123456789', '{dims.ZH_DIGITS}')) AS digest FROM documents")
def digit_to_zh(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(cleaning.digits_to_chinese(F.col("text"))).alias("digest"))


@query(f"SELECT row_id, md5(translate(query.description, '{dims.CYRILLIC}', '{dims.CYRILLIC_ASCII}')) AS digest FROM questions WHERE regexp_matches(query.description, '[{dims.CYRILLIC}]')")
def cyrillic_map(spark, folder):
    d = F.col("query.description")
    return table(spark, folder, "questions").where(d.rlike(f"[{dims.CYRILLIC}]")).select("row_id", F.md5(cleaning.latin_from_cyrillic(d)).alias("digest"))


def _chain(col: str, steps) -> str:
    for pattern, to in steps:
        col = f"regexp_replace({col}, '{pattern}', '{to}', 'g')"
    return col


@query(f"""SELECT row_id, md5({_chain("query.description", (("[（(][0-9]+[）)]", ""), ("[A-Za-z]", "&"), ("_+", "&"), ("[ \t\n\r]", ""), ("[.．]", "")))}) AS digest FROM questions WHERE query.description IS NOT NULL""")
def preprocess_zh(spark, folder):
    d = F.col("query.description")
    return table(spark, folder, "questions").where(d.isNotNull()).select("row_id", F.md5(cleaning.masked_letters(d)).alias("digest"))


_ZH, _EN = "".join(dims.ZH_TO_EN) + "！；（）", "".join(v.replace("'", "''") for v in dims.ZH_TO_EN.values()) + "!;()"


@query(f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate({_chain("text", (("[（(][0-9]+[）)]|[①-⑳]", ""), ("[_—-]{2,}", " "), ("[一-鿿]", "")))}, '{_ZH}', '{_EN}'), '([.?!])([A-Za-z])', '\\1 \\2', 'g'), '[ \t]+', ' ', 'g'))) AS digest FROM documents""")
def en_normalise(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(cleaning.english_text(F.col("text"))).alias("digest"))


_SENTENCES = f"""WITH {SECTIONS}, m AS (SELECT row_id, section, item, list_filter(list_transform(string_split(regexp_replace(text, '([。！？?][”’』」）)]*|……|\n)', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM s),
x AS (SELECT row_id, section, item, (i - 1)::INT AS n, l[i] AS sentence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM m))"""


@query(_SENTENCES + " SELECT * FROM x")
def sentence_split(spark, folder):
    return cleaning.marked_sentences(_sections(spark, folder))


@query(_SENTENCES + " SELECT section, count(*) AS n, sum(length(sentence))::BIGINT AS characters FROM x WHERE length(sentence) > 10 AND length(sentence) < 100 GROUP BY section")
def sentence_length_gate(spark, folder):
    s = cleaning.marked_sentences(_sections(spark, folder))
    return s.where((F.length("sentence") > 10) & (F.length("sentence") < 100)).groupBy("section").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("characters"))


@query(f"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(translate(text, '{dims.CYRILLIC}', '{dims.CYRILLIC_ASCII}'), '[ \t\n\r]+', ' ', 'g')), ' ') AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, t[i] AS w, i FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM t) WHERE regexp_matches(t[i], '^[A-Za-z^''-]+$') AND coalesce(t[i + 1], '') <> '@' AND (i = 1 OR t[i - 1] <> '@'))
SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY i)) AS digest FROM x GROUP BY doc_id""")
def token_filter(spark, folder):
    k = cleaning.kept_tokens(F.col("text"))
    return table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", k.alias("k")).where(F.size("k") > 0).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("""WITH x AS (SELECT row_id, string_split(regexp_replace(query.description, '_{2,}', chr(1), 'g'), chr(1)) AS p, regexp_extract_all(query.answers, '[^,，;；|\t\n ]+') AS a FROM questions WHERE query.type = '填空题' AND query.description IS NOT NULL AND query.answers IS NOT NULL)
SELECT row_id, md5(list_aggregate(list_transform(p, lambda e, i: CASE WHEN i < len(p) THEN e || '【' || coalesce(a[i], '') || '】' ELSE e END), 'string_agg', '') || coalesce(list_aggregate(list_transform(a[len(p):], lambda e: '【' || e || '】'), 'string_agg', ''), '')) AS digest FROM x""")
def answer_fill(spark, folder):
    q = F.col("query")
    t = table(spark, folder, "questions").where((q["type"] == "填空题") & q["description"].isNotNull() & q["answers"].isNotNull())
    return t.select("row_id", F.md5(cleaning.filled_blanks(q["description"], F.regexp_extract_all(q["answers"], F.lit("([^,，;；|\t\n ]+)"), F.lit(1)))).alias("digest"))


@query("""SELECT _id, row_id, question, type, difficulty FROM (SELECT query._id::BIGINT AS _id, row_id, query.description AS question, query.type AS type, query.difficulty AS difficulty, row_number() OVER (PARTITION BY query._id::BIGINT ORDER BY received_at DESC NULLS LAST, row_id DESC) AS n FROM questions WHERE query._id IS NOT NULL) WHERE n = 1""")
def last_record_wins(spark, folder):
    return legacy_view(table(spark, folder, "questions"))


@query(f"""WITH u AS (SELECT DISTINCT * FROM (({SYMBOL_SQL}) UNION ALL ({WEB_SQL}))),
n AS (SELECT row_id, section, rule, row_number() OVER (PARTITION BY row_id, section ORDER BY item, start_at, rule, end_at, source) AS k FROM u)
SELECT row_id, count(DISTINCT section) AS sections, count(*) AS errors, max(k) AS highest FROM n GROUP BY row_id""")
def nested_report(spark, folder):
    s = _sections(spark, folder)
    r = reports.nested(reports.union(rules.symbol_runs(s), rules.web_addresses(s)))
    n = F.aggregate("errors", F.lit(0), lambda a, e: a + F.size(e["error_detail"]))
    top = F.array_max(F.transform("errors", lambda e: F.array_max(F.transform(e["error_detail"], lambda d: d["_id"]))))
    return r.select("row_id", F.size("errors").cast("long").alias("sections"), n.cast("long").alias("errors"), top.cast("long").alias("highest"))


@query("""WITH s AS (SELECT report_id, i - 1 AS a, errors[i] AS s FROM (SELECT *, unnest(range(1, len(errors) + 1)) AS i FROM reports)),
d AS (SELECT report_id, a, s.error_sent AS section, j - 1 AS b, s.error_detail[j] AS d FROM (SELECT *, unnest(range(1, coalesce(len(s.error_detail), 0) + 1)) AS j FROM s))
SELECT report_id, a::INT AS section_at, section, b::INT AS detail_at, d.error_type AS error_type, coalesce(len(d.source), 0)::INT AS n_source, coalesce(len(d.position), 0)::INT AS n_positions FROM d""")
def report_flat(spark, folder):
    return reports.flat(table(spark, folder, "reports"))


@query("""WITH s AS (SELECT _id, unnest(errors) AS s FROM reports), d AS (SELECT _id, s.error_sent AS section, unnest(s.error_detail) AS d FROM s)
SELECT _id, section, coalesce(d.error_type, '') AS error_type, count(*) AS n FROM d GROUP BY ALL""")
def merge_reports(spark, folder):
    return reports.merged(table(spark, folder, "reports"))
