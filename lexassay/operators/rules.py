"""Located text rules.  Each takes sections ``row_id, section, item, text`` and returns error rows.

Everything is built-in string and higher-order functions, so that the rules stay in one generated stage;
spans come from ``locate``/``posexplode`` and count code points.  Nulls give no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexassay.functions import dims


def _errors(df: DataFrame, rule: str, start: Column, source: Column, target: Column | None = None) -> DataFrame:
    return df.select("row_id", "section", F.lit(rule).alias("rule"), "item", start.cast("int").alias("start_at"), (start + F.length(source)).cast("int").alias("end_at"), source.alias("source"), (target if target is not None else F.lit("")).alias("target"))


def symbol_runs(sections: DataFrame) -> DataFrame:
    """Distinct runs of two or more punctuation signs, ellipses aside, at their first place."""
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(f"([{dims.SYMBOLS}]{{2,}})"), F.lit(1)))
    runs = F.filter(runs, lambda r: ~r.contains("……") & ~r.contains("......"))
    df = sections.withColumn("run", F.explode(runs))
    return _errors(df, "symbol", F.expr("locate(run, text)") - 1, F.col("run"))


def space_runs(sections: DataFrame) -> DataFrame:
    """Three or more spaces between other characters, formulas masked."""
    masked = sections.withColumn("text", F.regexp_replace("text", r"\$[^$]*\$", "#"))
    df = masked.withColumn("run", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([^ \t\n] {3,}[^ \t\n])"), F.lit(1)))))
    return _errors(df, "space", F.expr("locate(run, text)") - 1, F.col("run"))


def characters(sections: DataFrame) -> DataFrame:
    """``row_id, section, item, pos, ch``: one row for each character."""
    return sections.select("row_id", "section", "item", F.posexplode(F.split("text", "")).alias("pos", "ch"))


def brackets(sections: DataFrame) -> DataFrame:
    """Unmatched brackets: each right bracket takes the nearest earlier left one of its kind; kinds may cross.

    Windows per text and kind: with P the running sum of left (+1) and right (-1), a right bracket is
    unmatched iff P falls to a new minimum below zero, a left one iff P never comes back below its value.
    Only brackets are exploded, so a window holds the brackets of one text.
    """
    signs = "".join(a + b for a, b in dims.BRACKETS)
    kinds = F.create_map(*[F.lit(x) for k, (a, b) in enumerate(dims.BRACKETS) for x in (a, k, b, k)])
    lefts = [a for a, _ in dims.BRACKETS]
    ch = characters(sections.where(F.col("text").rlike("[" + "".join("\\" + c if c in "()[]{}" else c for c in signs) + "]"))).where(F.col("ch").isin(*signs))
    ch = ch.withColumn("kind", kinds[F.col("ch")]).withColumn("d", F.when(F.col("ch").isin(lefts), 1).otherwise(-1))
    w = Window.partitionBy("row_id", "section", "item", "kind").orderBy("pos")
    ch = ch.withColumn("p", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ch = ch.withColumn("low", F.least(F.lit(0), F.coalesce(F.min("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))).withColumn("later", F.min("p").over(w.rowsBetween(1, Window.unboundedFollowing)))
    bad = ch.where(((F.col("d") == -1) & (F.col("p") < F.col("low"))) | ((F.col("d") == 1) & (F.col("later").isNull() | (F.col("later") >= F.col("p")))))
    return _errors(bad, "bracket", F.col("pos"), F.col("ch"))


def full_width_letters(sections: DataFrame) -> DataFrame:
    """Full-width letters in texts that also hold ASCII letters."""
    df = characters(sections.where(F.col("text").rlike("[A-Za-z]") & F.col("text").rlike("[Ａ-Ｚａ-ｚ]"))).where(F.col("ch").rlike("^[Ａ-Ｚａ-ｚ]$"))
    return _errors(df, "full width", F.col("pos"), F.col("ch"), dims.narrow(F.col("ch")))


def chinese_signs(sections: DataFrame) -> DataFrame:
    """Chinese punctuation in texts without any Chinese character, with the ASCII sign to use."""
    signs = F.create_map(*[F.lit(x) for kv in dims.ZH_TO_EN.items() for x in kv])
    df = characters(sections.where(~F.col("text").rlike("[一-鿿]") & F.col("text").rlike("[" + "".join(dims.ZH_TO_EN) + "]"))).where(F.col("ch").isin(*dims.ZH_TO_EN))
    return _errors(df, "chinese sign", F.col("pos"), F.col("ch"), signs[F.col("ch")])


def web_addresses(sections: DataFrame) -> DataFrame:
    """Addresses with a blank beside a point after ``www``."""
    df = sections.withColumn("run", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(www(?:\. | \.)[A-Za-z0-9]+)"), F.lit(1)))))
    return _errors(df, "web address", F.expr("locate(run, text)") - 1, F.col("run"), F.replace(F.col("run"), F.lit(" "), F.lit("")))


def repeated_formula_signs(sections: DataFrame) -> DataFrame:
    """Doubled ``^ + % @ & * $``."""
    df = sections.withColumn("run", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\^\^|\+\+|%%|@@|&&|\*\*|\$\$)"), F.lit(1)))))
    return _errors(df, "repeated sign", F.expr("locate(run, text)") - 1, F.col("run"))


def formulas(sections: DataFrame) -> DataFrame:
    """``row_id, section, item, n, formula``: the bodies of ``${...}$``."""
    bodies = F.regexp_extract_all("text", F.lit(r"\$\{(.*?)\}\$"), F.lit(1))
    return sections.select("row_id", "section", "item", F.posexplode(bodies).alias("n", "formula"))


#: Rules on a formula's body: signs that do not belong there.
ILLEGAL_IN_FORMULA = '["“”`·《》？：]'


def formula_checks(sections: DataFrame) -> DataFrame:
    """Formulas with unpaired brackets, illegal or repeated signs: ``row_id, section, item, n, problem``."""
    f = formulas(sections)
    count = lambda s: F.length("formula") - F.length(F.replace("formula", F.lit(s), F.lit("")))
    problems = F.array(
        *[F.when(count(a) != count(b), F.lit(f"unpaired {a}{b}")) for a, b in (("(", ")"), ("[", "]"), ("{", "}"))],
        F.when(F.col("formula").rlike(ILLEGAL_IN_FORMULA), F.lit("illegal sign")),
        F.when(F.col("formula").rlike(r"\^\^|\+\+|%%|@@|&&|\*\*|\$\$"), F.lit("repeated sign")),
    )
    return f.select("row_id", "section", "item", "n", F.explode(F.array_compact(problems)).alias("problem"))


def dollar_scheme(sections: DataFrame) -> DataFrame:
    """Texts in which ``${`` and ``}$`` do not pair up: ``row_id, section, item, opened, closed``."""
    t = F.regexp_replace("text", r"\$\{[^$]*\}\$", "@")
    count = lambda s: (F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s)
    df = sections.select("row_id", "section", "item", count("${").cast("int").alias("opened"), count("}$").cast("int").alias("closed"))
    return df.where("opened > 0 or closed > 0")


#: English writing rules: name and pattern.  Look-around free, so that any engine can run them.
WRITING = {
    "capital before stop": r"[a-z][A-Z]\.",
    "double dots": r"[^.]\.\.[^.]",
    "double capitals": r"\b[A-Z]{2}[a-z]{2,}",
    "missing capital": r"[a-z]{2}\. [a-z]",
    "a before vowel": r"\b[Aa] [aeio][a-z]+",
    "an before consonant": r"\b[Aa]n [b-df-gj-np-tv-z][a-z]+",
    "er that": r"[a-z]+er that\b",
    "space before stop": r"[a-z] [,.;:!?]",
    "stop and colon": r"\.:",
    "ly with hyphen": r"[a-z]ly-",
    "needs en dash": r"\b[0-9]+-[0-9]+\b",
    "spaces about dash": r" -- ?|--\s",
    "speech marks": r'\s"[a-z]',
    "abbreviated start": r"[.!?] (?:Fig|Eq|Sec)\.",
    "lower reference": r"\b(?:eq|fig|sec)\. ?[0-9]",
    "eq spacing": r"\bEq\.[0-9(]",
    "ie spacing": r"\bi\.e\.[A-Za-z]",
}


def writing_rules(sections: DataFrame) -> DataFrame:
    """``row_id, section, item, rule, hits`` of the English writing rules that fire; one pass over the text."""
    hits = F.array(*[F.struct(F.lit(k).alias("rule"), F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))).alias("hits")) for k, p in WRITING.items()])
    return sections.select("row_id", "section", "item", F.explode(F.filter(hits, lambda x: x["hits"] > 0)).alias("x")).select("row_id", "section", "item", "x.rule", F.col("x.hits").cast("int").alias("hits"))


#: The view of the text that a rule reads, where it is not the one without equations.
WRITING_VIEW = {
    **dict.fromkeys(("double dots", "speech marks"), "code"),
    **dict.fromkeys(("double capitals", "a before vowel", "an before consonant", "spaces about dash", "bare minus"), "no_math"),
}
#: Rules that need the views or line starts: lines end at \n alone, blanks and figures are those of any script.
TEX_WRITING = {
    "eq without brackets": r"(?mdU)(?:^|[ \t~])(?:[eE]qn?s?\.?\\?|[eE]quations?)[\s~]+(?:\\ref|\d)",
    "full form in sentence": r"(?U)[A-Z,;:a-z]\s+(?:Equation|Reference|Figure|Section)[\s~]*(?:\(?\\ref|\d)",
    "bare minus": r"(?mdU)(?:^|[ \t~]|[^{\n]\d)-\d",
}


def tex_views(sections: DataFrame) -> DataFrame:
    """Adds the text without comments and verbatim (``code``), also without equations (``no_equations``), also without inline mathematics (``no_math``)."""
    code = F.regexp_replace(F.regexp_replace("text", r"(?md)^[ \t]*%.*$", ""), r"(?md)^(.*[^\\\n])%.*$", "$1")
    for e in ("verbatim", "lstlisting"):
        code = F.regexp_replace(code, rf"(?s)\\begin\{{{e}\}}.*?\\end\{{{e}\}}", rf"\\begin{{{e}}} \\end{{{e}}}")
    kinds = r"(?:math|equation\*?|displaymath|eqnarray\*?|align)\}"
    equations = rf"(?s)(\\begin\{{{kinds}|\\[(\[]).*?(\\end\{{{kinds}|\\[\])])"
    df = sections.withColumn("code", code).withColumn("no_equations", F.regexp_replace("code", equations, "$1 xxx $2"))
    inline = F.regexp_replace("no_equations", r"(?s)([^\\])\$\$.*?[^\\]\$\$", r"$1\$xxx\$")
    return df.withColumn("no_math", F.regexp_replace(inline, r"(?s)([^\\])\$.*?[^\\]\$", r"$1\$xxx\$"))


def tex_writing_rules(sections: DataFrame) -> DataFrame:
    """``row_id, section, item, rule, hits`` of all 22 rules, each on its view of the text."""
    v = tex_views(sections).withColumn("w", _words("no_equations"))
    count = lambda k, p: F.size(F.regexp_extract_all(F.col(WRITING_VIEW.get(k, "no_equations")), F.lit(f"({p})"), F.lit(1)))
    hits = {k: count(k, p) for k, p in (WRITING | TEX_WRITING).items()}
    hits["full form in sentence"] = F.when(F.col("code").rlike(r"(?d)\\documentclass.*nature"), 0).otherwise(hits["full form in sentence"])
    hits["repeated word"] = F.size(F.filter(_word_pairs(F.col("w")), _repeated))
    hits["non-ASCII line"] = _non_ascii("code")
    x = v.select("row_id", "section", "item", F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), n.alias("hits")) for k, n in hits.items()]), lambda x: x["hits"] > 0)).alias("x"))
    return x.select("row_id", "section", "item", "x.rule", F.col("x.hits").cast("int").alias("hits"))


def _words(text: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z \t\n]+)"), F.lit(1)), lambda w: F.lower(w))


def _word_pairs(w: Column) -> Column:
    """Each word with the one before."""
    return F.arrays_zip(F.slice(w, 2, F.size(w)).alias("word"), w.alias("before"))


def _repeated(x: Column) -> Column:
    return (x["word"] == x["before"]) & x["word"].rlike("^[a-z]{2,}$")


def _non_ascii(text: str) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda l: l.rlike("[^ -~\t]")))


def repeated_words(sections: DataFrame) -> DataFrame:
    """A Latin word that equals the word before it: ``row_id, section, item, pos, word``."""
    w = sections.select("row_id", "section", "item", _words("text").alias("w")).where(F.size("w") > 1)
    x = w.select("row_id", "section", "item", F.posexplode(_word_pairs(F.col("w"))).alias("pos", "x"))
    return x.where(_repeated(F.col("x"))).select("row_id", "section", "item", (F.col("pos") + 1).alias("pos"), F.col("x.word").alias("word"))


def non_ascii_lines(sections: DataFrame) -> DataFrame:
    """Numbers of lines with characters outside printable ASCII: ``row_id, section, item, n_lines``."""
    return sections.select("row_id", "section", "item", _non_ascii("text").alias("n_lines")).where("n_lines > 0")


def serial_labels(sections: DataFrame) -> DataFrame:
    """Highest label ``(n)`` of each text: ``row_id, section, item, labels, highest``."""
    n = F.transform(F.regexp_extract_all("text", F.lit("[（(]([0-9]{1,2})[）)]"), F.lit(1)), lambda x: x.cast("int"))
    return sections.select("row_id", "section", "item", F.size(n).alias("labels"), F.array_max(n).alias("highest")).where("labels > 0")
