"""Normalising and cutting texts with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexassay.functions import dims


def without_tags(col: Column) -> Column:
    r"""``\rm``, tags and hard blanks to a space."""
    return F.regexp_replace(F.regexp_replace(col, r"(\\rm)|</?[^<>]+>", " "), "&nbsp;", " ")


def digits_to_chinese(col: Column) -> Column:
    """Each ASCII digit to its Chinese numeral."""
    return F.translate(col, "0123456789", dims.ZH_DIGITS)


def masked_letters(col: Column) -> Column:
    """Letters and underline runs to ``&``; sub-question labels, white space and points removed."""
    for pattern, to in (("[（(][0-9]+[）)]", ""), ("[A-Za-z]", "&"), ("_+", "&"), ("[ \t\n\r]", ""), ("[.．]", "")):
        col = F.regexp_replace(col, pattern, to)
    return col


def english_text(col: Column) -> Column:
    """Labels and Chinese removed, Chinese signs to ASCII, a space after sentence ends."""
    for pattern, to in (("[（(][0-9]+[）)]|[①-⑳]", ""), ("[_—-]{2,}", " "), ("[一-鿿]", "")):
        col = F.regexp_replace(col, pattern, to)
    col = F.translate(col, "".join(dims.ZH_TO_EN) + "！；（）", "".join(dims.ZH_TO_EN.values()) + "!;()")
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"([.?!])([A-Za-z])", "$1 $2"), "[ \t]+", " "))


def without_formulas(col: Column) -> Column:
    return F.regexp_replace(col, r"\$\{[^$]*\}\$", "")


def latin_from_cyrillic(col: Column) -> Column:
    """Cyrillic letters drawn like Latin ones to Latin."""
    return F.translate(col, dims.CYRILLIC, dims.CYRILLIC_ASCII)


def marked_sentences(sections: DataFrame) -> DataFrame:
    """``row_id, section, item, n, sentence``: a plain cut after Chinese end marks and closers."""
    marked = F.regexp_replace("text", "([。！？?][”’』」）)]*|……|\n)", "$1\u0001")
    return sections.select("row_id", "section", "item", F.posexplode(F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")).alias("n", "sentence"))


def tokens(col: Column) -> Column:
    """Latin words and figures as they are, each Chinese character alone, lower case."""
    return F.transform(F.regexp_extract_all(col, F.lit("([A-Za-z]+|[0-9]+|[一-鿿])"), F.lit(1)), lambda t: F.lower(t))


def kept_tokens(col: Column) -> Column:
    """Tokens of ASCII letters, ``^ - '`` only, those beside an ``@`` left out."""
    t = F.split(F.trim(F.regexp_replace(latin_from_cyrillic(col), "[ \t\n\r]+", " ")), " ")
    # an ``@`` takes its neighbours with it: mark them in the joined text, where no array is looked up by place
    joined = F.regexp_replace(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), "(?: [^ ]+)?(?: @)+ (?:[^ ]+ )?", "  ")
    return F.filter(F.split(joined, " "), lambda x: x.rlike("^[A-Za-z^'-]+$"))


def capital_parts(col: Column) -> Column:
    """A word split before each capital."""
    return F.split(F.regexp_replace(col, "([a-z])([A-Z])", "$1 $2"), " ")


def filled_blanks(question: Column, answers: Column) -> Column:
    """Blanks ``____`` of a question filled in order as ``【answer】``; surplus answers appended, missing ones left empty."""
    parts = F.split(question, "_{2,}")
    n = F.size(parts) - 1
    filled = F.array_join(F.transform(parts, lambda p, i: F.when(i < n, F.concat(p, F.lit("【"), F.coalesce(F.get(answers, i), F.lit("")), F.lit("】"))).otherwise(p)), "")
    rest = F.when(F.size(answers) > n, F.array_join(F.transform(F.slice(answers, n + 1, F.greatest(F.size(answers) - n, F.lit(0))), lambda a: F.concat(F.lit("【"), a, F.lit("】"))), "")).otherwise("")
    return F.concat(filled, rest)


def cut_before_capitals(col: Column) -> Column:
    """Pieces of a line cut after a point that a capital follows at once."""
    return F.split(F.regexp_replace(col, r"\.(?=[A-Z])", ".\u0001"), "\u0001")


def comma_cuts(col: Column, least: int = 20) -> Column:
    """A long sentence cut after commas that are at least ``least`` characters apart."""
    return F.filter(F.split(F.regexp_replace(col, f"([^，]{{{least},}}，)", "$1\u0001"), "\u0001"), lambda x: x != "")
