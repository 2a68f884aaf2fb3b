"""Texts cut off by field limits or broken transfers.

A stack automaton runs once over the whole text, whatever its length and number of lines.  Its stack holds
the quotations, brackets, titles, formulas, tags and escapes that are open and, below them, the sentence: a
sentence is open from its first letter to its end mark, and ``...`` or a single ellipsis does not end it.
What stands on the stack at the end of the text is the evidence:

* an escape, entity, tag or multibyte sequence begun and not ended, or an open formula: the text is cut;
* a quotation or bracket still open although no more sentences have ended in it than pairs of its kind
  hold in that source: the text is cut if the source closes its pairs (an opening further back is a stray sign);
* an open sentence: a missing terminator.  The text is cut unless its last line is a closing, or the source
  hardly ever ends its texts with a mark.

The baselines come from all documents; a group of copies makes none of them:

* by source: how many of the opened quotations and brackets are closed and how many sentences they hold, and
  how often texts end with a mark;
* the field limits of each source: lengths, in characters or bytes, at which unterminated texts pile up.
  At a limit whatever is open decides, also inside an option or a closing line;
* the closing lines: last lines that begin alike and hardly ever end with a mark are closings such as key
  words or sources.  Lists of options, bracketed notes, ``label: value`` and short lines that close with an
  option letter or a figure are closings by their form.

The structure is computed once, row by row, and written to the checkpoint folder; the baselines are small
aggregates of it.  Null and empty texts are not cut.  Repeated documents are judged alike.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexassay.functions.lineage import cut_lineage
from lexassay.functions.text import plain_view

from .sentences import CLOSING, INNER

#: A length is a limit of its source if at least LIMIT_LEAST unterminated texts and LIMIT_SHARE of them have it.
LIMIT_LEAST, LIMIT_SHARE = 4, 0.06
#: A line head is that of a closing if at least so many different texts' last lines have it and so few of them end with a mark.
CLOSING_LEAST, CLOSING_ENDED = 5, 0.1
#: Characters of a closing line at most.
SHORT = 60
#: Least share of opened pairs that a source closes, and share of its pairs that its reach covers; with fewer
#: than PAIRS_LEAST pairs the source is judged by all sources, and without any by REACH sentences.
CLOSED_SHARE, REACH_SHARE, PAIRS_LEAST, REACH = 0.8, 0.95, 20, 2
#: A missing terminator is evidence only where at least this share of a source's texts end with a mark or a closing.
ENDED_SHARE, ENDED_LEAST = 0.3, 20
#: Pairs that hold more sentences than this are counted together.
MOST_ENDS = 9
MOST_BROADCAST = 100_000

_PAIRS = {"“": "”", "「": "」", "『": "』", "《": "》", "(": ")", "[": "]", "【": "】"}
_BACK = {v: k for k, v in _PAIRS.items()}
#: Kinds of frames: 0 quotations and titles, 1 brackets.
_KIND = {"“": 0, "「": 0, "『": 0, "《": 0, '"': 0, "(": 1, "[": 1, "【": 1}
_EVENT = re.compile(
    r"(?P<open>[“「『《(\[【])|(?P<close>[”」』》)\]】])|(?P<straight>\")|(?P<formula>\$)|(?P<line>\n)"
    r"|(?P<end>[.。!?؟।॥።։៕⁇‼⁈⁉…]+)"
    r"|(?P<escape>&(?:#x?[0-9a-fA-F]{0,7}|[A-Za-z]{0,6});?|\\u[0-9a-fA-F]{0,4}|\\x[0-9a-fA-F]{0,2}|(?<=[0-9A-Fa-f])%[0-9A-Fa-f]{0,2}|</?(?:[A-Za-z][^<>\n]{0,200})?>?|�+|[\ud800-\udbff])"
)
_WHOLE_ESCAPE = re.compile(r"&[^;]+;|\\u.{4}|\\x..|%..|<.*>")
_FORMULA_BODY = re.compile(r"[^$\u4e00-\u9fff。，\n]*")
_ELLIPSIS = re.compile(r"…{2,}|\.{6}|…\.{3}")
_ABBREVIATION = re.compile(r"(?<![^\W_])(" + "|".join(sorted(map(re.escape, {*INNER, *CLOSING}), key=len, reverse=True)) + r"|[A-Z])\Z")
_MONTH = frozenset("Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split())
_TIME = frozenset(("a.m", "p.m", "A.M", "P.M", "etc", "Inc", "Ltd", "Co", "Corp"))
_ANSWER_BEFORE = re.compile(r"(?:choose|answer(?: is)?|[选為为是:])\s*[A-H]\Z", re.I)
_DRAWN = re.compile(r"[^\W_]")

# Closings by their form, on the last line of a text.
_OPTION = re.compile(r"[(（]?[A-Ha-h][)）]?\s?[.、:．]\s?\S.{0,60}\Z")
_LABELLED = re.compile(r"[^\W\d_]{1,8}(?: [^\W\d_]{1,8})?\s?[:]\s?[^\s“「\"].{0,60}\Z")
_SHORT_VALUE = re.compile(r"(?=.{1,24}\Z)[^;。!?]*(?:[^\W\d_]\s?|[\s.:])(?:\d+(?:\.\d+)?|[A-H])\Z")


def walk(s: str) -> dict:
    """Runs the stack automaton over a text: what is open at its end and the pairs closed on the way.

    ``open``: by kind, the fewest ends of sentences inside a pair that is still open, or None; ``closed``: by
    kind, the numbers of closed pairs by the ends of sentences they hold; ``sentence``: a sentence is open;
    ``weak``: it was ended by a sign that may be none; ``hanging``: a pair of the last line is open; ``escape``, ``formula``.
    """
    stack: list[list] = []  # [opening sign, ends inside, the sentence was open when it opened, place]
    closed = [[0] * (MOST_ENDS + 1), [0] * (MOST_ENDS + 1)]
    ended = here = 0  # end of the last sentence; end of the last event
    weak = formula = escape = False
    n = len(s)

    def is_open(upto: int) -> bool:
        return bool(_DRAWN.search(s, ended, upto))

    def pop(sign: str, at: int) -> None:
        nonlocal ended
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == sign:
                _, ends, outer, _ = stack[i]
                closed[_KIND[sign]][min(ends, MOST_ENDS)] += 1
                del stack[i:]
                # a pair that stands outside any sentence is a note; one that closes right after an end mark
                # belongs to the sentence that ended in it
                if (not outer and _KIND[sign]) or ended == at:
                    ended = at + 1
                return
        if ended == at:
            ended = at + 1

    for m in _EVENT.finditer(s):
        a, b = m.span()
        if a < here:
            continue
        here = b
        kind = m.lastgroup
        if kind == "open":
            stack.append([m[0], 0, is_open(a), a])
        elif kind == "close":
            pop(_BACK[m[0]], a)
        elif kind == "straight":
            if any(f[0] == '"' for f in stack):
                pop('"', a)
            else:
                stack.append(['"', 0, is_open(a), a])
        elif kind == "formula":
            body = _FORMULA_BODY.match(s, b)
            if body.end() < n and s[body.end()] == "$":
                here = body.end() + 1
            elif body.end() == n and (s.startswith("{", b) or b == n and not (a and (s[a - 1] == "}" or s[a - 1].isalnum() and not "一" <= s[a - 1] <= "鿿"))):
                formula = True
                break
        elif kind == "end":
            run = m[0]
            weak = False
            if set(run) <= {"…", "."} and len(run) > 1 or run == "…":
                if not _ELLIPSIS.fullmatch(run):
                    continue
            elif run == ".":
                if b < n and s[b].isalnum() and s[b].isascii():
                    continue
                word = _ABBREVIATION.search(s, max(0, a - 12), a)
                if word and word[1] not in _TIME:
                    if word[1] in _MONTH or len(word[1]) == 1 and _ANSWER_BEFORE.search(s, max(0, a - 24), a):
                        weak = True
                    elif word[1] not in CLOSING or b == n:
                        continue
                elif not word and a and s[a - 1].isdigit():
                    weak = True
            ended = b
            for f in stack:
                f[1] += 1
        elif kind == "escape" and b == n and not _WHOLE_ESCAPE.fullmatch(m[0]):
            escape = True
        elif kind == "line" and _OPTION.match(s, s.rfind("\n", 0, a) + 1, a):
            ended = b  # an option of a list needs no end mark
    held: list[int | None] = [None, None]
    for sign, ends, _, _ in stack:
        k = _KIND[sign]
        held[k] = ends if held[k] is None else min(held[k], ends)
    return {"open": held, "closed": closed, "sentence": is_open(n), "weak": weak and not is_open(n), "escape": escape, "formula": formula, "hanging": bool(stack) and stack[-1][3] > s.rfind("\n")}


def is_closing(line: str) -> bool:
    """A last line that closes a text without an end mark, by its form."""
    return bool(_OPTION.match(line) or _LABELLED.match(line) or _SHORT_VALUE.match(line))


def structure(text: str) -> dict:
    """How a text ends, for the baselines and the judgement."""
    s, at = plain_view(text)
    s = s.rstrip()
    w = walk(s)
    line = s[s.rfind("\n") + 1 :].strip()
    several = "\n" in s.strip()
    tail = _REMNANT.search(s, max(0, len(s) - 40))
    return {
        "sentence": w["sentence"],
        "weak": w["weak"],
        "escape": w["escape"],
        "formula": w["formula"],
        "quote": w["open"][0],
        "bracket": w["open"][1],
        "quotes": w["closed"][0],
        "brackets": w["closed"][1],
        "closing": is_closing(line) and not w["hanging"] and (several or bool(_OPTION.match(line))),
        "hanging": w["hanging"],
        "head": _head(line) if several else None,
        "short": len(line) <= SHORT,
        # without a sign of shortening, which comes on top of the limit
        "n_chars": len(text) - (len(tail[0]) if tail and w["sentence"] and at is None else 0),
        "n_bytes": len(text.rstrip("�").encode("utf-8", "surrogatepass")),
        "torn": text.endswith("�"),
    }


_REMNANT = re.compile(r"\s*(?:\.{3}|…|\[[^\[\]]{1,20}\]|\([^()]{1,20}\))\Z")


def _head(line: str) -> str:
    words = re.findall(r"[^\W\d_]+|\d+", line)
    if words and re.match(r"[A-Za-z]", words[0]):
        return " ".join("9" if w.isdigit() else w for w in words[:2]).lower()
    return re.sub(r"\d+", "9", line.strip())[:3]


_COUNTS = T.ArrayType(T.IntegerType())
_TYPES = {
    "sentence": (T.BooleanType(), pa.bool_()), "weak": (T.BooleanType(), pa.bool_()), "escape": (T.BooleanType(), pa.bool_()), "formula": (T.BooleanType(), pa.bool_()),
    "quote": (T.IntegerType(), pa.int32()), "bracket": (T.IntegerType(), pa.int32()), "quotes": (_COUNTS, pa.list_(pa.int32())), "brackets": (_COUNTS, pa.list_(pa.int32())),
    "closing": (T.BooleanType(), pa.bool_()), "hanging": (T.BooleanType(), pa.bool_()), "head": (T.StringType(), pa.string()), "n_chars": (T.IntegerType(), pa.int32()), "n_bytes": (T.IntegerType(), pa.int32()), "torn": (T.BooleanType(), pa.bool_()), "short": (T.BooleanType(), pa.bool_()),
}
_STRUCT = T.StructType([T.StructField(k, v) for k, (v, _) in _TYPES.items()])
_PA = pa.struct([(k, v) for k, (_, v) in _TYPES.items()])


@arrow_udf(_STRUCT)
def _structure(texts: pa.Array) -> pa.Array:
    return pa.array([structure(t) for t in texts.to_pylist()], _PA)


def ends(documents: DataFrame) -> DataFrame:
    """``doc_id, source, digest`` and the structure of each text's end, computed once; null where there is no text."""
    has = F.col("text").isNotNull() & (F.trim("text") != "")
    d = documents.select("doc_id", "source", F.unhex(F.md5("text")).alias("digest"), F.when(has, F.col("text")).alias("t"))
    return cut_lineage(d.select("doc_id", "source", "digest", F.when(F.col("t").isNotNull(), _structure(F.coalesce("t", F.lit("")))).alias("s")).select("doc_id", "source", "digest", F.col("s").isNotNull().alias("filled"), "s.*"))


def _byte_size() -> Column:
    """Length in bytes; that of a torn text with the character it lost."""
    return F.when(F.col("torn"), F.floor((F.col("n_bytes") + 2) / 3) * 3).otherwise(F.col("n_bytes")).cast("int")


def field_limits(structures: DataFrame) -> DataFrame:
    """``source, unit, size``: the lengths at which a source's unterminated texts pile up.

    Different texts are counted.  Copies add weight only to texts that are cut by their structure, and only
    where another text has the same length: a group of copies alone makes no limit.
    """
    loose = structures.where(F.col("sentence") | F.col("weak") | F.col("escape") | F.col("formula"))
    sure = F.col("escape") | F.col("formula") | (F.col("sentence") & ~F.col("closing"))
    texts = loose.groupBy("source", "digest", "n_chars", "n_bytes", "torn").agg(F.when(F.max(sure), F.count("*")).otherwise(1).alias("n"))
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), _byte_size().alias("size")))
    by = texts.select("source", "n", F.explode(units).alias("u")).groupBy("source", "u.unit", "u.size").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    total = by.groupBy("source", "unit").agg(F.sum("texts").alias("all_texts"), F.sum("n").alias("total"))
    by = by.join(total.withColumnsRenamed({"source": "_s", "unit": "_u"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("unit") == F.col("_u")))
    by_texts = (F.col("texts") >= LIMIT_LEAST) & (F.col("texts") >= LIMIT_SHARE * F.col("all_texts"))
    by_copies = (F.col("texts") >= 2) & (F.col("n") >= LIMIT_LEAST) & (F.col("n") >= LIMIT_SHARE * F.col("total"))
    return by.where(by_texts | by_copies).select("source", "unit", "size")


def closing_heads(structures: DataFrame) -> DataFrame:
    """``head``: beginnings of last lines that are closings."""
    texts = structures.where(F.col("head").isNotNull() & (F.col("head") != "")).select("head", "digest", "sentence").distinct()
    by = texts.groupBy("head").agg(F.count("*").alias("n"), F.sum((~F.col("sentence")).cast("long")).alias("ended"))
    return by.where((F.col("n") >= CLOSING_LEAST) & (F.col("ended") <= CLOSING_ENDED * F.col("n"))).select("head")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a statistic only if it is small; else an ordinary join."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def pair_habits(structures: DataFrame) -> DataFrame:
    """``source`` (null-safe) and, by kind of pair, the sentences its pairs hold at most (``REACH_SHARE`` of
    them), or null where the source does not close what it opens; ``ended``: its texts end with a mark or a closing."""
    texts = structures.where("filled").groupBy("source", "digest").agg(*[F.first(c).alias(c) for c in ("quote", "bracket", "quotes", "brackets", "sentence", "closing")])
    counts = [F.sum(F.col(k)[i]).alias(f"{k}{i}") for k in ("quotes", "brackets") for i in range(MOST_ENDS + 1)]
    left = [F.sum(F.col(k).isNotNull().cast("long")).alias(f"open_{k}") for k in ("quote", "bracket")]
    by = texts.groupBy("source").agg(*counts, *left, F.count("*").alias("n"), F.sum((~F.col("sentence") | F.col("closing")).cast("long")).alias("n_ended"))
    names = [c for c in by.columns if c != "source"]
    # sources are as many as their names, not as the documents; all together stand in for a source with few pairs
    every = by.agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    both = by.crossJoin(F.broadcast(every))  # one row

    def reach(one: str, many: str) -> Column:
        def of(prefix: str) -> Column:
            held = F.array(*[F.col(f"{prefix}{many}{i}") for i in range(MOST_ENDS + 1)])
            total = F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x)
            upto = F.filter(F.sequence(F.lit(1), F.lit(MOST_ENDS + 1)), lambda i: F.aggregate(F.slice(held, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x) >= REACH_SHARE * total)
            opened = total + F.col(f"{prefix}open_{one}")
            closes = total >= CLOSED_SHARE * opened
            return F.when(opened >= PAIRS_LEAST, F.struct(F.when(closes, F.get(upto, F.lit(0)) - 1).alias("reach")))

        return F.coalesce(of(""), of("all_"), F.struct(F.lit(REACH).alias("reach")))["reach"]

    return both.select("source", reach("quote", "quotes").alias("reach_quote"), reach("bracket", "brackets").alias("reach_bracket"), ((F.col("n") < ENDED_LEAST) | (F.col("n_ended") >= ENDED_SHARE * F.col("n"))).alias("ends_texts"))


def judged(documents: DataFrame) -> DataFrame:
    """``doc_id, source, cut`` for every document; without a text it is not cut."""
    s = ends(documents)
    heads = _small(cut_lineage(closing_heads(s).withColumn("_closing", F.lit(True))))
    s = s.join(heads, "head", "left").withColumn("closing", F.col("closing") | (F.coalesce("_closing", F.lit(False)) & ~F.col("hanging") & F.col("short")))
    habits = _small(cut_lineage(pair_habits(s).withColumnRenamed("source", "_s")))
    s = s.join(habits, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    for unit, size in (("chars", F.col("n_chars")), ("bytes", _byte_size())):
        # texts at a limit in characters pile up near some lengths in bytes too
        rest = s if unit == "chars" else s.where(F.col("_chars").isNull())
        of = _small(cut_lineage(field_limits(rest).where(F.col("unit") == unit).select(F.col("source").alias("_s"), F.col("size").alias(f"_{unit}"))))
        s = s.join(of, F.col("source").eqNullSafe(F.col("_s")) & (size == F.col(f"_{unit}")), "left").drop("_s")
    at_limit = F.col("_chars").isNotNull() | F.col("_bytes").isNotNull()
    within = (F.col("quote") <= F.col("reach_quote")) | (F.col("bracket") <= F.col("reach_bracket"))
    cut = (
        F.col("escape")
        | F.col("formula")
        | F.coalesce(within, F.lit(False))
        | (at_limit & (F.col("sentence") | F.col("weak") | F.col("quote").isNotNull() | F.col("bracket").isNotNull()))
        | (F.col("sentence") & ~F.col("closing") & F.coalesce("ends_texts", F.lit(True)))
    )
    return s.select("doc_id", "source", F.coalesce(cut, F.lit(False)).alias("cut"))


def cut_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the cut documents."""
    return judged(documents).where("cut").select(F.col("doc_id").cast("bigint").alias("doc_id"))


def cut_rates(documents: DataFrame) -> DataFrame:
    """``source, documents, cut, rate``; documents without a text count as not cut."""
    j = judged(documents).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("cut").cast("long")).alias("cut"))
    return j.select("source", F.col("n").alias("documents"), "cut", (F.col("cut") / F.col("n")).alias("rate"))
