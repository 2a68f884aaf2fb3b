"""Splitting a field that holds several values.

Quoted spans, bracketed pairs, numbers with grouping and fractions are replaced by indexed placeholders
(one private-use character each, counted from U+F0000; for a text that holds such a character itself
they start above its highest one, so none can collide).  What remains is split at the delimiters, whatever their
mixture; placeholders are restored by lookup; the values are exploded with their positions.

Numbered values (``(1)A(2)B``) are split at their numbering, which must count 1, 2, 3, ....  Running prose
is one value unless numbered; it is told by ends of sentences and words of clauses, not by its length.  A JSON list gives its items.  Row-wise, no shuffle.

Nulls and empty texts give no rows; so does a field with fewer than two values.  An empty place between
two values keeps its position.  Fields of any length are split whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexassay.functions.replies import asks_language, bare, declines, fold, is_nothing, language, listed, repeats
from lexassay.functions.text import plain_view

_QUOTED = re.compile(r"(?<![^\s,、;|/#:()\d.①-⑳])(?:\"[^\"\n]*\"|“[^”\n]*”|'[^'\n]*'|‘[^’\n]*’|「[^」\n]*」|『[^』\n]*』)(?=\s*(?:[,、;|/#\t\n(①-⑳\d]|\Z|[\"“'‘「]))")
_PAIR = re.compile(r"[(\[]\s*[-+]?[\d.∞]+\s*[,;]\s*[-+]?[\d.∞+]+\s*[)\]]")
_GROUPED = re.compile(r"(?<![\d.])\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?")
_FRACTION = re.compile(r"\d+\s?/\s?\d+")
_FORMULA = re.compile(r"\$[^$\n]*\$")
_DELIMITER = re.compile(r"\s*(?:##+|[;|\t\n\r]|[,、]|/)[^\S\t\n]*")
_ATOM = re.compile(r"[A-HTa-htfΑ-ΩА-Яа-я√×✓✗]|[ABCDEF]{1,4}|true|false|yes|no|正确|错误|对|错|[-+]?\d[\d.%]*", re.I)
_STYLES = (
    re.compile(r"[(（]\s?(\d{1,4})\s?[)）]"),
    re.compile(r"([①-⑳㉑-㉟㊱-㊿])"),
    re.compile(r"(?:(?<=[\s;,、|/#。.!?])|(?<=\A))(\d{1,4})\s?[.、:)]\s?(?!\d{3})"),
    re.compile(r"第(\d{1,4})[空题问小][空题]?[::]?"),
)
_EDGE = re.compile(r"[\s;,、|/#]+\Z")
_SENTENCE = re.compile(r"[。!?]|[.]\s+[A-Z]|[.]\Z")
_SENTENCE_END = re.compile(r"[。!?.]\Z")
_WORDS = re.compile(r"[A-Za-zÀ-ɏ]{2,}")
_HAN_RUN = re.compile(r"[㐀-鿿]")
_ENCLOSED = re.compile(r"\"(.*)\"|“(.*)”|'(.*)'|‘(.*)’|「(.*)」|『(.*)』", re.S)
#: A phrase, as against a letter, figure or name: so many ideographs or words.  Only next to marks of a sentence
#: does it make a text prose.
PHRASE_HAN, PHRASE_WORDS = 6, 4
_STRONG = re.compile(r"[;|\t\n#/]")
_CLAUSE_WORD = re.compile(r"因为|所以|由于|如果|假设|因此|认为|可知|可得|推断|鉴于|根据|其中|发现|观察到|相比|而不是")


def _trim(s: str, a: int, b: int) -> tuple[int, int]:
    """The span without outer blanks and enclosing quotes."""
    while a < b and s[a].isspace():
        a += 1
    while b > a and s[b - 1].isspace():
        b -= 1
    if b - a >= 2 and (m := _ENCLOSED.fullmatch(s, a, b)):
        return _trim(s, a + 1, b - 1)
    return a, b


def _numbered(s: str) -> list[tuple[int, int]] | None:
    """Spans between markers that count from 1; a missing number leaves an empty place."""
    start = len(s) - len(s.lstrip())
    for style in _STYLES:
        first = style.match(s, start)
        if not first or _figure(first[1]) != 1:
            continue
        marks, want = [(first.start(), first.end())], 2
        for m in style.finditer(s, first.end()):
            n = _figure(m[1])
            if n == want:
                marks.append((m.start(), m.end()))
                want += 1
            elif n == want + 1 and n > 2 and not _later(style, s, m.end(), want):
                marks += [(m.start(), m.start()), (m.start(), m.end())]
                want = n + 1
        if len(marks) > 1:
            ends = [a for a, _ in marks[1:]] + [len(s)]
            out = []
            for (_, a), b in zip(marks, ends):
                e = _EDGE.search(s, a, b)
                out.append((a, e.start() if e else b))
            return out
    return None


def _later(style: re.Pattern, s: str, at: int, n: int) -> bool:
    return any(_figure(m[1]) == n for m in style.finditer(s, at))


def _figure(x: str) -> int:
    """The number of a marker; circled figures stand in three blocks."""
    if x.isdigit() and x.isascii():
        return int(x)
    return ord(x) - (0x245F if x <= "⑳" else 0x3251 - 21 if x <= "㉟" else 0x32B1 - 36)


class _Placeholders:
    """Indexed stand-ins for protected spans, from U+F0000 or above the highest such character of the text.

    Equal spans share one; there are 131 068 for one field, and spans beyond that are split like other text.
    """

    def __init__(self, text: str) -> None:
        self.base = max([0xF0000, *(ord(c) + 1 for c in text if "\U000f0000" <= c <= "\U0010fffd")])
        self.held: list[str] = []
        self.index: dict[str, int] = {}

    def put(self, m: re.Match) -> str:
        span = self.restore(m[0])
        if span not in self.index:
            if self.base + len(self.held) > 0x10FFFD:
                return m[0]
            self.index[span] = len(self.held)
            self.held.append(span)
        return chr(self.base + self.index[span])

    def restore(self, text: str) -> str:
        return "".join([self.held[ord(c) - self.base] if ord(c) >= self.base else c for c in text]) if self.held else text


def _delimited(s: str, groups: bool) -> list[tuple[int, int]]:
    """Spans between delimiters; ``groups``: figures with grouping commas are one number."""
    held = _Placeholders(s)
    masked = s
    for p in (_FORMULA, _QUOTED, _PAIR, *[_GROUPED] * groups, _FRACTION):
        masked = p.sub(held.put, masked)
    pieces, a = [], 0
    for m in _DELIMITER.finditer(masked):
        pieces += [masked[a : m.start()], m[0]]
        a = m.end()
    pieces.append(masked[a:])
    if len(pieces) > 1 and not pieces[-1].strip():
        pieces.pop()  # a closing delimiter opens no place
    out, here = [], 0
    for i, piece in enumerate(pieces):
        end = here + len(held.restore(piece))
        if i % 2 == 0:
            # blanks separate values that are nothing but letters, ticks and figures, or quoted
            parts = piece.split()
            if len(parts) > 1 and all(_ATOM.fullmatch(x) or len(x) == 1 and ord(x) >= held.base for x in parts):
                for m in re.finditer(r"\S+", piece):
                    a = here + len(held.restore(piece[: m.start()]))
                    out.append((a, a + len(held.restore(m[0]))))
            else:
                out.append((here, end))
        here = end
    return out


def _is_phrase(piece: str) -> bool:
    return len(_HAN_RUN.findall(piece)) >= PHRASE_HAN or len(_WORDS.findall(piece)) >= PHRASE_WORDS


def _is_prose(s: str, spans: list[tuple[int, int]]) -> bool:
    """The text between the delimiters is running prose, by its structure and not by its length.

    Quoted pieces are values.  A phrase makes prose of a text that ends a sentence, at its end or inside a
    piece, unless strong delimiters separate whole sentences.  Without any end of a sentence, pieces between
    strong delimiters are values, and pieces between commas unless one is a clause.
    """
    pieces = [p for a, b in spans if (p := s[a:b].strip())]
    if all(_ENCLOSED.fullmatch(p) and _SENTENCE.search(p) is None for p in pieces):
        return False
    strong = bool(_STRONG.search(s))
    bare_pieces = [p.rstrip("\"”’」')") for p in pieces]
    ended = [bool(_SENTENCE_END.search(p)) for p in bare_pieces]
    inside = any(_SENTENCE.search(p[:-1]) and _is_phrase(p) for p in bare_pieces)
    if strong and not inside and all(ended) and len(pieces) > 1:
        return False
    if inside or ended[-1]:
        return any(map(_is_phrase, pieces))
    if strong and not any(ended):
        return False
    return any(map(_is_clause, pieces))


def _is_clause(piece: str) -> bool:
    """Running words: function words of a language, or a word that opens a clause before a phrase."""
    return language(piece, least_han=10**9) is not None or bool(_CLAUSE_WORD.search(piece)) and _is_phrase(piece)


def split_values(text: str | None, expected: int = 0) -> list[tuple[int, str]]:
    """Positions (from 1) and values of a field; empty places are left out.

    ``expected`` is the number of values the prompt asks for, 0 if unknown; it only decides whether
    ``163,155`` is one number or two.
    """
    if not text or text.isspace():
        return []
    items = listed(text)
    if items is not None:
        if len(items) == 1:
            return split_values(items[0], expected) if not items[0].lstrip().startswith("[") else [(1, items[0].strip())]
        out = []
        marks = [_numbered_item(x, i) for i, x in enumerate(items, 1)]
        for i, x in enumerate(items, 1):
            v = marks[i - 1] if all(m is not None for m in marks) else x
            a, b = _trim(v, 0, len(v))
            if b > a:
                out.append((i, v[a:b]))
        return out
    s, at = plain_view(text)
    spans = _numbered(s)
    if spans is None:
        spans = _delimited(s, True)
        if _is_prose(s, spans) or len(spans) == 1 and _SENTENCE.search(s):
            return [(1, text.strip())]
        if expected > len(spans) and "," in s:
            other = _delimited(s, False)
            if len(other) == expected:
                spans = other
        elif expected == 1 and len(spans) > 1 and re.fullmatch(r"\s*\d{1,3}(?:[,，]\d{3})+\s*", s):
            spans = [(0, len(s))]
        # dotted numbering that stands before figures: 1.20;2.35
        if len(spans) > 1 and all(re.match(rf"\s*{i}\s?[.、:)]\s?\S", s[a:b]) for i, (a, b) in enumerate(spans, 1)):
            spans = [(a + re.match(rf"\s*{i}\s?[.、:)]\s?", s[a:b]).end(), b) for i, (a, b) in enumerate(spans, 1)]
    out = []
    for i, (a, b) in enumerate(spans, 1):
        a, b = _trim(s, a, b)
        if b > a:
            out.append((i, text[at[a] : at[b - 1] + 1] if at else text[a:b]))
    return out


def _numbered_item(x: str, i: int) -> str | None:
    s, at = plain_view(x)
    for style in _STYLES:
        m = style.match(s, len(s) - len(s.lstrip()))
        if m and _figure(m[1]) == i:
            return x[at[m.end()] if at and m.end() < len(at) else len(x) if at else m.end() :]
    return None


def is_one_value(text: str, prompt: str | None) -> bool:
    """As a whole nothing, a refusal, a copy of the prompt or in another language than the prompt."""
    items = listed(text)
    whole = "\n".join(items) if items is not None else text
    if is_nothing(whole) or declines(whole):
        return True
    if items is not None and all(is_nothing(x) for x in items):
        return True
    if prompt:
        f, p = fold(whole), fold(prompt)
        if repeats(bare(f), bare(p)):
            return True
        lang = language(f)
        if lang and (own := language(p)) and own != lang and not asks_language(p):
            return True
    return False


_BLANK = re.compile(r"[_＿]{3,}")
_VALUES = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())]))
_VALUES_PA = pa.list_(pa.struct([("pos", pa.int32()), ("value", pa.string())]))


@arrow_udf(_VALUES)
def _values(texts: pa.Array, prompts: pa.Array, stems: pa.Array) -> pa.Array:
    out = []
    for text, prompt, n in zip(texts.to_pylist(), prompts.to_pylist(), stems.to_pylist()):
        blanks = len(_BLANK.findall(prompt)) if prompt else 0
        got = split_values(text, blanks or n or 0)
        if len(got) > 1 and is_one_value(text, prompt):
            got = []
        out.append([{"pos": p, "value": v} for p, v in got] if len(got) > 1 else None)
    return pa.array(out, _VALUES_PA)


def values_of(text: Column, prompt: Column, expected: Column) -> Column:
    """Array of ``(pos, value)`` for a field with at least two values, else null."""
    return _values(text, prompt, expected)


def answer_values(questions: DataFrame) -> DataFrame:
    """``row_id, pos, value``: one row for each of several values in ``query.answers``."""
    q = F.col("query")
    got = questions.where(q["answers"].isNotNull() & (F.length(q["answers"]) > 1)).select("row_id", values_of(q["answers"], q["description"], F.coalesce(F.size(q["stems"]), F.lit(0))).alias("v"))
    return got.select("row_id", F.explode("v").alias("v")).select("row_id", "v.pos", "v.value")
