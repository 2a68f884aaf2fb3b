"""Sentence units of texts in any language, as spans of the stored text.

The boundary rules are compiled into a finite transducer.  One regular expression reads a text as symbols
(line ends, end marks, quotation signs, each with what a bounded window around it tells); a table compiled
from the rules holds for every symbol and state the next state and whether a sentence ends there.  States:
*nothing but labels so far*, *inside a sentence*, *inside a quotation of kind k, introduced or not*.

What lies further ahead than the window - whether a formula or a quotation is closed before the line ends -
is told by a second automaton that reads from right to left; formulas and quotations never closed on their
line are plain signs.

Every text is processed as chunks of about ``CHUNK`` code points.  A text of one chunk is walked where it is.
The chunks of a longer text are spread over tasks; each becomes a state-transition function (exit state and
number of cuts by entry state); the functions are composed by a parallel prefix scan in blocks (within
blocks of ``FAN_IN`` chunks side by side, over the blocks, and back), and each chunk then yields the pieces
of its entry state.  Pieces that chunk ends tear are joined by their number, counted through the same scan;
no task ever holds a whole text or all its sentences again.  Chunk ends lie between two letters or figures and
in no label, so every window and every run of signs lies on one side, and the result does not depend on them.

Nulls, empty and blank texts have no sentences.  Characters that draw nothing count as blank at the
ends of a sentence and are looked through inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .canonical import LOOKALIKES, RANGES, _fold_char

CHUNK = 8192
#: Characters that a rule may look at around a sign, and those a chunk carries on either side.
WINDOW, CONTEXT = 64, 96
#: Chunks composed in one block; a string has at most FAN_IN ** 2 chunks.
FAN_IN = 1024

# Abbreviations that never close a sentence, and those that may.
INNER = "Mr Mrs Ms Messrs Dr Prof Capt Col Gen Lt Sgt Rev Hon Pres Gov Sen Rep St Mt Ft Fig Figs No Nos Vol Vols Ver Dept Sec Sect Ch Chap Art Eq Ex Exs Ed Eds Tab Ref Refs pp p ed eds vs cf eg ie approx incl excl viz al resp ca env z.B d.h bzw c.-à-d p.ex М М-р г-н г-жа т.е т.к т.н напр см".split()
CLOSING = "a.m p.m A.M P.M etc Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Inc Ltd Co Corp Jr Sr Ph.D M.D B.A M.A U.S U.K U.N B.C A.D Ave Rd Blvd usw т.д т.п др г гг".split()
MARKS = ".。!?؟۔।॥።։‼⁇⁈⁉\u302a჻។៕။༎᙮"
#: Quotation kinds: opening sign, closing sign.  The last kind is a title: words always go on after it.
QUOTES = (("“", "”"), ("「", "」"), ("『", "』"), ("«", "»"), ("„", "“"), ("‘", "’"), ('"', '"'), ("《", "》"), ("〈", "〉"))
TITLES = (7, 8)
CLOSERS = "”’」』》〉»)]】）］}"

LABELS, INSIDE = 0, 1
N_STATES = 2 + 2 * len(QUOTES)


_CJK = "⺀-⿿\u3040-ヿ㐀-鿿가-\ud7af豈-\ufaff\U00020000-\U0003ffff"
_SCAN = re.compile(rf"\.{{2,}}|\.(?![0-9A-Za-z])|[\n$“”‘’「」『』«»„\"《》〈〉{re.escape(MARKS[1:])}]")
_RUN = re.compile(f"[{re.escape(MARKS)}]+")
#: What may stand before the first words of a sentence without being one.
_LABEL = re.compile(
    r"""\s*(?:[\[(【](?=[^\])】\n]{0,40}\d)[^\])】\n]{1,40}[\])】] | Q\d[\d-]{0,12}: | 例\s?\d{1,6} | 第?\d{1,3}[.、)](?!\d)
      | [A-H][.、](?=\S) | (?:解|析|分析|答|解答|证明|Solution|Answer): )\s*""",
    re.X,
)
_INNER_SET, _CLOSING_SET = frozenset(INNER) | {"e.g", "i.e", "E.g", "I.e"}, frozenset(CLOSING)
_STARTS_NEW = re.compile(rf"""["“”’)\]»]*(?:\s+["“‘«„(\[]*(?:[^\W\d_a-zß-öø-ÿа-яё])|\s*\n|\s*\Z|[{_CJK}])""")
_AFTER_DOT = re.compile(r"[^\W_]")
_CJK_RE = re.compile(f"[{_CJK}]")
_GOES_ON = re.compile(r"\s*(?:[a-zß-öø-ÿа-яё]|[,、;:,;:.。!?…)\]】—–-])")
_NEW_WORD = re.compile(rf"\s*(?:[^\W_{_CJK}])|\s+[\[(\"“«]|\s*\Z|\s*\n")
_INTRODUCED = re.compile(r"[,:]\s*\Z")
_INITIAL_NEXT = re.compile(r"\s+[^\W\d_]")
_ANSWER_BEFORE = re.compile(r"(?:choose|pick|select|answer|is|are|option|[::选为是])\s*\Z", re.I)

#: German ordinal numbers: the point after a figure does not end the sentence.
_ORDINAL = re.compile(r"(?<![^\W\d_])(?:[Aa]m|[Vv]om|[Bb]is|[Zz]um|[Zz]ur|[Dd]e[rnm]|[Dd]ie|[Dd]as|[Ii]m)\s\d{1,2}\Z")
_LOOKALIKE = {ord(a): b for x, y in LOOKALIKES.values() for a, b in zip(x, y)}

_fold: dict[int, str] = {}
for _lo, _hi in RANGES:
    for _cp in range(_lo, _hi):
        if not 0xD800 <= _cp < 0xE000 and len(_f := _fold_char(chr(_cp))) == 1 and ord(_f) != _cp:
            _fold[_cp] = _f
for _c in "".join(a for a, _ in LOOKALIKES.values()):  # letters of another script are letters here
    _fold.pop(ord(_c), None)
_fold |= {ord("。"): "。", ord("｡"): "。", 0x0B: "\n", 0x0C: "\n", 0x0D: "\n", 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
#: What draws nothing becomes U+0000, to be taken out.
_fold |= {cp: "\0" for lo, hi in RANGES for cp in range(lo, hi) if not 0xD800 <= cp < 0xE000 and _fold_char(chr(cp)) == ""}


def _clean(text: str) -> tuple[str, list[int] | None]:
    """The text as the rules see it, and the place of each of its characters in the stored text."""
    text = text.translate(_fold)
    if "\0" not in text:
        return text, None
    at = [i for i, c in enumerate(text) if c != "\0"]
    return text.replace("\0", ""), at


def _kinds(sign: str) -> tuple[int, int]:
    o = next((k for k, q in enumerate(QUOTES) if q[0] == sign), -1)
    c = next((k for k, q in enumerate(QUOTES) if q[1] == sign), -1)
    return o, c


_SIGN = {s: _kinds(s) for q in QUOTES for s in q}


# --- the transducer -------------------------------------------------------------------------------------

# Symbols: a line end, an end mark, and quotation signs with what the windows tell about them.
LINE, MARK, PLAIN = 0, 1, 2
_SYMBOLS: dict[tuple, int] = {}


def _compile() -> list[list[int]]:
    """The table: for every symbol and state twice the next state, plus one if a sentence ends."""
    table = [[2 * INSIDE] * N_STATES for _ in range(3)]
    table[LINE] = [2 * LABELS] + [2 * LABELS + 1] * (N_STATES - 1)
    table[MARK] = [2 * LABELS + 1] * 2 + [2 * q for q in range(2, N_STATES)]
    table[PLAIN] = [2 * INSIDE] * 2 + [2 * q for q in range(2, N_STATES)]
    for sign, (opens, closes) in _SIGN.items():
        for introduced in (False, True):
            for closed_later in (False, True):
                for ended in (False, True):
                    for after in (GOES_ON, NEW_WORD, OTHER):
                        row = list(table[PLAIN])
                        if opens >= 0 and closed_later:
                            row[LABELS] = row[INSIDE] = 2 * (2 + 2 * opens + introduced)
                        if closes >= 0:
                            for was_introduced in (0, 1):
                                cut = ended and closes not in TITLES and after != GOES_ON and (was_introduced or after == NEW_WORD)
                                row[2 + 2 * closes + was_introduced] = 2 * LABELS + 1 if cut else 2 * INSIDE
                        _SYMBOLS[sign, introduced, closed_later, ended, after] = len(table)
                        table.append(row)
    return table


#: What follows a closing sign.
GOES_ON, NEW_WORD, OTHER = 0, 1, 2
_TABLE = _compile()


def _is_end(s: str, a: int, b: int) -> bool:
    """The point ``s[a:b]`` ends a sentence, by the windows around it."""
    nxt = s[b] if b < len(s) else " "
    if nxt.isalnum() and not _CJK_RE.match(nxt):
        return False
    j, least = a, max(0, a - WINDOW)
    while j > least and (s[j - 1].isalpha() or s[j - 1] == ".") and not _CJK_RE.match(s[j - 1]):
        j -= 1
    word = s[j:a]
    if not word.isascii():
        word = word.translate(_LOOKALIKE)
    if word and (j == 0 or s[j - 1] not in "'’"):
        if word in _INNER_SET:
            return False
        if word in _CLOSING_SET or ("." in word and all(len(x) == 1 for x in word.split("."))):
            return bool(_STARTS_NEW.match(s, b, b + WINDOW))
        if len(word) == 1 and _GOES_ON.match(s, b, b + WINDOW):
            return False
        return not (len(word) == 1 and word.isupper() and nxt.isspace() and _INITIAL_NEXT.match(s, b, b + WINDOW) and not _ANSWER_BEFORE.search(s, max(0, j - 12), j))
    return not (not word and nxt.isspace() and _ORDINAL.search(s, max(0, a - 10), a))


class Ahead:
    """What the automaton from the right holds at a place: a ``$`` follows on the line, and the kinds of
    quotations that are closed on it (bits); and, from the left, whether a ``$`` is open."""

    __slots__ = ("dollar", "kinds", "inside")

    def __init__(self, dollar: bool = False, kinds: int = 0, inside: bool = False) -> None:
        self.dollar, self.kinds, self.inside = dollar, kinds, inside


def _is_sign(s: str, a: int) -> bool:
    """A quotation sign and no apostrophe."""
    if s[a] == "’":
        return not (0 < a and s[a - 1].isalpha() and a + 1 < len(s) and s[a + 1].isalpha())
    return not (s[a] == "‘" and 0 < a and s[a - 1].isalpha() and not _CJK_RE.match(s[a - 1]))


def _past_formula(s: str, a: int, hi: int, ahead: Ahead) -> int | None:
    """The end of the formula that is open at ``a``, ``hi`` if it goes on there, or None if it is none."""
    line = s.find("\n", a, hi)
    end = s.find("$", a, line if line >= 0 else hi)
    if end >= 0:
        return end + 1
    return hi if line < 0 and ahead.dollar else None


def symbols(s: str, lo: int, hi: int, ahead: Ahead) -> list[tuple[int, int, int]]:
    """The symbols that begin in ``s[lo:hi]``: (symbol, place, place of the cut it may make).

    ``ahead`` tells what holds at ``hi`` (and ``inside`` what holds at ``lo``).
    """
    raw: list[list] = []
    skip = lo
    if ahead.inside:
        skip = _past_formula(s, lo, hi, ahead) or lo
    n = len(s)
    for m in _SCAN.finditer(s, lo, hi):
        a = m.start()
        if a < skip:
            continue
        c = s[a]
        if c == ".":
            b = m.end()
            if b - a > 1:
                skip = b
                if b < n and s[b] in MARKS:  # "...?"
                    skip = b = _RUN.match(s, b).end()
                    raw.append([MARK, a, b])
                continue
            if not _is_end(s, a, b):
                continue
            if b < n and s[b] in MARKS:
                b = _RUN.match(s, a).end()
            raw.append([MARK, a, b])
            skip = b
        elif c == "\n":
            raw.append([LINE, a, a + 1])
        elif c == "$":
            if a + 1 < n and s[a + 1] != "$":
                skip = _past_formula(s, a + 1, hi, ahead) or a + 1
        elif c in _SIGN:
            if _is_sign(s, a):
                raw.append([c, a, a + 1])
        else:
            b = _RUN.match(s, a).end()
            raw.append([MARK, a, b])
            skip = b
    # from right to left: which quotations are closed before the line ends
    kinds = ahead.kinds
    for i in range(len(raw) - 1, -1, -1):
        what, a, b = raw[i]
        if what == LINE:
            kinds = 0
            continue
        while b < n and s[b] in CLOSERS:
            b += 1
        raw[i][2] = b
        if what != MARK:
            opens, closes = _SIGN[what]
            later = opens >= 0 and bool(kinds >> opens & 1)
            ended = closes >= 0 and i > 0 and raw[i - 1][0] == MARK and not s[raw[i - 1][2] : a].strip()
            after = OTHER
            if ended:
                after = GOES_ON if _GOES_ON.match(s, b, b + WINDOW) else NEW_WORD if _NEW_WORD.match(s, b, b + WINDOW) else OTHER
            introduced = later and bool(_INTRODUCED.search(s, max(0, a - 4), a))
            raw[i][0] = _SYMBOLS[what, introduced, later, ended, after]
            if closes >= 0:
                kinds |= 1 << closes
    return raw


def run(s: str, found: list, state: int, lo: int, hi: int) -> tuple[int, list[int]]:
    """The transducer over the symbols of ``s[lo:hi]``: exit state and cuts."""
    cuts: list[int] = []
    here = lo
    table = _TABLE
    for symbol, a, b in found:
        if a < here:
            continue
        if state == LABELS:
            while here < a and (m := _LABEL.match(s, here)):
                here = m.end()
            if a < here:
                continue
            if symbol != LINE or s[here:a].strip():
                state = INSIDE
        step = table[symbol][state]
        state = step >> 1
        if step & 1:
            cuts.append(b)
            here = b
        elif a >= here:
            here = a + 1
    if state == LABELS:  # what stands after the last symbol decides whether the labels were left
        while m := _LABEL.match(s, here):
            if m.end() > hi:
                break
            here = m.end()
        if s[here:hi].strip():
            state = INSIDE
    return state, cuts


def _pieces(s: str, cuts: list[int], lo: int, hi: int, at: list[int] | None) -> list[tuple[int, int] | None]:
    """What is drawn between the cuts of ``s[lo:hi]``, in stored places (counted from ``at``, else from ``lo``)."""
    out, start = [], lo
    for cut in [*cuts, hi]:
        piece = s[start:cut]
        body = piece.strip()
        if body:
            a = start + len(piece) - len(piece.lstrip()) - lo
            b = a + len(body)
            out.append((at[a], at[b - 1] + 1) if at else (a, b))
        else:
            out.append(None)
        start = cut
    return out


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text of one chunk."""
    if not text:
        return []
    s, at = _clean(text)
    n = len(s)
    return [p for p in _pieces(s, run(s, symbols(s, 0, n, Ahead()), LABELS, 0, n)[1], 0, n, at) if p]


_SPANS = T.ArrayType(T.StructType([T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType())]))
_SPANS_PA = pa.list_(pa.struct([("start_at", pa.int32()), ("end_at", pa.int32())]))


@arrow_udf(T.ArrayType(_SPANS))
def _spans_of_items(items: pa.Array) -> pa.Array:
    """Spans of each text of a list."""
    flat = items.flatten().to_pylist()
    spans = [sentence_spans(t) for t in flat]
    lengths = [len(x) for x in spans]
    offsets = [0]
    for x in lengths:
        offsets.append(offsets[-1] + x)
    pairs = [p for x in spans for p in x]
    inner = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32())], ["start_at", "end_at"]))
    sizes = items.value_lengths().fill_null(0).to_pylist()
    outer = [0]
    for x in sizes:
        outer.append(outer[-1] + x)
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)


# --- long texts -----------------------------------------------------------------------------------------

_AHEAD = re.compile("[\n$" + "".join(sorted({c for _, c in QUOTES})) + "]")


def _safe_end(s: str, at: int) -> int:
    """The first place from ``at`` on between two letters or figures and in no label; the end if there is none."""
    n = len(s)
    while at < n:
        if s[at - 1].isalnum() and s[at].isalnum() and not any((m := _LABEL.match(s, p)) and m.end() > at for p in range(max(0, at - 60), at)):
            return at
        at += 1
    return n


def split_chunks(text: str, chunk: int = CHUNK) -> list[dict]:
    """Chunks of the cleaned text with their context, the stored places of their characters and what holds ahead of them."""
    s, at = _clean(text)
    n = len(s)
    ends = [0]
    while ends[-1] < n:
        ends.append(_safe_end(s, ends[-1] + chunk))
    # left to right: is a "$" open at each chunk's start; signs within formulas count for nothing
    signs = [(m.start(), m[0]) for m in _AHEAD.finditer(s)]
    last_on_line, dollar = {}, False
    for i in range(len(signs) - 1, -1, -1):
        if signs[i][1] == "\n":
            dollar = False
        elif signs[i][1] == "$":
            last_on_line[i] = not dollar
            dollar = True
    inside, opened, kept = [], False, []
    k = 0
    for i, (place, c) in enumerate(signs):
        while k < len(ends) - 1 and ends[k] <= place:
            inside.append(opened)
            k += 1
        if c == "\n":
            opened = False
        elif c == "$":
            if opened:
                opened = False
            elif place + 1 < n and s[place + 1] != "$" and not last_on_line[i]:
                opened = True
        kept.append(not opened or c == "$")
    inside += [opened] * (len(ends) - 1 - len(inside))
    # right to left: what follows each chunk on its last line
    ahead: list[tuple[bool, int]] = []
    dollar, kinds, i = False, 0, len(signs) - 1
    for end in reversed(ends[1:]):
        while i >= 0 and signs[i][0] >= end:
            place, c = signs[i]
            if c == "\n":
                dollar, kinds = False, 0
            elif c == "$":
                dollar = True
            elif kept[i] and _is_sign(s, place):
                kinds |= 1 << _SIGN[c][1]
            i -= 1
        ahead.append((dollar, kinds))
    ahead.reverse()
    out = []
    for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
        left, right = max(0, lo - CONTEXT), min(n, hi + CONTEXT)
        out.append({"k": k, "lo": lo - left, "hi": hi - left, "body": s[left:right], "base": lo, "at": at[lo:hi] if at else None, "inside": inside[k], "dollar": ahead[k][0], "kinds": ahead[k][1]})
    return out


_CHUNK = {
    "k": (T.IntegerType(), pa.int32()), "lo": (T.IntegerType(), pa.int32()), "hi": (T.IntegerType(), pa.int32()), "body": (T.StringType(), pa.string()), "base": (T.IntegerType(), pa.int32()),
    "at": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "inside": (T.BooleanType(), pa.bool_()), "dollar": (T.BooleanType(), pa.bool_()), "kinds": (T.IntegerType(), pa.int32()),
}
_CHUNKS = T.ArrayType(T.StructType([T.StructField(k, v) for k, (v, _) in _CHUNK.items()]))
_CHUNKS_PA = pa.list_(pa.struct([(k, v) for k, (_, v) in _CHUNK.items()]))


def _symbols_of(c: dict) -> list:
    return symbols(c["body"], c["lo"], c["hi"], Ahead(c["dollar"], c["kinds"], c["inside"]))


def chunk_function(c: dict) -> tuple[list[int], list[int]]:
    """A chunk as a state-transition function: exit state and number of cuts by entry state."""
    found = _symbols_of(c)
    to, n = [], []
    for q in range(N_STATES):
        state, cuts = run(c["body"], found, q, c["lo"], c["hi"])
        to.append(state)
        n.append(len(cuts))
    return to, n


def compose(functions: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """The composition of functions in order; associative."""
    to, n = list(range(N_STATES)), [0] * N_STATES
    for f, cuts in functions:
        n = [x + cuts[q] for x, q in zip(n, to)]
        to = [f[q] for q in to]
    return to, n


def chunk_pieces(c: dict, state: int, before: int) -> list[tuple[int, int, int]]:
    """``(number of the sentence, start, end)`` of what a chunk holds of each sentence, entered in a state
    after so many cuts."""
    cuts = run(c["body"], _symbols_of(c), state, c["lo"], c["hi"])[1]
    add = 0 if c["at"] else c["base"]
    return [(before + i, p[0] + add, p[1] + add) for i, p in enumerate(_pieces(c["body"], cuts, c["lo"], c["hi"], c["at"])) if p]


_INTS = T.ArrayType(T.IntegerType())
_LONGS = T.ArrayType(T.LongType())
_FUNCTION = T.StructType([T.StructField("to", _INTS), T.StructField("n", _LONGS)])
_FUNCTION_PA = pa.struct([("to", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
_ENTRIES = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("before", T.LongType())]))
_ENTRIES_PA = pa.list_(pa.struct([("k", pa.int32()), ("q", pa.int32()), ("before", pa.int64())]))
_PIECES = T.ArrayType(T.StructType([T.StructField("number", T.LongType()), T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType())]))
_PIECES_PA = pa.list_(pa.struct([("number", pa.int64()), ("start_at", pa.int32()), ("end_at", pa.int32())]))


@arrow_udf(_FUNCTION)
def _function(chunks: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("to", "n"), chunk_function(c))) for c in chunks.to_pylist()], _FUNCTION_PA)


@arrow_udf(_FUNCTION)
def _composed(functions: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("to", "n"), compose([(f["to"], f["n"]) for f in fs]))) for fs in functions.to_pylist()], _FUNCTION_PA)


@arrow_udf(_ENTRIES)
def _entered(functions: pa.Array, states: pa.Array, before: pa.Array) -> pa.Array:
    """The state in which each of some functions in order is entered, and the cuts before it."""
    out = []
    for fs, q, n in zip(functions.to_pylist(), states.to_pylist(), before.to_pylist()):
        own = []
        for f in fs:
            own.append({"k": f["k"], "q": q, "before": n})
            q, n = f["to"][q], n + f["n"][q]
        out.append(own)
    return pa.array(out, _ENTRIES_PA)


@arrow_udf(_PIECES)
def _pieces_of(chunks: pa.Array, states: pa.Array, before: pa.Array) -> pa.Array:
    out = [chunk_pieces(*x) for x in zip(chunks.to_pylist(), states.to_pylist(), before.to_pylist())]
    return pa.array([[dict(zip(("number", "start_at", "end_at"), p)) for p in x] for x in out], _PIECES_PA)


def spread_chunks(texts: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """``keys, k, c``: the chunks of texts, spread so that one huge text occupies many tasks."""

    @arrow_udf(_CHUNKS)
    def chunks(col: pa.Array) -> pa.Array:
        return pa.array([split_chunks(t, chunk) for t in col.to_pylist()], _CHUNKS_PA)

    # a number of partitions is given, for chunks are few bytes but much work and would be put together again
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.select(*keys, F.explode(chunks("text")).alias("c")).select(*keys, F.col("c.k").alias("k"), "c").repartition(n, *keys, "k")


def _long_texts(texts: DataFrame, keys: list[str], chunk: int, fan_in: int = FAN_IN) -> DataFrame:
    """Spans of texts longer than a chunk, by composed chunk functions."""
    parts = spread_chunks(texts, keys, chunk)
    up = parts.select(*keys, "k", _function("c").alias("f"))
    # groups hold at most FAN_IN functions, of a few hundred bytes each
    listed = F.sort_array(F.collect_list(F.struct("k", "f.to", "f.n"))).alias("fs")
    blocks = up.groupBy(*keys, F.expr(f"k div {fan_in}").cast("int").alias("block")).agg(listed)
    tops = blocks.select(*keys, F.col("block").alias("k"), _composed("fs").alias("f")).groupBy(*keys).agg(listed)
    at_blocks = tops.select(*keys, F.explode(_entered("fs", F.lit(LABELS), F.lit(0).cast("long"))).alias("e")).select(*keys, F.col("e.k").alias("block"), F.col("e.q").alias("q"), F.col("e.before").alias("before"))
    at_chunks = blocks.join(at_blocks, [*keys, "block"]).select(*keys, F.explode(_entered("fs", "q", "before")).alias("e")).select(*keys, "e.*")
    pieces = parts.join(at_chunks, [*keys, "k"]).select(*keys, F.explode(_pieces_of("c", "q", "before")).alias("p")).select(*keys, "p.*")
    return pieces.groupBy(*keys, "number").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at")).drop("number")


def sentences(questions: DataFrame, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """``row_id, field, item, start_at, end_at`` for every sentence of the descriptions and solutions of questions."""
    q = F.col("query")
    none = F.array().cast("array<string>")
    items = F.concat(F.array(q["description"]), F.coalesce(q["solutions"], none))
    rows = questions.select("row_id", items.alias("items"))
    short = rows.select("row_id", F.transform("items", lambda t: F.when(F.length(t) <= chunk, t)).alias("items"))
    short = short.select("row_id", F.posexplode(_spans_of_items("items")).alias("n", "spans")).select("row_id", "n", F.explode("spans").alias("s")).select("row_id", "n", "s.*")
    long = rows.where(F.exists("items", lambda t: F.length(t) > chunk)).select("row_id", F.posexplode("items").alias("n", "text")).where(F.length("text") > chunk)
    out = short.unionByName(_long_texts(long, ["row_id", "n"], chunk, fan_in))
    return out.select("row_id", F.when(F.col("n") == 0, "description").otherwise("solutions").alias("field"), (F.col("n") - F.when(F.col("n") == 0, 1).otherwise(1)).cast("int").alias("item"), "start_at", "end_at")


def iter_sentences(text: str) -> Iterator[str]:
    """The sentences of one text themselves."""
    for a, b in sentence_spans(text):
        yield text[a:b]
