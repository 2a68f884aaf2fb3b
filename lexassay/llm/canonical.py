"""One canonical form for texts that are drawn alike but coded differently.

The form is ``NFC(fold(NFD(text)))`` where ``fold`` maps single code points:

* width forms (``<wide>``, ``<narrow>``, ``<noBreak>`` decompositions) to their plain form;
* characters that draw nothing (format controls, variation selectors, fillers) to nothing;
* every kind of blank to U+0020 and every line end to U+000A (a tab stays a tab);
* characters coded twice (Kangxi and CJK radicals, Arabic presentation forms, a few
  compatibility letters and signs) to the ordinary one;
* letters of another script that are drawn like a Latin letter to the Latin letter.

Case, accents, raised and circled figures, similar ideographs and the number of blanks are kept.

Only *unstable* segments are normalised.  A code point is

* ``NO`` if its canonical form differs from itself (quick check "No"),
* ``MAYBE`` if it can combine with what stands before it (quick check "Maybe": combining marks and
  second halves of composites, or code points folded to such).

A text without either is returned as it is.  Otherwise each run of unstable code points, widened to
the left by the one starter it may combine with, is normalised alone and spliced back; runs repeat
a great deal and are kept in a bounded cache.

Null gives null; an empty text stays empty; texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexassay.functions.lineage import cut_lineage

# Letters drawn like a Latin letter, by script (public Unicode confusables data).  The dotless i,
# drawn otherwise than the i, and letters that only some fonts draw alike stay as they are.
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХаеѕіјорсухԛԝһԁԌԚԜ", "ABESIJKMHOPCTXaesijopcyxqwhdGQW"),
    "Cyrillic, one sign": ("ӀҮ", "lY"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνϲϳϹͿ", "ABEZHIKMNOPTYXopvcjCJ"),
    "Armenian": ("Օօհոսց", "Oohnug"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZWVSLCPKB"),
    "Coptic": ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Latin, coded twice": ("ɡ", "g"),
    "Signs": ("‐‑−˗∶∕⁄∼⋅∙‧", "----://~···"),
}

# CJK radicals without a Unicode decomposition and their ideographs
# (public EquivalentUnifiedIdeograph data).
RADICALS = (
    "⺁⺄⺅⺆⺈⺉⺊⺋⺍⺎⺏⺐⺑⺒⺓⺔⺖⺗⺘⺙⺛⺜⺝⺞⺟⺠⺡⺢⺣⺤⺦⺨⺩⺪⺫⺬⺭⺯⺰⺱⺲⺹⺺⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻊⻋⻌⻍⻏⻐⻑⻒⻓⻔⻖⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
    "厂乙亻冂刀刂卜㔾小兀尣尢尢巳幺彑忄㣺扌攵旡日月歺母民氵氺灬爫丬犭王疋目示礻糸纟罓罒耂肀臼艹艹艹虎衤覀西见角讠贝足车辶辶阝钅長镸长门阝青韦页风飞食飠飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜龟",
)

INVISIBLE_EXTRA = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
COMPAT_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Names of <compat> characters that are drawn like their decomposition.
COMPAT_NAMES = re.compile(
    r"^(KANGXI RADICAL|CJK RADICAL|MICRO SIGN|DEGREE (CELSIUS|FAHRENHEIT)|(SMALL )?ROMAN NUMERAL"
    r"|LATIN SMALL LIGATURE (FF|FI|FL|FFI|FFL)$|LATIN (CAPITAL|SMALL) LIGATURE IJ|LATIN (CAPITAL|SMALL) LETTER (LJ|NJ|DZ)"
    r"|DOUBLE (EXCLAMATION|QUESTION) MARK|TWO DOT LEADER|HANGUL LETTER)"
)
LINE_ENDS = "\x0b\x0c\r\x85\u2028\u2029"
#: Code points outside the ideograph and syllable blocks that can be unstable.
RANGES = ((0x00, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x10000), (0x10000, 0x12000), (0x1B000, 0x1D200), (0x1F100, 0x1F200), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


def _fold_char(c: str) -> str:
    cat = unicodedata.category(c)
    if c in _FIXED:
        return _FIXED[c]
    if (cat == "Cf" and not 0x600 <= ord(c) <= 0x605 and c not in "\u06dd\u070f\u08e2\U000110bd\U000110cd") or c in INVISIBLE_EXTRA:
        return ""
    if 0xFE00 <= ord(c) <= 0xFE0F or 0xE0000 <= ord(c) <= 0xE0FFF:
        return ""
    if cat == "Cc" and c not in "\t\n":
        return ""
    if cat == "Zs" and c != "\u1680":
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith("<"):
        tag, *cps = d.split()
        if tag in COMPAT_TAGS or (tag == "<compat>" and COMPAT_NAMES.match(unicodedata.name(c, ""))):
            return "".join(_fold_char(x) for x in unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in cps)))
    return c


_FIXED: dict[str, str] = {c: "\n" for c in LINE_ENDS}
for _a, _b in [*LOOKALIKES.values(), RADICALS]:
    _FIXED |= dict(zip(_a, _b, strict=True))


def canonical_reference(text: str) -> str:
    """The definition, applied to the whole text at once; what the quick-check path must equal."""
    text = text.replace("\r\n", "\n")
    return unicodedata.normalize("NFC", "".join(map(_fold_char, unicodedata.normalize("NFD", text))))


def _char_class(cps: list[int]) -> str:
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\U{cps[i]:08x}" + (f"-\\U{cps[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(1)
def _tables() -> list[tuple[re.Pattern, re.Pattern, re.Pattern]]:
    """Patterns: a MAYBE code point; a run of NO code points; an unstable segment with its boundary context.
    First for texts of the basic plane, then for all."""
    seconds = {c for a, b in RANGES for c in range(a, b) if not 0xD800 <= c < 0xE000 and (d := unicodedata.decomposition(chr(c)).split()) and len(d) == 2 and d[0][0] != "<" for c in [int(d[1], 16)]}
    no, maybe = [], []
    for a, b in RANGES:
        for cp in range(a, b):
            if 0xD800 <= cp < 0xE000:
                continue
            c = chr(cp)
            f = _fold_char(c)
            if unicodedata.combining(c) or cp in seconds or 0x1161 <= cp <= 0x1175 or 0x11A8 <= cp <= 0x11C2 or (f and f != c and (unicodedata.combining(f[0]) or ord(f[0]) in seconds or 0x1161 <= ord(f[0]) <= 0x11C2)):
                maybe.append(cp)
            elif canonical_reference(c) != c:
                no.append(cp)
    out = []
    for top in (0xFFFF, 0x10FFFF):
        n, m = (_char_class([c for c in x if c <= top]) for x in (no, maybe))
        out.append((re.compile(f"[{m}]"), re.compile(f"[{n}]+"), re.compile(f"[^{n}{m}]?[{n}{m}]*[{m}][{n}{m}]*|[{n}]+")))
    return out


class _Segments(dict):
    """Canonical forms of segments seen, emptied when it grows beyond a bound."""

    LIMIT = 50_000

    def __missing__(self, segment: str) -> str:
        if len(self) >= self.LIMIT:
            self.clear()
        form = canonical_reference(segment)
        if len(segment) <= 16:
            self[segment] = form
        return form


_segments = _Segments()


def _splice(match: re.Match) -> str:
    return _segments[match[0]]


def canonical(text: str | None) -> str | None:
    """The canonical form of one text."""
    if not text or text.isascii() and text.isprintable():
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    maybe, no, segment = _tables()[bool(_ASTRAL.search(text))]
    return (segment if maybe.search(text) else no).sub(_splice, text)


@arrow_udf(T.StringType())
def _changed(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        c = canonical(t)
        out.append(None if c == t else c)
    return pa.array(out, pa.string())


def canonical_text(col: Column | str) -> Column:
    """Canonical form of a string column.  Only changed texts travel back from Python."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_changed(col), col)


_DRAWN = re.compile(r"\S")
_DIGESTS = T.StructType([T.StructField("look", T.BinaryType()), T.StructField("code", T.BinaryType())])


def _digest(items: list[str]) -> bytes:
    """Digest of a list of texts: their number and each with its length, so that item ends count."""
    h = hashlib.sha256(len(items).to_bytes(8, "big"))
    for t in items:
        raw = t.encode("utf-8", "surrogatepass")
        h.update(len(raw).to_bytes(8, "big"))
        h.update(raw)
    return h.digest()[:16]


@arrow_udf(_DIGESTS)
def _looks(columns: pa.Array) -> pa.Array:
    looks, codes = [], []
    for items in columns.to_pylist():
        raw = [x or "" for x in items or []]
        forms = [canonical(x) for x in raw]
        drawn = any(map(_DRAWN.search, forms))
        looks.append(_digest(forms) if drawn else None)
        codes.append(_digest(raw) if drawn else None)
    return pa.StructArray.from_arrays([pa.array(looks, pa.binary()), pa.array(codes, pa.binary())], ["look", "code"])


#: Rows of one spelling that are paired in one block.
BLOCK = 2048


def same_looking_pairs(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of rows whose texts are drawn the same but coded differently.

    ``texts`` has ``row_id, field, scope, items``: lists of texts are compared item by item within equal
    ``(field, scope)``; each item is normalised by itself, so lists of different length never meet.
    Only digests are shuffled.  Classes with one spelling are dropped; of the others the *spellings* are
    paired, each once whatever its copies, and only then do the rows of two differing spellings meet: equal
    copies are never compared, and no more rows are made than the result holds.  The rows of a spelling with
    many copies are split into blocks of about ``block``, and every pair of blocks is a key of its own.
    Null texts and texts that show nothing give no pair; equal rows given twice count once.
    """
    form = texts.select("row_id", "field", "scope", _looks("items").alias("d")).where("d.look is not null")
    within = F.concat_ws("\x00", F.col("field"), F.coalesce(F.col("scope").cast("string"), F.lit("")), F.hex("d.look"))
    keyed = form.select("row_id", "field", F.unhex(F.substring(F.sha2(within, 256), 1, 32)).alias("look"), F.col("d.code").alias("code"))
    # the texts are read and normalised once; what follows works on the digests, a hundredth of their size
    keyed = cut_lineage(keyed)
    mixed = keyed.groupBy("look").agg(F.min("code").alias("_x"), F.max("code").alias("_y")).where("_x <> _y").select("look")
    rows = cut_lineage(keyed.join(mixed, "look", "left_semi").distinct())  # what is left is of the size of the result
    spellings = rows.groupBy("look", "field", "code").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    a, b = spellings.alias("a"), spellings.alias("b")
    differing = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.code") < F.col("b.code")))
    differing = differing.select(F.col("a.look").alias("look"), F.col("a.field").alias("field"), F.col("a.code").alias("code_a"), F.col("b.code").alias("code_b"), F.explode(F.sequence(F.lit(0), F.col("a.blocks") - 1)).alias("block_a"), F.col("b.blocks").alias("_b"))
    differing = differing.select("look", "field", "code_a", "code_b", "block_a", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("block_b"))
    # a spelling of one block needs no count: only the others are looked up
    many = spellings.where("blocks > 1").select("look", "code", "blocks")
    placed = rows.join(many, ["look", "code"], "left").select("look", "code", "row_id", F.pmod(F.xxhash64("row_id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    left = placed.select("look", F.col("code").alias("code_a"), F.col("block").alias("block_a"), F.col("row_id").alias("_a"))
    right = placed.select("look", F.col("code").alias("code_b"), F.col("block").alias("block_b"), F.col("row_id").alias("_b"))
    j = differing.join(left, ["look", "code_a", "block_a"]).join(right, ["look", "code_b", "block_b"]).where("_a <> _b")
    return j.select(F.least("_a", "_b").alias("row_a"), F.greatest("_a", "_b").alias("row_b"), "field")


def changed_forms(texts: DataFrame) -> DataFrame:
    """``row_id, field, item, form``: the canonical form of every text that is not in it already."""
    items = texts.select("row_id", "field", F.posexplode("items").alias("item", "text")).where(F.col("text").isNotNull())
    return items.select("row_id", "field", "item", _changed(F.col("text")).alias("form")).where(F.col("form").isNotNull())


def question_texts(questions: DataFrame) -> DataFrame:
    """The three text fields of questions in long form, as compared by ``p1_found``."""
    q = F.col("query")
    parts = [
        F.struct(F.lit("description").alias("field"), F.lit(None).cast("double").alias("scope"), F.when(q["description"].isNotNull(), F.array(q["description"])).alias("items")),
        F.struct(F.lit("answers").alias("field"), q["_id"].cast("double").alias("scope"), F.when(q["_id"].isNotNull() & q["answers"].isNotNull(), F.array(q["answers"])).alias("items")),
        F.struct(F.lit("solutions").alias("field"), F.lit(None).cast("double").alias("scope"), q["solutions"].alias("items")),
    ]
    return questions.select("row_id", F.explode(F.array(*parts)).alias("t")).select("row_id", "t.*").where(F.size("items") > 0)
