"""Neutral readings of a text: nothing said, declining words, repetition of another text, language.

Plain functions on strings, used by operators that run them over Arrow batches.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

#: Least shares of a text and of the other one that their longest common subsequence covers.
OF_TEXT, OF_OTHER = 0.85, 0.6

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")


def fold(text: str) -> str:
    """Width forms folded, invisible characters dropped, composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))


def listed(text: str | None) -> list[str] | None:
    """The items if the text is that of a JSON list of texts, else None."""
    if not text or not (t := text.strip()).startswith("[") or not t.endswith("]"):
        return None
    try:
        got = json.loads(t)
    except ValueError:
        return None
    if not isinstance(got, list):
        return None
    out: list[str] = []
    for x in got:
        if isinstance(x, list):
            out += [str(y) if y is not None else "" for y in x]
        else:
            out.append("" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))
    if got and not any(isinstance(x, str | list) or x is None for x in got):
        return None  # an interval such as [3, 5]
    return out


# --- empty ---------------------------------------------------------------------------------------

_NOTHING = re.compile(r"[\s\-–—―‐‑−_~.。·•…⋯,、;:*/|\\#()\[\]{}（）【】]*")
_NOTE = re.compile(
    r"(?:(?:本题|此题|答案|解答|解析|过程|answer|solution)s?\s*(?::|is|was|are)?\s*)?"
    r"(?:略去?|省略|从略|(?:过程|解析|答案|解答|证明)?略|无|暂无|暂缺|空缺|缺|没有|未提供|未给出|待补充?|暂无(?:答案|解答|解析)|无(?:答案|解答|解析)|不详|同上略"
    r"|n\s*/\s*a|n\.a\.?|none|null|nil|nan|omitted|left out|not (?:available|provided|given)|unavailable|missing|tba|tbd|no (?:answer|solution)s?(?: (?:available|provided|given))?)",
    re.I,
)


def is_nothing(text: str | None) -> bool:
    """Nothing visible, only dashes and dots, or a mere note that the text is left out."""
    if not text:
        return True
    t = fold(text)
    if _NOTHING.fullmatch(t):
        return True
    t = re.sub(r"^[\s()\[\]【】<>\"'“”.。:,-]+|[\s()\[\]【】<>\"'“”.。:,!-]+$", "", t)
    return bool(_NOTE.fullmatch(t))


# --- declining words -------------------------------------------------------------------------------

_CLAUSE = re.compile(r"[,，。.;；!！?？\n]+")
_SORRY = re.compile(r"抱歉|对不起|不好意思|遗憾|sorry|afraid|unfortunately|apolog|regret", re.I)
_DECLINING = re.compile(r"恕不|恕我|恕难|(?:不便|不宜|不能|无法|没有办法|没办法|难以|拒绝|暂不|不予|不会|不再).{0,8}(?:答|提供|给出|处理|完成|帮助)|(?:cannot|can not|can't|unable|won't|not able).{0,40}?(?:answer|help|solve|provide|give)|beyond what (?:i|we)|rather not|(?:建议|请).{0,4}(?:咨询|请教|询问|联系)", re.I)


def declines(text: str) -> bool:
    """A short apology or refusal without anything else: at most every third clause says something else."""
    t = fold(text).replace("’", "'")
    if not _DECLINING.search(t) and not _SORRY.search(t):
        return False
    clauses = [c for c in _CLAUSE.split(t) if c.strip()]
    plain = [c for c in clauses if not _DECLINING.search(c) and not _SORRY.search(c)]
    return 3 * len(plain) <= 2 * len(clauses)


# --- repetition ----------------------------------------------------------------------------------------

def bare(text: str) -> str:
    """Letters and figures of a folded text, lower case."""
    return "".join([c for c in text.lower() if c.isalnum()])


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) > len(b):
        a, b = b, a
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & where.get(c, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def repeats(text: str, other: str) -> bool:
    """The bare text repeats the other one, or most of it, and adds next to nothing."""
    if len(text) < 8 or len(text) < OF_OTHER * len(other) or len(other) < OF_TEXT * len(text):
        return False
    common = len(text) if text == other else common_subsequence(text, other)
    return common >= OF_TEXT * len(text) and common >= OF_OTHER * len(other)


# --- language ------------------------------------------------------------------------------------

# Frequent function words by language.
WORDS = {
    "en": "the of and to in is was were that it for with than near this which who but not are be by from at on as have has had they she he we you their so because if when".split(),
    "de": "der die das und ein eine einen einem eines einer von vom im den dem des ist nicht mit auf aus für sich zeigt um wird am zu zur zum bei nach über auch sind war wurde".split(),
    "fr": "le la les des est une un que du au aux et dans sur pour par pas ne se ce cette qui ont sont était avec on plus à l d".split(),
    "es": "el la los las de que y en un una por con no se del al es para como más su lo fue son está".split(),
    "it": "il lo la gli le di che e un una per con non si del della al è sono nel nella più come questo".split(),
    "pt": "o a os as de que e em um uma por com não se do da ao é para como mais dos das na no foi são".split(),
}
_WORD_LANGS: dict[str, list[str]] = {}
for _lang, _words in WORDS.items():
    for _w in _words:
        _WORD_LANGS.setdefault(_w, []).append(_lang)
_SCRIPT = re.compile(r"(?P<han>[㐀-鿿豈-\ufaff]+)|(?P<kana>[ぁ-ヿ]+)|(?P<ko>[가-\ud7afᄀ-ᇿ]+)|(?P<cyr>[Ѐ-ԯ]+)|(?P<ar>[\u0600-ۿ]+)|(?P<dev>[\u0900-ॿ]+)|(?P<el>[Ͱ-Ͽ]+)|(?P<th>[\u0e00-\u0e7f]+)|(?P<he>[\u0590-\u05ff]+)|(?P<lat>[A-Za-zÀ-ɏ]+)")
_MATH = re.compile(r"\$[^$]*\$|\\[A-Za-z]+")
_ASKS_LANGUAGE = re.compile(r"translat|\bin(?:to)?\s+(?:simple\s+)?(?:chinese|english|french|german|japanese|russian|spanish|korean|italian|latin)\b|译|用(?:英|中|汉|法|德|日|俄)(?:语|文)|翻成|英文(?:作答|回答)|(?:french|german|english|chinese|japanese) version", re.I)


def language(text: str, least_words: int = 4, least_han: int = 10) -> str | None:
    """Language of running text, or None if the text is too short or not running text."""
    if text.isascii() and len(text) < 20:
        return None
    text = _MATH.sub(" ", text) if "$" in text or "\\" in text else text
    n = dict.fromkeys(("han", "kana", "ko", "cyr", "ar", "dev", "el", "th", "he", "lat"), 0)
    words: list[str] = []
    for m in _SCRIPT.finditer(text):
        n[m.lastgroup] += m.end() - m.start()
        if m.lastgroup == "lat":
            if m.end() - m.start() > 1:
                words.append(m[0])
    top = max(n, key=n.get)
    if n["kana"] >= 4 and n["kana"] * 5 >= n["han"] and n["kana"] + n["han"] >= n["lat"]:
        return "ja"
    if top == "lat":
        if len(words) < least_words:
            return None
        score: dict[str, int] = {}
        for w in words:
            for lang in _WORD_LANGS.get(w.lower(), ()):
                score[lang] = score.get(lang, 0) + 1
        if not score:
            return None
        best = max(score, key=lambda k: (score[k], k == "en"))
        return best if score[best] >= 2 or len(words) >= 8 and score[best] >= 1 else None
    if top == "han":
        return "zh" if n["han"] >= least_han and (n["han"] >= 16 or re.search(r"[,，。.!！?？;；:：]", text)) else None
    return top if n[top] >= 10 else None


def asks_language(prompt: str) -> bool:
    return bool(_ASKS_LANGUAGE.search(prompt))
