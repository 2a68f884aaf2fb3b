"""Defective prompt and response pairs.

Prompt and response are brought to canonical form first.

* *Copies*: token shingles of the response are looked up among those of the prompt; where enough of them are
  contained, the longest common subsequence of the tokens (bit-parallel, exact, whole texts) decides whether
  the response repeats most of the prompt and adds little.
* *Refusals*: every clause is aligned with the templates of a table - sequences of word classes, with gaps
  that cost - and takes the part (apology, reason, decline, advice) of the best one; the response is a
  refusal if such clauses make up most of it and one declines, at any length.
* *Foreign language* by script and function words of running text; *cut ends* by the missing end of the last text.

The order is empty, refusal, copy, language, truncated: each response has at most one defect.

Row-wise: no shuffle, any key skew is harmless.  A null or empty prompt can neither be copied nor set a
language; null responses are ``empty``; repeated rows are judged alike; whole texts are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexassay.functions.replies import asks_language, common_subsequence, fold, is_nothing, language, listed

from .canonical import canonical

# --- copies ---------------------------------------------------------------------------------------------

#: Tokens of a shingle; least share of the response's shingles found in the prompt before it is aligned.
SHINGLE, CONTAINED = 5, 0.3
#: Least shares of response and prompt in their longest common subsequence: of all tokens, and of the tokens
#: that stand in a shared shingle, where words in common by chance do not count and a tail may be added.
ALL_TOKENS, IN_SHINGLES = (0.85, 0.6), (0.7, 0.5)
#: Characters of the shortest copy.
SHORTEST = 8
_CJK = "㐀-鿿豈-\ufaff぀-ヿ\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")


class Prompt:
    """A folded prompt with its tokens, shingles and language, computed when needed and once for all its responses."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def tokens(self) -> list[str]:
        return _TOKEN.findall(self.text.lower())

    @cached_property
    def shingles(self) -> set[tuple]:
        return set(_shingles(self.tokens))

    @cached_property
    def language(self) -> str | None:
        return language(self.text)


def _shingles(toks: list[str]) -> Iterable[tuple]:
    return zip(*[toks[i:] for i in range(SHINGLE)]) if len(toks) >= SHINGLE else [tuple(toks)]


def _covered(toks: list[str], shared: set[tuple]) -> list[str]:
    """The tokens that stand in one of some shingles."""
    out, upto = [], 0
    for i, shingle in enumerate(_shingles(toks)):
        if shingle in shared:
            out += toks[max(i, upto) : i + SHINGLE]
            upto = i + SHINGLE
    return out


def is_copy(response: str, prompt: Prompt) -> bool:
    """The folded response repeats the prompt, or most of it, and adds no answer."""
    least = min(ALL_TOKENS[1], IN_SHINGLES[1])
    if len(response) < SHORTEST or len(response) < least * len(prompt.tokens):
        return False
    a, b = _TOKEN.findall(response.lower()), prompt.tokens
    if not a or not b or len(a) < least * len(b) or sum(map(len, a)) < SHORTEST:
        return False
    own = list(_shingles(a))
    if sum(map(prompt.shingles.__contains__, own)) < CONTAINED * len(own):
        return False
    shared = prompt.shingles.intersection(own)
    if not any(
        common >= of_response * len(a) and common >= of_prompt * len(b)
        for common, (of_response, of_prompt) in (
            (common_subsequence(a, b), ALL_TOKENS),
            (common_subsequence(_covered(a, shared), _covered(b, shared)), IN_SHINGLES),
        )
    ):
        return False
    closing = _CLOSING.search(response.rstrip(" .。!\n")[-60:])
    return not (closing and closing[0].strip() not in prompt.text)


# --- refusals -------------------------------------------------------------------------------------------

# Word classes of the templates.
WORDING = {
    "sorry": "抱歉 对不起 不好意思 遗憾 sorry | afraid | unfortunately | apologise | apologize | apologies | regret",
    "but": "but",
    "refusing": "不便 不宜 不能 无法 没有办法 没办法 难以 拒绝 暂不 不予 不可以 不会 不再 cannot | can not | can't | could not | couldn't | unable to | not able to | won't | will not | would not | rather not | prefer not to | do not | don't | decline to | declines to | refuse to | refuses to | not allowed to | not permitted to",
    "answering": "作答 回答 解答 答复 提供 给出 答案 结果 处理 完成 讨论 帮助 协助 回应 评论 answer | help | solve | provide | give | assist | respond | response | discuss | complete | comment | do this | result | address",
    "declining": "恕不 恕我 恕难 | beyond what i can | beyond what i may | beyond what i could | beyond what i am able | beyond what we can | beyond what we may | beyond what we could | beyond what we am able",
    "no": "no response | no answer | no solution | no help",
    "offered": "be offered | be given | be provided",
    "skipping": "跳过此题 跳过这道题 跳过本题",
    "referring": "建议 请 可以 better to | please ask | please consult | please see | please contact",
    "asking": "咨询 请教 询问 联系 put | ask | take | refer | a | your | the",
    "authority": "老师 教师 专家 人士 teacher | tutor | instructor | expert",
    "reasoning": "因为 由于 鉴于 根据 按照 because | without | outside | beyond | as it is | as a | as an | scope | missing | original passage | since | due to | according to the",
    "material": "题目 图 图片 材料 信息 内容 配图 问题 原图",
    "lacking": "不全 缺 不清 超出 不足 丢失 看不 看不清",
    "advising": "再试 联系老师 try another | try again | please ask | please try | please contact | please provide | please upload | please resend | please check | ask a teacher | ask your teacher | another question",
    "please": "请",
    "retrying": "换 联系 重新 稍后 再试 咨询 补充 上传",
    "exceeding": "超出",
    "range": "范围",
}
#: Templates: part, word classes in order, and the characters (Chinese, other) a gap between them may have at half score.
TEMPLATES = (
    ("decline", ("declining",), 0, 0),
    ("decline", ("refusing", "answering"), 8, 40),
    ("decline", ("no", "offered"), 8, 12),
    ("decline", ("skipping",), 0, 0),
    ("decline", ("referring", "asking", "authority"), 8, 24),
    ("apology", ("sorry",), 0, 0),
    ("advice", ("advising",), 0, 0),
    ("advice", ("please", "retrying"), 6, 6),
    ("reason", ("reasoning",), 0, 0),
    ("reason", ("material", "lacking"), 10, 10),
    ("reason", ("exceeding", "range"), 6, 6),
)
#: Least alignment score of a clause with a template, and least share of a response in such clauses.
ALIGNED, REFUSING_SHARE = 0.5, 0.66
_CLAUSE = re.compile(r"[,，。.;；!！?？\n]+")


def _class_pattern(text: str) -> str:
    out = []
    for part in text.split("|"):
        zh = [w for w in part.split() if not w.isascii()]
        en = " ".join(w for w in part.split() if w.isascii())
        out += [*map(re.escape, zh), *([rf"\b{re.escape(en)}"] if en else [])]
    return "|".join(sorted(out, key=len, reverse=True))


_CLASSES = {name: re.compile(_class_pattern(text), re.I) for name, text in WORDING.items()}
def _phrases(*names: str) -> tuple[str, ...]:
    out = []
    for part in "|".join(WORDING[n] for n in names).split("|"):
        zh = [w for w in part.split() if not w.isascii()]
        en = " ".join(w for w in part.split() if w.isascii())
        out += [*zh, *([en] if en else [])]
    return tuple(out)


#: A refusal holds a phrase of every group of one of these.
_NEEDED = ((_phrases("sorry", "declining", "no", "skipping"),), (_phrases("refusing"), _phrases("answering")), (_phrases("referring"), _phrases("authority")))


def aligned(clause: str, classes: tuple[str, ...], zh: int, other: int) -> float:
    """Best score of a clause aligned with a template: 1 for words side by side, less for every character between."""
    ends = {m.end(): 1.0 for m in _CLASSES[classes[0]].finditer(clause)}
    for name in classes[1:]:
        nxt: dict[int, float] = {}
        for m in _CLASSES[name].finditer(clause):
            reach = 2 * max(1, zh if not m[0].isascii() else other)
            score = max((x * (1 - (m.start() - e) / reach) for e, x in ends.items() if e <= m.start()), default=0.0)
            if score > 0:
                nxt[m.end()] = max(score, nxt.get(m.end(), 0.0))
        ends = nxt
    return max(ends.values(), default=0.0)


def part_of(clause: str) -> str | None:
    """The part of the template that a clause aligns with best, decline first."""
    best, part = ALIGNED, None
    for name, classes, zh, other in TEMPLATES:
        score = aligned(clause, classes, zh, other)
        if score >= best and (part is None or score > best + 1e-9 and part not in ("decline", "apology")):
            best, part = score, name
    return part


def is_refusal(text: str) -> bool:
    """Most of the folded text aligns with the parts of a refusal, and it declines, or apologises with a reason."""
    t = text.replace("’", "'").lower()
    if not any(all(any(w in t for w in group) for group in groups) for groups in _NEEDED):
        return False
    total = found = 0
    parts = set()
    for clause in _CLAUSE.split(t):
        if n := len(clause.strip()):
            total += n
            part = part_of(clause)
            if part or clause.strip() == "but":
                found += n
                parts.add(part)
    return ("decline" in parts or {"apology", "reason"} <= parts) and found >= REFUSING_SHARE * total


# --- cut end -------------------------------------------------------------------------------------

_COMPLETE = re.compile(r"[.。!?！？…؟।\])）】}》」』”\"'’$][\s\"”’」』)）】》\]]*\Z")
_CLOSING = re.compile(
    r"(?:(?:故|因此|所以|应)?(?:本题)?(?:选|答案)(?:择|为|是|应为)?|answer(?: is|s are)?|choose|option|is (?:right|correct)|(?:it|result) is|答|解)\s*[::为是]?\s*(?:[A-HＡ-Ｈ](?:[\s,、和]*[A-H])*|[√×✓✗TF]|正确|错误|对|错|true|false|[-+]?[\d.,/]+\w{0,4})\s*\Z|(?:is|are) (?:right|correct|true|false)\Z",
    re.I,
)
_PIECES = re.compile(r"[,，、;；:：.。!！?？\n\t|#/()（）\d]+")
_HAN = re.compile(r"[㐀-鿿]")
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ]{2,}")
_LAST_LETTER = re.compile(r"[^\W_]\s*\Z|[,，、;；:：(（\[【“‘「《\-]\s*\Z")
#: Values such as numbers with a unit, letters, ticks.
_VALUE = re.compile(r"(?:[(（]?\d+[)）.、]?\s*)?(?:[A-Ha-h√×✓✗]|[TF]|true|false|yes|no|正确|错误|对|错|[-+]?[\d.,/%:]+\s*[\w/%°℃²³µΩÅ]{0,6}|[^\W\d_]{1,7})", re.I)
SUBJECTIVE = ("解答题", "材料分析题", "翻译题", "作文", "论述题", "简答题", "证明题", "计算题", "实验题", "阅读题")


def is_cut(text: str, prose: bool) -> bool:
    """The text stops inside a word or sentence.  ``prose``: sentences are expected here."""
    t = fold(text).strip()
    if t and (_HANGING.search(t[-24:]) and not _CLOSING.search(t[-60:].rstrip(".")) or _open_quote(t)):
        return True
    if not t or _COMPLETE.search(t) and not t.endswith("$"):
        return _open_end(t) if t else False
    tail = t[-80:]
    if _CLOSING.search(tail):
        return False
    if t.endswith("$"):
        return prose and _open_end(t)
    if not _LAST_LETTER.search(t):
        return False
    if prose:
        return not _VALUE.fullmatch(t)
    # among values only a run of words longer than any value is prose
    return any(len(_HAN.findall(x)) >= 10 or len(_LATIN_WORD.findall(x)) >= 6 for x in _PIECES.split(t)[-2:])


#: Abbreviations and initials that no sentence closes with.
_HANGING = re.compile(r"(?<![^\W_])(?:Mrs?|Ms|Dr|Prof|Capt|St|No|Fig|Figs|Vol|Dept|Sec|ed|vs|cf|e\.g|i\.e|approx|incl|pp?|Jan|Feb|Aug|Sept?|Oct|Nov|Dec|Ver|(?:[A-Z]\. ?)+[A-Z]|(?<=[.!?] )[A-Z])\.\Z")


def _open_quote(t: str) -> bool:
    """The last sentence opens a quotation, a title or a bracket and does not close it."""
    line = t[t.rfind("\n") + 1 :]
    return any(line.rfind(a) > line.rfind(b) for a, b in (("\u201c", "\u201d"), ("《", "》"), ("「", "」"))) or (line.count('"') % 2 == 1 and '"' in line and not line.endswith('"'))


def _open_end(t: str) -> bool:
    """A formula left open."""
    return t.count("$") % 2 == 1


# --- pairs ----------------------------------------------------------------------------------------------


def defect(prompt: Prompt | str | None, items: list[str | None] | None, prose: bool) -> str | None:
    """The one defect of a response, given as its items, or None.

    ``items`` None or without anything visible: ``empty``.  A null or empty prompt can neither be
    copied nor set the language.
    """
    filled = [x for x in items or [] if not is_nothing(x)]
    if not filled:
        return "empty"
    folded = fold("\n".join(filled))
    if is_refusal(folded):
        return "refusal"
    if prompt:
        if isinstance(prompt, str):
            prompt = Prompt(fold(prompt))
        if is_copy(folded, prompt):
            return "copy"
        lang = language(folded)
        if lang and prompt.language and prompt.language != lang and not asks_language(prompt.text):
            return "language"
    if is_cut(filled[-1], prose):
        return "truncated"
    return None


@arrow_udf(T.StructType([T.StructField("answers", T.StringType()), T.StructField("solutions", T.StringType())]))
def _defects(prompts: pa.Array, answers: pa.Array, solutions: pa.Array, kinds: pa.Array) -> pa.Array:
    out_a, out_s = [], []
    for prompt, answer, items, kind in zip(prompts.to_pylist(), answers.to_pylist(), solutions.to_pylist(), kinds.to_pylist()):
        prompt = Prompt(fold(canonical(prompt))) if prompt else None
        own = listed(answer)
        own = [canonical(x) for x in own] if own is not None else [canonical(answer)]
        out_a.append(defect(prompt, own, kind in SUBJECTIVE))
        out_s.append(defect(prompt, [canonical(x) for x in items or []], True))
    return pa.StructArray.from_arrays([pa.array(out_a, pa.string()), pa.array(out_s, pa.string())], ["answers", "solutions"])


def defective_responses(questions: DataFrame) -> DataFrame:
    """``row_id, field, defect`` for every defective response of questions."""
    q = F.col("query")
    d = questions.select("row_id", _defects(q["description"], q["answers"], q["solutions"], q["type"]).alias("d"))
    long = d.select("row_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"d.{f}").alias("defect")) for f in ("answers", "solutions")])).alias("x"))
    return long.select("row_id", "x.*").where(F.col("defect").isNotNull())
