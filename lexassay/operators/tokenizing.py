"""Tokenizers with a given vocabulary, and small sequence operators."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: A vocabulary above this many words is refused as a closure; join it instead.
MOST_WORDS = 500_000
TONES = {"\u0304": "1", "\u0301": "2", "\u030c": "3", "\u0300": "4"}
#: Vowels with a tone mark, by rule: vowel and mark composed.
TONED = {unicodedata.normalize("NFC", v + m): (v, n) for v in "aeiouüAEIOUÜ" for m, n in TONES.items()}


def basic_tokens(col: Column) -> Column:
    """Control characters dropped, each ideograph and punctuation sign alone, lower case."""
    clean = F.regexp_replace(F.regexp_replace(col, "[\u0000\ufffd\u0001-\u0008\u000e-\u001f]", ""), "[\\s\u00a0\u3000]+", " ")
    spaced = F.regexp_replace(clean, "([一-鿿㐀-䶿豈-\ufaff\\p{Punct}\\p{IsPunctuation}])", " $1 ")
    return F.filter(F.split(F.lower(spaced), " +"), lambda t: t != "")


def greedy_pieces(word: str, vocab: frozenset[str] | set[str], longest: int, unknown: str = "[UNK]") -> list[str]:
    """Longest matches from the left, continuations with ``##``; words above 100 characters or with no match are unknown."""
    if len(word) > 100:
        return [unknown]
    out, a = [], 0
    while a < len(word):
        for b in range(min(len(word), a + longest), a, -1):
            piece = word[a:b] if a == 0 else "##" + word[a:b]
            if piece in vocab:
                out.append(piece)
                a = b
                break
        else:
            return [unknown]
    return out


def pieces(tokens: Column, vocab: list[str]) -> Column:
    """Word pieces of a token array."""
    if len(vocab) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    words = frozenset(vocab)
    longest = max(map(len, words), default=1)

    @arrow_udf(T.ArrayType(T.StringType()))
    def split(batch: pa.Array) -> pa.Array:
        seen: dict[str, list[str]] = {}

        def one(t: str) -> list[str]:
            if t not in seen:
                seen[t] = greedy_pieces(t, words, longest)
            return seen[t]

        return pa.array([None if ts is None else [p for t in ts for p in one(t)] for ts in batch.to_pylist()], pa.list_(pa.string()))

    return split(tokens)


def toned(col: Column) -> Column:
    """Pinyin with a tone mark to plain letters and a digit: ``xuě`` to ``xue3``."""
    marks = "".join(TONED)
    plain = F.translate(col, marks, "".join(v for v, _ in TONED.values()))
    digit = F.translate(F.regexp_extract(col, f"([{marks}])", 1), marks, "".join(n for _, n in TONED.values()))
    return F.concat(plain, digit)


def without_bpe(col: Column, marker: str = "@@ ") -> Column:
    """Subword markers removed; ``sentencepiece``: blanks out, the low bar to a blank."""
    if marker == "sentencepiece":
        return F.trim(F.replace(F.replace(col, F.lit(" "), F.lit("")), F.lit("\u2581"), F.lit(" ")))
    return F.rtrim(F.replace(F.concat(col, F.lit(" ")), F.lit(marker), F.lit("")))


def unknowns_replaced(hypothesis: Column, source: Column, alignment: Column, unknown: str = "<unk>") -> Column:
    """Unknown tokens replaced by the source token they are aligned with."""
    z = F.arrays_zip(hypothesis.alias("h"), alignment.alias("a"))
    return F.transform(z, lambda x: F.when(x["h"] == unknown, F.coalesce(F.get(source, x["a"]), F.lit("<eos>"))).otherwise(x["h"]))


def best_path(emissions: Column, transitions: list[list[float]]) -> Column:
    """Viterbi decoding of emission scores ``ARRAY<ARRAY<DOUBLE>>`` with a transition table."""
    n = len(transitions)

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def decode(batch: pa.Array) -> pa.Array:
        out = []
        for e in batch.to_pylist():
            if not e:
                out.append(e)
                continue
            score, back = list(e[0]), []
            for row in e[1:]:
                step = [max(range(n), key=lambda i, j=j: score[i] + transitions[i][j]) for j in range(n)]
                score = [score[step[j]] + transitions[step[j]][j] + row[j] for j in range(n)]
                back.append(step)
            path = [max(range(n), key=score.__getitem__)]
            for step in reversed(back):
                path.append(step[path[-1]])
            out.append(path[::-1])
        return pa.array(out, pa.list_(pa.int32()))

    return decode(emissions)
