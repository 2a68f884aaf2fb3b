"""Dictionary checks: acceptors in order of cost, suggestions, pinyin, traditional and simplified script."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexassay.functions import dims

PREFIXES = ("un", "re", "non", "dis", "mis", "over", "under", "anti", "multi")
SUFFIXES = ("ness", "less", "ful", "ly", "ing", "ed", "s")


def cascade(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``word, accepted_by``: the first acceptor that takes a distinct word, ``none`` if all reject it.

    Order: the word itself; without a leading quote or point; all hyphen parts; without a trailing capital;
    without a prefix or suffix.  Every derived key is looked up with one equi-join on the dictionary, so no
    broadcast is needed whatever its size.
    """
    w = words.select("word").where(F.col("word").isNotNull()).distinct()
    stripped = F.regexp_replace("word", "^['.]", "")
    hyphen = F.split("word", "-")
    tail = F.regexp_replace("word", "[A-Z]$", "")
    forms = [
        F.struct(F.lit(1).alias("rank"), F.lit("word").alias("how"), F.lower("word").alias("form"), F.lit(1).alias("need")),
        F.when(stripped != F.col("word"), F.struct(F.lit(2), F.lit("quote"), F.lower(stripped), F.lit(1))),
        F.when((tail != F.col("word")) & (F.length(tail) > 1), F.struct(F.lit(4), F.lit("tail"), F.lower(tail), F.lit(1))),
        *[F.when(F.lower("word").startswith(p) & (F.length("word") > len(p) + 2), F.struct(F.lit(5), F.lit("prefix"), F.substring(F.lower("word"), len(p) + 1, 1000), F.lit(1))) for p in PREFIXES],
        *[F.when(F.lower("word").endswith(s) & (F.length("word") > len(s) + 2), F.struct(F.lit(6), F.lit("suffix"), F.expr(f"substring(lower(word), 1, length(word) - {len(s)})"), F.lit(1))) for s in SUFFIXES],
    ]
    parts = F.when(F.size(hyphen) > 1, F.transform(hyphen, lambda p: F.struct(F.lit(3).alias("rank"), F.lit("hyphen").alias("how"), F.lower(p).alias("form"), F.size(hyphen).alias("need"))))
    kind = "array<struct<rank:int,how:string,form:string,need:int>>"
    all_forms = F.concat(F.array_compact(F.array(*[f.cast("struct<rank:int,how:string,form:string,need:int>") for f in forms])).cast(kind), F.coalesce(parts.cast(kind), F.array().cast(kind)))
    keys = w.select("word", F.explode(all_forms).alias("f")).select("word", "f.*")
    hit = keys.join(dictionary.select(F.lower("word").alias("form")).distinct(), "form", "left_semi")
    ok = hit.groupBy("word", "rank", "how", "need").agg(F.count("*").alias("n")).where("n >= need or how <> 'hyphen'").groupBy("word").agg(F.min_by("how", "rank").alias("how"))
    return w.join(ok, "word", "left").select("word", F.coalesce("how", F.lit("none")).alias("accepted_by"))


#: Longest word whose deletion forms are listed.
LONGEST = 32


def suggestions(words: DataFrame, dictionary: DataFrame, most: int = 3) -> DataFrame:
    """``word, suggestion, distance``: the nearest dictionary word within ``most`` edits; ties by word.

    Deletion neighbourhoods: two words within k edits share a form with at most k letters deleted.  Forms are
    joined by hash, so the search is exact without comparing all pairs.  Where one of the two has more than
    ``LONGEST`` letters, words whose lengths differ by at most k are compared instead.
    """

    def forms(w: Column) -> Column:
        cut = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        out, level = F.array(w), F.array(w)
        for _ in range(most):
            level = F.array_distinct(F.flatten(F.transform(level, cut)))
            out = F.concat(out, level)
        return F.array_distinct(out)

    a = words.select("word").where(F.length("word") > 0).distinct()
    b = dictionary.select(F.col("word").alias("suggestion")).where(F.length("suggestion") > 0).distinct()
    hashed = lambda d, w: d.where(F.length(w) <= LONGEST).select(w, F.explode(forms(F.col(w))).alias("f")).select(w, F.xxhash64("f").alias("h"))
    short = hashed(a, "word").join(hashed(b, "suggestion"), "h").select("word", "suggestion")
    n = F.length("word")
    x = a.where(n > LONGEST - most).select("word", F.explode(F.sequence(n - most, n + most)).alias("n"))
    y = b.where(F.length("suggestion") > LONGEST - most).select("suggestion", F.length("suggestion").alias("n"))
    long = x.join(y, "n").where(F.greatest(F.length("word"), "n") > LONGEST).select("word", "suggestion")
    near = short.union(long).distinct().withColumn("distance", F.levenshtein("word", "suggestion", most)).where(F.col("distance").between(1, most))
    w = Window.partitionBy("word").orderBy("distance", "suggestion")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def is_pinyin(word: Column) -> Column:
    """The whole word splits into pinyin syllables."""
    return F.lower(word).rlike("^(?:" + "|".join(sorted(dims.pinyin_syllables(), key=len, reverse=True)) + ")+$")


def longest_match(mapping: dict[str, str]):
    """A conversion by longest match from a mapping of words and characters (traditional to simplified, say)."""
    longest = max(map(len, mapping), default=1)
    first = {k[0] for k in mapping}

    def convert(text: str | None) -> str | None:
        if text is None:
            return None
        out, i = [], 0
        while i < len(text):
            if text[i] in first:
                for n in range(min(longest, len(text) - i), 0, -1):
                    to = mapping.get(text[i : i + n])
                    if to is not None:
                        out.append(to)
                        i += n
                        break
                else:
                    out.append(text[i])
                    i += 1
            else:
                out.append(text[i])
                i += 1
        return "".join(out)

    return convert


def converted(text: Column, mapping: dict[str, str]) -> Column:
    """Script conversion.  Single characters go through ``translate``; only texts with a multi-character entry need Python."""
    single = {k: v for k, v in mapping.items() if len(k) == 1 and len(v) == 1}
    many = [k for k in mapping if len(k) > 1]
    plain = F.translate(text, "".join(single), "".join(single.values()))
    if not many:
        return plain
    convert = longest_match(mapping)

    @arrow_udf(T.StringType())
    def walk(texts: pa.Array) -> pa.Array:
        return pa.array([convert(t) for t in texts.to_pylist()], pa.string())

    has = F.lit(False)
    for k in many:
        has = has | text.contains(k)
    return F.when(has, walk(F.when(has, text))).otherwise(plain)


def vanished_characters(text: Column, mapping: dict[str, str]) -> Column:
    """Characters that are gone after conversion."""
    return F.array_except(F.split(text, ""), F.split(converted(text, mapping), ""))
