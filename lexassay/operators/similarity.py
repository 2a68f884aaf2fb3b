"""String, glyph and sound similarity, and near-duplicate search."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexassay.functions.replies import common_subsequence


def _common_substring(a: str, b: str) -> int:
    """Longest common substring, by a suffix automaton of the shorter text: linear in both."""
    if len(a) > len(b):
        a, b = b, a
    nxt: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in a:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    best = state = run = 0
    for c in b:
        while state and c not in nxt[state]:
            state = link[state]
            run = size[state]
        if c in nxt[state]:
            state, run = nxt[state][c], run + 1
        best = max(best, run)
    return best


@arrow_udf(T.IntegerType())
def common_substring(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common substring; null if either is null."""
    return pa.array([None if x is None or y is None else _common_substring(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


@arrow_udf(T.IntegerType())
def subsequence_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance without substitution: ``len + len - 2 * longest common subsequence``."""
    return pa.array([None if x is None or y is None else len(x) + len(y) - 2 * common_subsequence(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def best_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of alternative spellings the best ``1 - distance / longer length``."""
    s = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))))
    return F.array_max(s)


def character_similarity(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the larger of sound and shape similarity; 0 for characters not in ``meta``.

    ``meta``: ``ch, shapes ARRAY<STRING>, sounds ARRAY<STRING>``, an ordinary join (Spark broadcasts it if
    it is small enough).
    """
    left = meta.select(F.col("ch").alias("a"), F.col("shapes").alias("sa"), F.col("sounds").alias("pa"))
    right = meta.select(F.col("ch").alias("b"), F.col("shapes").alias("sb"), F.col("sounds").alias("pb"))
    j = pairs.join(left, "a", "left").join(right, "b", "left")
    sim = F.coalesce(F.greatest(best_similarity(F.col("sa"), F.col("sb")), best_similarity(F.col("pa"), F.col("pb"))), F.lit(0.0))
    return j.select("a", "b", F.round(sim, 6).alias("similarity"))


def similar_candidates(texts: DataFrame, candidate: str, key: str, text: str, ratio: float = 0.1) -> DataFrame:
    """Of texts with the same ``candidate`` key the pairs with ``2 * distance / (length + length) <= ratio``.

    The candidate key is given with the data (the id a question was sent under, say); no pair that shares it
    is lost.  Equal texts are one class, named by the least id of all rows that have the text, as in
    ``near_members``: pairs are between classes, so copies are not expanded, and a key that repeats one text
    many times is one row before the join.  Classes are found by digest; texts travel only as representatives.
    Null keys and null texts are no candidates.
    """
    rows = texts.where(F.col(candidate).isNotNull() & F.col(text).isNotNull()).select(F.col(candidate).alias("c"), digest(F.col(text)).alias("d"), F.col(text).alias("t"))
    reps = rows.groupBy("c", "d").agg(F.first("t").alias("t")).join(classes(texts, key, text), "d").select("c", F.col("class_id").alias("id"), "t", F.length("t").alias("n"))
    a, b = reps.alias("a"), reps.alias("b")
    bound = (F.col("a.n") + F.col("b.n")) * ratio / 2
    close = a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.id") < F.col("b.id")) & (F.abs(F.col("a.n") - F.col("b.n")) <= bound))
    once = close.groupBy(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).agg(F.first("a.t").alias("x"), F.first("b.t").alias("y"))
    once = once.withColumn("most", F.floor((F.length("x") + F.length("y")) * ratio / 2).cast("int"))
    # -1 beyond the pair's own bound, where the distance is not computed further
    return once.withColumn("distance", F.expr("levenshtein(x, y, most)")).where("distance >= 0").select("id_a", "id_b", "distance")


def digest(text: Column) -> Column:
    """What stands for a text in groupings and joins."""
    return F.unhex(F.sha2(text, 256))


def classes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``d, class_id``: of each different text its digest and least id."""
    return texts.where(F.col(text).isNotNull()).groupBy(digest(F.col(text)).alias("d")).agg(F.min(key).alias("class_id"))


def near_members(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class_id``: the least id with the same text.  Only digests are shuffled; a text that a third of all
    rows share is one row of the classes, and its members are split over tasks by the adaptive skew join."""
    members = texts.where(F.col(text).isNotNull()).select(key, digest(F.col(text)).alias("d"))
    return members.join(classes(texts, key, text), "d").select(key, "class_id")
