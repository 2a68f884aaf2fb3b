"""Token alignment and edit algebra.

An edit is ``start, end, type, cor`` on tokens, half-open.  Alignment is Levenshtein on tokens with
transpositions of adjacent groups of equal bags; back-trace prefers transposition, then substitution, then
insertion, then deletion from the end of the sentence.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def operations(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """One optimal alignment: ``(op, a_from, a_to, b_from, b_to)`` with ops M, S, I, D, T."""
    n, m = len(a), len(b)
    la, lb = [x.lower() for x in a], [x.lower() for x in b]
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    how: list[list[tuple[str, int]]] = [[("", 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        cost[i][0], how[i][0] = i, ("D", 1)
    for j in range(1, m + 1):
        cost[0][j], how[0][j] = j, ("I", 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if a[i - 1] == b[j - 1]:
                cost[i][j], how[i][j] = cost[i - 1][j - 1], ("M", 1)
                continue
            best = [(cost[i - 1][j - 1] + 1, 1, ("S", 1)), (cost[i][j - 1] + 1, 2, ("I", 1)), (cost[i - 1][j] + 1, 3, ("D", 1))]
            k = _transposed(la, lb, i, j)
            if k:
                best.append((cost[i - k][j - k] + k - 1, 0, ("T", k)))
            c, _, h = min(best)
            cost[i][j], how[i][j] = c, h
    out, i, j = [], n, m
    while i or j:
        op, k = how[i][j]
        di, dj = (k, k) if op in "MST" else (0, 1) if op == "I" else (1, 0)
        out.append((op, i - di, i, j - dj, j))
        i, j = i - di, j - dj
    return out[::-1]


def _transposed(a: list[str], b: list[str], i: int, j: int) -> int:
    """Least length of equal bags ending at i and j, 0 if there is none; the difference of the bags is kept as they grow."""
    if a[i - 1] not in b[:j] or b[j - 1] not in a[:i]:
        return 0
    diff: dict[str, int] = {}
    odd = 0
    for k in range(1, min(i, j) + 1):
        for t, d in ((a[i - k], 1), (b[j - k], -1)):
            was = diff.get(t, 0)
            diff[t] = was + d
            odd += (was == 0) - (was + d == 0)
        if not odd:
            return k if k > 1 else 0
    return 0


def edits(a: list[str], b: list[str], merge: bool = True) -> list[tuple[int, int, str, str]]:
    """Edits that turn tokens ``a`` into ``b``; adjacent ones merged."""
    out: list[list[int]] = []
    for op, a0, a1, b0, b1 in operations(a, b):
        if op == "M":
            continue
        if merge and out and out[-1][1] == a0 and out[-1][3] == b0:
            out[-1][1], out[-1][3] = a1, b1
        else:
            out.append([a0, a1, b0, b1])
    res = []
    for a0, a1, b0, b1 in out:
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 < a1 or b0 < b1:
            kind = "M" if a0 == a1 else "U" if b0 == b1 else "R"
            res.append((a0, a1, f"{kind}:{category(a[a0:a1], b[b0:b1])}", " ".join(b[b0:b1])))
    return res


def category(a: list[str], b: list[str]) -> str:
    """A category that needs no tagger: orthography, word order, punctuation, spelling, other."""
    x, y = "".join(a).lower(), "".join(b).lower()
    if x == y and x:
        return "ORTH"
    if a and b and sorted(t.lower() for t in a) == sorted(t.lower() for t in b):
        return "WO"
    if all(not c.isalnum() for c in x + y):
        return "PUNCT"
    if len(a) == len(b) == 1 and a[0].isalpha() and b[0].isalpha() and _near(x, y):
        return "SPELL"
    return "OTHER"


def _near(x: str, y: str) -> bool:
    from lexassay.functions.replies import common_subsequence

    return 2 * common_subsequence(x, y) >= 0.65 * (len(x) + len(y))


_EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("cor", T.StringType())]))
_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("cor", pa.string())]))


@arrow_udf(_EDITS)
def token_edits(source: pa.Array, target: pa.Array) -> pa.Array:
    """Edits between two token arrays; null if either is null."""
    out = []
    for a, b in zip(source.to_pylist(), target.to_pylist()):
        out.append(None if a is None or b is None else [dict(zip(("start", "end", "type", "cor"), e)) for e in edits(a, b)])
    return pa.array(out, _PA)


def applied(tokens: Column, edit_list: Column) -> Column:
    """Tokens after applying edits sorted by place: a fold from the right, so that no offset has to be kept."""
    right = F.reverse(F.array_sort(edit_list))
    return F.aggregate(
        right,
        tokens,
        lambda acc, e: F.concat(
            F.slice(acc, F.lit(1), e["start"]),
            F.when(F.length(e["cor"]) > 0, F.split(e["cor"], " ")).otherwise(F.array().cast("array<string>")),
            F.slice(acc, e["end"] + 1, F.greatest(F.size(acc) - e["end"], F.lit(0))),
        ),
    )


def m2_text(tokens: Column, edit_list: Column, coder: int = 0) -> Column:
    """The M2 record of a sentence."""
    line = F.transform(edit_list, lambda e: F.concat(F.lit("A "), e["start"].cast("string"), F.lit(" "), e["end"].cast("string"), F.lit("|||"), e["type"], F.lit("|||"), e["cor"], F.lit(f"|||REQUIRED|||-NONE-|||{coder}")))
    none = F.array(F.lit(f"A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||{coder}"))
    return F.concat_ws("\n", F.concat(F.lit("S "), F.array_join(tokens, " ")), F.array_join(F.when(F.size(line) > 0, line).otherwise(none), "\n"))


def parsed_m2(record: Column) -> Column:
    """``tokens, edits`` of an M2 record; edits also carry their coder."""
    lines = F.split(record, "\n")
    a = F.filter(lines, lambda x: x.startswith("A "))

    def edit(x: Column) -> Column:
        f = F.split(x, r"\|\|\|")
        span = F.split(F.get(f, F.lit(0)), " ")
        return F.struct(F.get(span, F.lit(1)).cast("int").alias("start"), F.get(span, F.lit(2)).cast("int").alias("end"), F.get(f, F.lit(1)).alias("type"), F.get(f, F.lit(2)).alias("cor"), F.get(f, F.lit(5)).cast("int").alias("coder"))

    return F.struct(F.split(F.substring(F.get(lines, F.lit(0)), 3, 1_000_000), " ").alias("tokens"), F.transform(a, edit).alias("edits"))


def subsets(edit_list: Column, most: int = 5) -> Column:
    """All subsets of at most ``most`` edits as index masks 0 .. 2^n - 1; null beyond (the rule needs 0 < n < most)."""
    n = F.size(edit_list)
    return F.when((n > 0) & (n < most), F.sequence(F.lit(0), F.pow(F.lit(2), n).cast("int") - 1))


def character_spans(tokens: Column, edit_list: Column) -> Column:
    """Edits with character offsets in the space-joined sentence."""

    def offset(i: Column) -> Column:
        head = F.array_join(F.slice(tokens, F.lit(1), i), " ")
        return F.length(head) + F.when(i > 0, 1).otherwise(0)

    return F.transform(edit_list, lambda e: F.struct(offset(e["start"]).alias("start_at"), F.greatest(offset(e["end"]) - F.when(e["end"] > e["start"], 1).otherwise(0), offset(e["start"])).alias("end_at"), e["type"].alias("type"), e["cor"].alias("cor")))


def messages(tokens: Column, edit_list: Column) -> Column:
    """A sentence for each edit: what to insert, delete or replace, and where."""

    def one(e: Column) -> Column:
        old = F.array_join(F.slice(tokens, e["start"] + 1, e["end"] - e["start"]), " ")
        before = F.when(e["start"] > 0, F.concat(F.lit("after "), F.get(tokens, e["start"] - 1))).otherwise(F.lit("at the start"))
        return (
            F.when(e["start"] == e["end"], F.concat(F.lit("insert "), e["cor"], F.lit(" "), before))
            .when(F.length(e["cor"]) == 0, F.concat(F.lit("delete "), old))
            .otherwise(F.concat(F.lit("replace "), old, F.lit(" with "), e["cor"]))
        )

    return F.transform(edit_list, one)


def operation_runs(ops: DataFrame, key: str, by_type: bool) -> DataFrame:
    """Runs of alignment operations ``key, pos, op`` other than matches, by gaps and islands.

    ``by_type``: a change of operation ends a run; else only a match does.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos")
    kind = F.col("op") if by_type else F.when(F.col("op") == "M", "M").otherwise("x")
    o = ops.withColumn("_k", kind)
    o = o.withColumn("_run", F.sum(F.coalesce((F.lag("_k").over(w) != F.col("_k")).cast("int"), F.lit(0))).over(w))
    return o.where("op <> 'M'").groupBy(key, "_run").agg(F.min("pos").alias("start_at"), (F.max("pos") + 1).alias("end_at"), F.count("*").alias("n")).drop("_run")
