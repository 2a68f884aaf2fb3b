"""Mixing sources to target shares of the total size in tokens.

Poisson replication: every document draws its number of uses by inverting a Poisson distribution, cut off
at the source's ``max_repeats``, at a uniform number hashed from its id and a seed.  The mean of each
source's distribution is its target repetition rate, ``share * total / tokens``, corrected for the cut-off.

One pass counts tokens by source and by the bucket of the hashed uniform (at most ``BUCKETS`` rows a
source, whatever the corpus).  From this histogram the mean is solved, source by source on the executors, so
that the tokens *actually drawn* meet the target, and the shares reached are known exactly without another
pass.  A second pass explodes each document by its count and shuffles globally by a hash of document, copy and
seed.  No step groups documents by source, so a source with most of the corpus is no hot spot.

``total`` defaults to the largest size at which no source's mean exceeds its repeats; a larger one is met as
long as the repeats allow it at all, else it is refused.  Documents without a source or of a source without a
target are not used; texts that are null or empty count no tokens; a source with a target but without tokens
is reported with share 0 and does not limit the total.  Equal rows draw equal counts.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexassay.functions.lineage import cut_lineage

BUCKETS = 8192
#: More rows of plan than this are joined without a broadcast.
MOST_BROADCAST = 100_000
#: Means beyond this are those of a source whose every document is used as often as allowed.
MOST_MEAN = 700.0


@lru_cache(4)
def encoding(path: str):
    """A tiktoken encoding from a ranks file; the split pattern is that of the public tokenizers package."""
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("from file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a text, by the tokenizer whose ranks file is at ``path`` on every node; null counts 0."""

    @arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)


def bucket(key: Column, seed: int) -> Column:
    """Bucket of the uniform number hashed from a key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(BUCKETS)).cast("int")


def thresholds(mean: float, most: int) -> list[float]:
    """Distribution function of Poisson(mean) at 0 .. most-1; infinite mean: always ``most``."""
    if math.isinf(mean):
        return [0.0] * most
    out, p, total = [], math.exp(-mean), 0.0
    for k in range(most):
        total += p
        out.append(total)
        p *= mean / (k + 1)
    return out


def uses(b: np.ndarray | int, cdf: list[float]) -> np.ndarray:
    """Uses of the documents in bucket ``b``: the inverse of the distribution function."""
    return np.searchsorted(np.array(cdf), (np.asarray(b) + 0.5) / BUCKETS, "right")


def solve_mean(histogram: dict[int, int], target: float, most: int) -> float:
    """The mean at which the tokens drawn from a histogram by bucket come closest to the target."""
    b, n = np.array(list(histogram), np.int64), np.array(list(histogram.values()), np.int64)
    if target >= most * n.sum() * (1 - 1e-12):
        return math.inf
    drawn = lambda m: int((n * uses(b, thresholds(m, most))).sum())
    lo, hi = 0.0, 1.0
    while drawn(hi) < target and hi < MOST_MEAN:
        hi *= 2
    for _ in range(48):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if drawn(mid) < target else (lo, mid)
    return min((lo, hi), key=lambda m: abs(drawn(m) - target))


_SIZES = "source string, target_share double, max_repeats int, tokens long, documents long, attained double"
_PLAN = "source string, target_share double, max_repeats int, tokens long, documents long, target_tokens double, rate double, mean double, cdf array<double>, tokens_drawn long, documents_drawn long"


def _histogram(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[rows["b"].notna()].astype({"b": "int64", "n": "int64", "d": "int64"})


def _size(rows: pd.DataFrame) -> pd.DataFrame:
    """Tokens and documents of one source, and the tokens drawn at the mean ``max_repeats``."""
    h, first = _histogram(rows), rows.iloc[0]
    most = int(first["max_repeats"])
    at_most = (h["n"] * uses(h["b"].to_numpy(), thresholds(float(most), most))).sum()
    return pd.DataFrame([[first["source"], first["target_share"], most, int(h["n"].sum()), int(h["d"].sum()), float(at_most)]], columns=_names(_SIZES))


def _solved(rows: pd.DataFrame) -> pd.DataFrame:
    """The row of the plan of one source."""
    h, first = _histogram(rows), rows.iloc[0]
    most, target = int(first["max_repeats"]), float(first["target_share"] * first["total"])
    tokens = int(h["n"].sum())
    mean = solve_mean(dict(zip(h["b"], h["n"])), target, most) if tokens else 0.0
    cdf = thresholds(mean, most)
    used = uses(h["b"].to_numpy(), cdf)
    row = [first["source"], first["target_share"], most, tokens, int(h["d"].sum()), target, target / tokens if tokens else 0.0, mean, cdf, int((h["n"] * used).sum()), int((h["d"] * used).sum())]
    return pd.DataFrame([row], columns=_names(_PLAN))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def plan(documents: DataFrame, targets: DataFrame, tokenizer: str, total: float | None = None, seed: int = 42) -> list[dict]:
    """Per source: tokens there, target rate, mean, thresholds, tokens and documents drawn, share reached."""
    want = targets.where(F.col("source").isNotNull()).select("source", F.col("target_share").cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats"))
    used = documents.join(F.broadcast(want.select("source")) if _few(want) else want.select("source"), "source", "left_semi")
    counted = used.select("source", bucket(F.col("doc_id"), seed).alias("b"), token_count(F.col("text"), tokenizer).alias("n"))
    # at most BUCKETS rows a source; written once, for two passes over it
    histogram = cut_lineage(want.join(counted.groupBy("source", "b").agg(F.sum("n").alias("n"), F.count("*").alias("d")), "source", "left"))
    sizes = histogram.groupBy("source").applyInPandas(_size, _SIZES)
    limits = sizes.where("tokens > 0 AND target_share > 0").agg(F.min(F.col("attained") / F.col("target_share")).alias("usual"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("most")).first()
    size = total if total is not None else limits["usual"] or 0.0
    if size > (limits["most"] or 0.0) * (1 + 1e-9):
        raise ValueError(f"a total of {size} tokens needs more repeats than allowed; at most {limits['most'] or 0.0} can be reached")
    out = [r.asDict() for r in histogram.withColumn("total", F.lit(float(size))).groupBy("source").applyInPandas(_solved, _PLAN).orderBy("source").collect()]
    everything = sum(w["tokens_drawn"] for w in out)
    for w in out:
        w["share"] = w["tokens_drawn"] / everything if everything else 0.0
    return out


def _few(df: DataFrame) -> bool:
    return df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def mixture(documents: DataFrame, planned: list[dict], seed: int = 42) -> DataFrame:
    """``doc_id, source, copy, text`` of the mixture in global random order.

    One shuffle by the hash, sorted by it within partitions: the order is random over the whole mixture and
    the same for the same seed and number of partitions.
    """
    spark = documents.sparkSession
    cdf = spark.createDataFrame([(w["source"], [float(x) for x in w["cdf"]]) for w in planned], "source string, cdf array<double>")
    b = bucket(F.col("doc_id"), seed)
    # one row a source
    drawn = documents.select("doc_id", "source", "text").join(F.broadcast(cdf) if len(planned) <= MOST_BROADCAST else cdf, "source")
    n = F.size(F.filter("cdf", lambda c: (b + F.lit(0.5)) / F.lit(BUCKETS) >= c))
    copies = drawn.where(n > 0).select("doc_id", "source", F.explode(F.sequence(F.lit(1), n)).alias("copy"), "text")
    place = F.xxhash64(F.lit(seed + 1), "doc_id", "copy")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(partitions, place).sortWithinPartitions(place, "doc_id", "copy")


def shares(spark, planned: list[dict]) -> DataFrame:
    """The report: one row a source."""
    names = ["source", "target_share", "max_repeats", "documents", "tokens", "rate", "documents_drawn", "tokens_drawn", "share"]
    return spark.createDataFrame([tuple(w[k] for k in names) for w in planned], "source string, target_share double, max_repeats int, documents long, tokens long, rate double, documents_drawn long, tokens_drawn long, share double")
