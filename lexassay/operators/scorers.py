"""Model scores are tables: candidates, tags and sentence scores are joined in, not computed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_candidates(candidates: DataFrame, keys: list[str], score: Column, ties: list[str]) -> DataFrame:
    """The best candidate of each position (window group limit: one row a key survives before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), *ties)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def curve(confidence: Column, similarity: Column) -> Column:
    """The acceptance curve of corrections by confidence and similarity."""
    return (F.lit(20 / 3) * confidence + similarity - F.lit(21.2 / 3) > 0) | (F.lit(0.2) * confidence + similarity - F.lit(0.7) > 0)


def without_neighbours(errors: DataFrame, key: str) -> DataFrame:
    """In each run of adjacent errors (``key, pos, confidence``) only the most confident one."""
    w = Window.partitionBy(key).orderBy("pos")
    runs = errors.withColumn("_g", F.col("pos") - F.row_number().over(w))
    best = Window.partitionBy(key, "_g").orderBy(F.col("confidence").desc(), "pos")
    return runs.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_g")


def ensemble(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Log of the mean probability over models (``log_p``)."""
    return scores.groupBy(*keys).agg(F.log(F.avg(F.exp("log_p"))).alias("log_p"))


def best_subset(scores: DataFrame, key: str, gain: float = 0.02) -> DataFrame:
    """Of the scored subsets of a sentence's edits (``key, mask, score``, mask 0 unedited, lower is better) the best
    if it beats the unedited sentence by more than ``gain`` relative, else mask 0."""
    w = Window.partitionBy(key).orderBy("score", "mask")
    base = scores.where("mask = 0").select(key, F.col("score").alias("_base"))
    best = scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(base, key)
    better = (F.col("_base") - F.col("score")) / F.abs("_base") > gain
    return best.select(key, F.when(better, F.col("mask")).otherwise(0).alias("mask"))


def beam_step(hypotheses: DataFrame, expansions: DataFrame, key: str, beam: int) -> DataFrame:
    """One step of beam search: ``key, hyp, score`` joined with next-token scores ``key, hyp, token, log_p``; the
    best ``2 * beam`` continuations of each key."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "hyp", "token")
    j = hypotheses.join(expansions, [key, "hyp"]).withColumn("score", F.col("score") + F.col("log_p")).drop("log_p")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2 * beam)


def sentence_scores(tokens: DataFrame, key: str) -> DataFrame:
    """Mean negative log probability of each sentence, infinite ones left out."""
    return tokens.where(F.col("log_p") > float("-inf")).groupBy(key).agg((-F.avg("log_p")).alias("score"))


def within_length(score: Column, step: Column, is_end: Column, least: Column, most: Column) -> Column:
    """Length limits of a search step: no end before ``least``, nothing but the end from ``most`` on."""
    never = F.lit(float("-inf"))
    return F.when(is_end & (step < least), never).when(~is_end & (step >= most), never).when(is_end & (step >= most), F.lit(0.0)).otherwise(score)


def sampled(candidates: DataFrame, key: str, weight: str, u: Column, top: int) -> DataFrame:
    """One of the ``top`` candidates of each key, drawn in proportion to its weight by a uniform number ``u``."""
    w = Window.partitionBy(key).orderBy(F.col(weight).desc(), "token")
    c = candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    c = c.withColumn("_upto", F.sum(weight).over(Window.partitionBy(key).orderBy("_n"))).withColumn("_all", F.sum(weight).over(Window.partitionBy(key)))
    return c.where((u * F.col("_all") < F.col("_upto")) & (u * F.col("_all") >= F.col("_upto") - F.col(weight))).drop("_n", "_upto", "_all")


def outcomes(corrections: DataFrame) -> DataFrame:
    """``outcome, n`` for rows ``original, truth, predicted`` of characters."""
    o, t, p = F.col("original"), F.col("truth"), F.col("predicted")
    kind = F.when((o != t) & (p == t), "detected and corrected").when((o != t) & (p != o), "detected, wrongly corrected").when(o != t, "missed").when(p != o, "false alarm").otherwise("untouched")
    return corrections.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))
