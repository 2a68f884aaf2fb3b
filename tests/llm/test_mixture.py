"""Totals that can and cannot be reached, many sources, and counts that are really drawn from a Poisson distribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexassay.llm import mixture
from lexassay.llm.queries import TOKENIZER


def _docs(spark, n, sources):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % sources).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 20 + 1).cast("int")).alias("text"), F.lit(1).alias("cdf"))


def _targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_a_total_is_met_or_refused(spark):
    docs = _docs(spark, 4000, 2)
    targets = _targets(spark, [("s0", 0.75, 3), ("s1", 0.25, 2), (None, 0.5, 1)])
    usual = mixture.plan(docs, targets, TOKENIZER)
    most = 3 * next(w["tokens"] for w in usual if w["source"] == "s0") / 0.75
    for total in (1000.0, 20_000.0, most):
        got = mixture.plan(docs, targets, TOKENIZER, total)
        assert abs(sum(w["tokens_drawn"] for w in got) - total) < 0.02 * total
        assert all(abs(w["share"] - w["target_share"]) < 0.02 for w in got)
    with pytest.raises(ValueError, match="more repeats"):
        mixture.plan(docs, targets, TOKENIZER, most * 1.01)


def test_counts_are_drawn_from_a_poisson_distribution(spark):
    docs = _docs(spark, 6000, 1)
    p = mixture.plan(docs, _targets(spark, [("s0", 1.0, 4)]), TOKENIZER)
    assert p[0]["mean"] <= 4.01  # no mean beyond the repeats
    m = mixture.mixture(docs, p)
    counts = np.bincount([r["n"] for r in m.groupBy("doc_id").agg(F.count("*").alias("n")).collect()], minlength=5) / 6000
    want = np.diff([0.0, *mixture.thresholds(p[0]["mean"], 4)])
    assert np.abs(counts[1:4] - want[1:4]).max() < 0.02 and counts[1:].min() > 0.01


def test_many_sources(spark):
    docs = _docs(spark, 6000, 1500)
    p = mixture.plan(docs, _targets(spark, [(f"s{i}", 1 / 1500, 2) for i in range(1500)]), TOKENIZER)
    assert len(p) == 1500 and sum(w["documents_drawn"] for w in p) == mixture.mixture(docs, p).count()


def test_order_is_the_same_for_the_same_seed(spark):
    docs = _docs(spark, 500, 2)
    p = mixture.plan(docs, _targets(spark, [("s0", 0.5, 2), ("s1", 0.5, 2)]), TOKENIZER)
    order = lambda seed: [r[0] for r in mixture.mixture(docs, p, seed).select("doc_id").collect()]
    assert order(42) == order(42) and order(42) != sorted(order(42))
