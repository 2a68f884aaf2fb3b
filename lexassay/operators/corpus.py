"""Vocabularies, encoding, batching, sharding, noising and corpus metrics.

Random choices are arithmetic on ids (a linear congruential step), so that they repeat on every engine and
survive recomputation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexassay.functions.lineage import broadcast_if_small

SPECIALS = ("<pad>", "</s>", "<unk>")


def token_rows(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, pos, token``."""
    return docs.select(F.col(key), F.posexplode(tokens).alias("pos", "token"))


def vocabulary(rows: DataFrame, threshold: int = 1, most: int | None = None, multiple: int = 8) -> DataFrame:
    """``idx, symbol, n``: specials, then symbols by count (ties by symbol), then fillers to a multiple.

    Counting is partial before the exchange.  The numbering ranks the vocabulary: it is done with a window
    over counts only, which are few against the corpus; the ranked set is cut before it.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(F.col("token").alias("symbol")).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    if most is not None:
        counts = counts.orderBy(F.col("n").desc(), "symbol").limit(max(0, most - len(SPECIALS)))
    ranked = ranks(counts, [F.col("n").desc(), F.col("symbol")]).select((F.col("rank") + len(SPECIALS)).alias("idx"), "symbol", "n")
    special = spark.createDataFrame([(i, s, 0) for i, s in enumerate(SPECIALS)], "idx long, symbol string, n long")
    size = ranked.agg(F.count("*").alias("c"))
    fill = size.select(F.explode(F.sequence(F.lit(0), F.pmod(-(F.col("c") + len(SPECIALS)), F.lit(multiple)))).alias("k"), "c").where(F.col("k") > 0)
    filler = fill.select((F.col("c") + len(SPECIALS) + F.col("k") - 1).alias("idx"), F.concat(F.lit("madeupword"), F.lpad((F.col("k") - 1).cast("string"), 4, "0")).alias("symbol"), F.lit(0).cast("long").alias("n"))
    return special.unionByName(ranked).unionByName(filler)


def ranks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Global 0-based ranks without one window over everything: range partitions are numbered by themselves
    and shifted by the sizes of those before them."""
    from lexassay.functions.lineage import cut_lineage

    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    parted = cut_lineage(parted)  # the partition numbers must not change between the two uses
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parted.withColumn("_i", inner).join(F.broadcast(before), "_p").withColumn("rank", F.col("_before") + F.col("_i") - 1).drop("_p", "_i", "_before")


def with_previous(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``lag(value)`` within each key, for keys of any size: rows are range-partitioned by key and order, so a
    key may span many tasks; the first row of a partition takes the last one of the partition before."""
    from lexassay.functions.lineage import cut_lineage

    cols = [F.col(key), *map(F.col, order)]
    parted = cut_lineage(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*cols)
    inner = parted.withColumn("_k", F.lag(key).over(w)).withColumn("_v", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = parted.groupBy("_p").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), F.struct(*cols)).alias("last"))
    ends = Window.orderBy("_p")  # one row a partition
    before = last.select("_p", F.lag("last").over(ends).alias("_last"))
    j = inner.join(F.broadcast(before), "_p", "left")
    k, v = F.when(F.col("_first"), F.col("_last.k")).otherwise(F.col("_k")), F.when(F.col("_first"), F.col("_last.v")).otherwise(F.col("_v"))
    return j.withColumn(name, F.when(k.eqNullSafe(F.col(key)), v)).drop("_p", "_k", "_v", "_first", "_last")


#: Most frequent symbols that are looked up where the texts are; about 20 MB for a worker.
LOOKED_UP = 200_000


def encoded(docs: DataFrame, key: str, tokens: str, vocab: DataFrame, looked_up: int = LOOKED_UP) -> DataFrame:
    """``key, ids``: the tokens of each text as vocabulary numbers, unknown ones ``<unk>``, end of sentence appended.

    The ``looked_up`` most frequent symbols (a vocabulary is numbered by frequency) are broadcast and looked up
    in Arrow batches: nothing is shuffled.  Only where the vocabulary is longer, the distinct rest of each text
    is joined by symbol - rare ones by then, so that no key is hot - and comes back as one map a text.
    """
    unk, eos = SPECIALS.index("<unk>"), SPECIALS.index("</s>")
    spark = docs.sparkSession
    first = {r["symbol"]: r["idx"] for r in vocab.where(F.col("idx") < looked_up).select("symbol", "idx").collect()}
    table = spark.sparkContext.broadcast(first)

    @arrow_udf(T.ArrayType(T.LongType()))
    def look_up(texts: pa.Array) -> pa.Array:
        get = table.value.get
        return pa.array([None if t is None else [get(x) for x in t] for t in texts.to_pylist()], pa.list_(pa.int64()))

    close = lambda ids: F.concat(F.transform(ids, lambda x: F.coalesce(x, F.lit(unk).cast("long"))), F.array(F.lit(eos).cast("long")))
    got = docs.select(key, F.col(tokens).alias("_t")).withColumn("_ids", look_up("_t"))
    if vocab.where(F.col("idx") >= looked_up).limit(1).count() == 0:
        return got.select(key, close(F.col("_ids")).alias("ids"))
    left = F.array_distinct(F.filter(F.transform(F.arrays_zip("_t", "_ids"), lambda z: F.when(z["_ids"].isNull(), z["_t"])), lambda x: x.isNotNull()))
    rest = got.select(key, F.explode(left).alias("symbol")).join(vocab.select("symbol", "idx"), "symbol").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("symbol", "idx"))).alias("_m"))
    joined = got.join(rest, key, "left")
    filled = F.transform(F.arrays_zip("_t", "_ids"), lambda z: F.coalesce(z["_ids"], F.try_element_at("_m", z["_t"])))
    return joined.select(key, close(filled).alias("ids"))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, in order."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def bleu(pairs: DataFrame, ref: Column, hyp: Column, n: int = 4) -> DataFrame:
    """Corpus BLEU of reference and hypothesis token arrays: one row with counts, precisions and score.

    Clipped n-gram counts are taken pair by pair in Arrow batches, so that only 2n+2 sums are shuffled
    instead of every n-gram.
    """

    @arrow_udf(T.ArrayType(T.LongType()))
    def counts(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        out = []
        for r, h in zip(refs.to_pylist(), hyps.to_pylist()):
            r, h = r or [], h or []
            row = [len(r), len(h)]
            for k in range(1, n + 1):
                a, b = (Counter(zip(*[t[i:] for i in range(k)])) for t in (h, r))
                row += [sum((a & b).values()), max(0, len(h) - k + 1)]
            out.append(row)
        return pa.array(out, pa.list_(pa.int64()))

    names = ["r", "h", *[f"{a}{k}" for k in range(1, n + 1) for a in "mc"]]
    s = pairs.select(counts(ref, hyp).alias("c")).agg(*[F.sum(F.get("c", F.lit(i))).alias(x) for i, x in enumerate(names)])
    logs = sum((F.log(F.col(f"m{k}") / F.col(f"c{k}")) for k in range(1, n + 1)), F.lit(0.0))
    brevity = F.least(F.lit(1.0), F.exp(1 - F.col("r") / F.col("h")))
    zero = F.lit(False)
    for k in range(1, n + 1):
        zero = zero | (F.col(f"m{k}") == 0)
    return s.withColumn("score", F.round(F.when(zero, 0.0).otherwise(100 * brevity * F.exp(logs / n)), 6))


def chunks(tags: Column) -> Column:
    """Runs of a BIO tag array as ``array<struct<kind, start_at, end_at>>``: a run starts at ``B-`` or a new kind."""
    n = F.size(tags)
    kind = lambda i: F.when(F.get(tags, i) != "O", F.get(F.split(F.get(tags, i), "-"), F.lit(1)))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.concat(F.filter(places, lambda i: kind(i).isNull() | F.get(tags, i).startswith("B-") | ~kind(i).eqNullSafe(F.when(i > 0, kind(i - 1)))), F.array(n))
    runs = F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda s, j: F.struct(kind(s).alias("kind"), s.alias("start_at"), F.get(ends, j + 1).alias("end_at")))
    return F.when(tags.isNotNull(), F.filter(runs, lambda r: r["kind"].isNotNull()))


def chunk_scores(gold: Column, predicted: Column, texts: DataFrame) -> DataFrame:
    """One row: correct, gold and predicted chunks of tag arrays with precision, recall and F1.

    A text's chunks are compared where they are; three numbers a partition are shuffled.
    """
    g, p = chunks(gold), chunks(predicted)
    s = texts.select(F.size(F.array_intersect(g, p)).alias("c"), F.size(g).alias("g"), F.size(p).alias("p")).agg(*[F.sum(x).alias(y) for x, y in (("c", "correct"), ("g", "gold"), ("p", "predicted"))])
    p, r = F.col("correct") / F.nullif(F.col("predicted"), F.lit(0)), F.col("correct") / F.nullif(F.col("gold"), F.lit(0))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return s.select("correct", "gold", "predicted", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def step(x: Column, times: int = 1) -> Column:
    """The linear congruential generator used for choices: the same arithmetic on every engine."""
    for _ in range(times):
        x = F.pmod(x * F.lit(1103515245) + F.lit(12345), F.lit(2147483648))
    return x


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from ids."""
    x = F.lit(42).cast("long")
    for k in keys:
        x = step(F.pmod(x + k.cast("long"), F.lit(2147483648)))
    return step(x) / F.lit(2147483648.0)


def dropped_words(rows: DataFrame, key: str, probability: float) -> DataFrame:
    """Word dropout: tokens left after dropping each with a probability; the first token of a text stays."""
    return rows.where((F.col("pos") == 0) | (uniform(F.col(key), F.col("pos")) >= probability))


def shuffled_words(key: Column, tokens: Column, distance: int) -> Column:
    """Local shuffle: ``array<struct<noise, pos, token>>`` of a token array, sorted by place plus noise below
    ``distance``; the first stays first.  Row-wise."""
    noisy = F.transform(tokens, lambda t, i: F.struct(F.when(i == 0, F.lit(-1.0)).otherwise(i + distance * uniform(key, i)).alias("noise"), i.alias("pos"), t.alias("token")))
    return F.array_sort(noisy)


def shards(df: DataFrame, key: str, k: int) -> DataFrame:
    """Round-robin shard of each id."""
    return df.withColumn("shard", F.pmod(F.col(key), F.lit(k)).cast("int"))


def upsampled(df: DataFrame, ratio: Column) -> DataFrame:
    """Each row ``ratio`` times, with its copy number."""
    return df.select("*", F.explode(F.when(ratio > 0, F.sequence(F.lit(1), ratio))).alias("copy"))


def batches_by_size(df: DataFrame, key: str, size: str, max_tokens: int, max_rows: int, partitions: int | None = None) -> DataFrame:
    """Greedy batches of texts sorted by size, bounded by ``rows x longest`` and by rows.

    Texts are range-partitioned by size, each partition is packed by itself in streaming fashion: batch ids
    are ``partition, number``.  Texts longer than ``max_tokens`` make a batch of their own.
    """
    parted = (df.repartitionByRange(partitions, size, key) if partitions else df.repartitionByRange(size, key)).sortWithinPartitions(size, key).select(key, F.col(size).cast("long").alias("size"), F.spark_partition_id().alias("part"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, n, longest = 0, 0, 0
        for f in frames:
            out = []
            for s in f["size"]:
                m = max(longest, s)
                if n and ((n + 1) * m > max_tokens or n >= max_rows):
                    batch, n, m = batch + 1, 0, s
                n, longest = n + 1, m
                out.append(batch)
            yield f.assign(batch=out)

    return parted.mapInPandas(pack, f"{key} long, size long, part int, batch long")


def blocks(tokens: Column, block: int) -> Column:
    """Fixed blocks of a token array with the source shifted right: ``array<struct<block_no, tokens, sources>>``."""
    shifted = F.concat(F.array(F.lit("</s>")), tokens)
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    size = lambda s: F.least(F.lit(block), F.size(tokens) - s)
    return F.transform(starts, lambda s, k: F.struct(k.cast("long").alias("block_no"), F.array_join(F.slice(tokens, s + 1, F.lit(block)), " ").alias("tokens"), F.array_join(F.slice(shifted, s + 1, size(s)), " ").alias("sources")))


def masked_tokens(rows: DataFrame, key: str, vocab: DataFrame, share: float = 0.15) -> DataFrame:
    """Masked prediction: a share of tokens is chosen; of these 80 % become ``[MASK]``, 10 % stay, 10 % become the
    symbol of the vocabulary (``idx, symbol`` numbered from the specials on) that a hash of their place names."""
    u, v, w = uniform(F.col(key), F.col("pos")), uniform(F.col("pos"), F.col(key) + 7), uniform(F.col(key) + 3, F.col("pos"))
    size = vocab.agg(F.count("*").alias("_size"))
    chosen = rows.where(u < share).crossJoin(F.broadcast(size))  # one row
    drawn = chosen.withColumn("_v", v).withColumn("_idx", F.when(F.col("_v") >= 0.9, F.floor(w * F.col("_size")) + len(SPECIALS)))
    j = drawn.join(broadcast_if_small(vocab.select(F.col("idx").alias("_idx"), F.col("symbol").alias("_symbol"))), "_idx", "left")
    return j.select(key, "pos", F.col("token").alias("label"), F.when(F.col("_v") < 0.8, "[MASK]").when(F.col("_v") < 0.9, F.col("token")).otherwise(F.col("_symbol")).alias("shown"))


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """An array cut or padded on the right to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), length)), 1, length)


def collated(ids: Column, length: int, pad: int = 0, left: bool = False, eos_first: int | None = None) -> Column:
    """Padded to a length on either side; ``eos_first`` moves that closing number to the front."""
    x = ids
    if eos_first is not None:
        n = F.size(ids)
        x = F.when((n > 0) & (F.element_at(ids, -1) == eos_first), F.concat(F.slice(ids, n, 1), F.slice(ids, F.lit(1), n - 1))).otherwise(ids)
    fill = F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(length) - F.size(x), F.lit(0)))
    return F.slice(F.concat(fill, x) if left else F.concat(x, fill), 1, length)


def fitting(df: DataFrame, sizes: dict[str, int | None]) -> DataFrame:
    """``kept``: all sizes within their limits; no limit is None.  Rows are tagged, not dropped."""
    ok = F.lit(True)
    for col, most in sizes.items():
        if most is not None:
            ok = ok & (F.coalesce(F.col(col), F.lit(0)) <= most)
    return df.withColumn("kept", ok)


def truncated_ids(ids: Column, length: int) -> Column:
    """Numbers outside a shorter vocabulary to ``<unk>``."""
    return F.transform(ids, lambda i: F.when(i < length, i).otherwise(SPECIALS.index("<unk>")))


def packed(sizes: Column, most: int) -> Column:
    """Block number of each sentence when whole sentences are packed greedily into blocks of at most ``most`` tokens."""
    start = F.struct(F.lit(0).alias("block"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, n: Column) -> Column:
        new = (acc["used"] > 0) & (acc["used"] + n > most)
        block = acc["block"] + new.cast("int")
        return F.struct(block.alias("block"), F.when(new, n).otherwise(acc["used"] + n).cast("int").alias("used"), F.concat(acc["out"], F.array(block)).alias("out"))

    return F.aggregate(sizes, start, add, lambda acc: acc["out"])


def next_sentence_pairs(sentences: DataFrame, key: str, part: tuple[str, ...] = ()) -> DataFrame:
    """``key, part, n, first, second, is_next``: each sentence (``key, part, n, sentence``) with its successor, or, by a
    hashed coin, with the sentence two further on."""
    w = Window.partitionBy(key, *part).orderBy("n")
    s = sentences.withColumn("_1", F.lead("sentence").over(w)).withColumn("_3", F.lead("sentence", 3).over(w))
    random = (uniform(F.col(key), F.col("n")) < 0.5) & F.col("_3").isNotNull()
    return s.where(F.col("_1").isNotNull()).select(key, *part, "n", F.col("sentence").alias("first"), F.when(random, F.col("_3")).otherwise(F.col("_1")).alias("second"), (~random).alias("is_next"))


def trimmed_pair(a: Column, b: Column, most: int) -> Column:
    """Two token arrays cut at their ends until together they hold at most ``most``; the longer one is cut first."""
    over = F.greatest(F.size(a) + F.size(b) - most, F.lit(0))
    first = F.least(over, F.greatest(F.size(a) - F.size(b), F.lit(0)))
    second = F.least(over, F.greatest(F.size(b) - F.size(a), F.lit(0)))
    rest = over - first - second
    na = F.size(a) - first - F.ceil(rest / 2).cast("int")
    nb = F.size(b) - second - F.floor(rest / 2).cast("int")
    return F.struct(F.slice(a, F.lit(1), F.greatest(na, F.lit(0))).alias("a"), F.slice(b, F.lit(1), F.greatest(nb, F.lit(0))).alias("b"))
