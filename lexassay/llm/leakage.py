"""Held-out test items that leaked into a corpus.

Texts are compared as the letters and figures of their canonical form, lower case.  Tokens are ideographs,
words and figures; seeds are token n-grams.

1. *Classes*: items of equal text are one class with its members.
2. *Statistics* over all items, by exchanges bounded by the items' own text: how many classes hold each
   sentence and each n-gram.  A sentence that ``STOCK`` classes share word for word is a stock instruction:
   it gives no seeds and counts neither as matched, unless the item would keep less than ``SHARE`` of itself.
3. *Seeds*: an n-gram weighs the less the more classes hold it (inverse document frequency).  The seeds of an
   item are its n-grams, rarest first, up to ``KEPT`` of their weight.  How many documents quote an n-gram
   does not matter: a popular leak keeps all its seeds.
4. *Seed join*: the seeds are broadcast in blocks of at most ``BLOCK_BYTES`` of text and documents are looked
   up against them where they are: no document is shuffled, so no hot group can arise.  The statistics are
   those of all items, so the answer does not depend on the blocks.
5. *Alignment*: for each pair whose seeds near one diagonal weigh at least ``SEED_SHARE`` of the item's,
   Smith-Waterman local alignment of the item with that stretch of the document, scored on characters; the
   pair is kept if the characters of the item that are matched in the one best passage reach ``SHARE``.

Short items have shorter seeds, down to ``SHORTEST`` tokens and at most the whole item.
Null or empty texts give no rows, repeated documents and equal items are each reported, texts are compared whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexassay.functions.lineage import cut_lineage

from .canonical import canonical

N, SHORTEST = 5, 3
#: Share of an item's text that has to be found as one passage.
SHARE = 0.4
#: So many classes of items sharing a sentence (of more than LEAST_STOCK characters) make it stock text.
STOCK, LEAST_STOCK = 3, 5
#: Share of the weight of its n-grams that an item keeps as seeds, the rarest first.
KEPT = 0.9
#: Text of the items looked up at once.
BLOCK_BYTES = 16 << 20
#: Least share of the weight of an item's seeds near one diagonal.  A leak covers two fifths of the item, so
#: even with every second of its n-grams edited it shows twice this share.
SEED_SHARE = 0.1
MATCH, MISMATCH, GAP = 2, -3, -3

_CJK = "㐀-鿿豈-﫿\U00020000-\U0003ffff぀-ヿ"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_SENTENCE_END = re.compile(r"(?<=[。.!?！？])\s*|\n+")


def _find_tokens(canonical_text: str) -> list[str]:
    return _TOKEN.findall(canonical_text.lower())


def tokens(text: str) -> tuple[list[str], list[int], str]:
    """Tokens, the place of each in the bare text, and the bare text."""
    toks = _find_tokens(canonical(text))
    return toks, list(accumulate(map(len, toks), initial=0)), "".join(toks)


class _Hashes(dict):
    def __missing__(self, t: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[t] = h = int.from_bytes(md5(t.encode("utf-8", "surrogatepass")).digest()[:8], "little")
        return h


_hashes = _Hashes()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def grams(toks: list[str], n: int = N) -> np.ndarray:
    """Hashes of the token n-grams of a text."""
    return _grams(np.fromiter(map(_hashes.__getitem__, toks), np.uint64, len(toks)), n)


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    size = max(0, len(ids) - n + 1)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h += ids[j : j + size] * _FACTORS[j]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def seed_length(n_tokens: int) -> int:
    """Tokens of a seed: no longer than the passage that makes a case, nor than the item."""
    return min(N, n_tokens, max(SHORTEST, math.ceil(SHARE * n_tokens)))


# --- items ----------------------------------------------------------------------------------------------

_PARTS = "cls binary, item_id long, bare string, at array<int>, ends array<int>, keys array<long>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as bare text with the places of their tokens, the ends of their sentences, and the hashes of
    sentences (odd) and n-grams (even)."""
    for b in batches:
        rows = []
        for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
            toks, ends, keys = [], [], []
            for piece in _SENTENCE_END.split(canonical(text)):
                if own := _find_tokens(piece):
                    toks += own
                    ends.append(len(toks))
                    keys.append(int.from_bytes(md5("".join(own).encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True) | 1)
            if toks:
                bare = "".join(toks)
                at = list(accumulate(map(len, toks), initial=0))
                keys += (grams(toks, seed_length(len(toks))).view(np.int64) & ~1).tolist()
                rows.append((md5(bare.encode("utf-8", "surrogatepass")).digest(), item, bare, at, ends, keys))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cls", "item_id", "bare", "at", "ends", "keys"])


def item_classes(eval_items: DataFrame) -> DataFrame:
    """``cls, bare, at, ends, keys, ids, shared``: one row for each different item text.

    ``shared`` maps the hashes of its sentences and n-grams that other classes hold as well to the number
    of classes that do.
    """
    parts = eval_items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(_parts, _PARTS)
    first = ("bare", "at", "ends", "keys")
    classes = cut_lineage(parts.groupBy("cls").agg(*[F.first(c).alias(c) for c in first], F.sort_array(F.collect_set("item_id")).alias("ids")))
    keys = classes.select("cls", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    by_class = keys.join(shared, "key").groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("shared"))
    return cut_lineage(classes.join(by_class, "cls", "left"))


class Items:
    """The items of one block prepared for lookup; ``total`` is the number of classes of all blocks."""

    def __init__(self, rows: list, total: int) -> None:
        self.ids = [list(r["ids"]) for r in rows]
        self.bare: list[str] = [r["bare"] for r in rows]
        self.stock: list[np.ndarray] = []
        self.size = [len(t) for t in self.bare]
        self.weight = np.zeros(len(rows))
        found: dict[int, list] = defaultdict(list)
        for k, r in enumerate(rows):
            at, ends, keys, shared = np.array(r["at"]), r["ends"], r["keys"], r["shared"] or {}
            mask = np.ones(self.size[k], np.int64)
            for a, b, key in zip([0, *ends], ends, keys):
                if shared.get(key, 1) >= STOCK and at[b] - at[a] > LEAST_STOCK:
                    mask[at[a] : at[b]] = 0
            if mask.sum() < SHARE * self.size[k]:
                mask[:] = 1
            self.stock.append(mask)
            n = seed_length(len(at) - 1)
            own = np.array(keys[len(ends) :], np.int64)
            held = np.array([shared.get(x, 1) for x in keys[len(ends) :]], np.float64)
            where = np.flatnonzero(mask[at[: len(own)]] if len(own) else [])
            weight = np.log1p(total / held[where]) / math.log1p(total)
            # rarest first, up to KEPT of the weight; n-grams as rare as the last one stay too
            order = np.argsort(-weight, kind="stable")
            enough = np.searchsorted(np.cumsum(weight[order]), KEPT * weight.sum() - 1e-9)
            kept = weight >= weight[order[min(enough, len(order) - 1)]] - 1e-12 if len(order) else np.zeros(0, bool)
            self.weight[k] = weight[kept].sum()
            where, weight = where[kept], weight[kept]
            found[n].append((own[where], np.full(len(where), k), at[where], weight))
        #: By length of seed: hashes in order, and of each posting its item, place in the item and weight.
        self.seeds = {}
        for n, parts in found.items():
            key, item, place, weight = map(np.concatenate, zip(*parts))
            order = np.argsort(key, kind="stable")
            self.seeds[n] = (key[order], item[order].astype(np.int32), place[order].astype(np.int32), weight[order].astype(np.float32))


#: Alignments computed side by side.
SIDE_BY_SIDE = 48


def align_many(items: list[str], weights: list[np.ndarray], texts: list[str]) -> list[int]:
    """For each item the characters matched in its best local alignment with its text; weight 0: not counted.

    Smith-Waterman with linear gaps, a row at a time and many pairs side by side.  Score and matched
    characters share one integer, so that the best score carries its count along.
    """
    out = [0] * len(items)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(texts[i])))
    for at in range(0, len(order), SIDE_BY_SIDE):
        some = [i for i in order[at : at + SIDE_BY_SIDE] if items[i] and texts[i]]
        if some:
            for i, n in zip(some, _align_block([items[i] for i in some], [weights[i] for i in some], [texts[i] for i in some])):
                out[i] = n
    return out


def _codes(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), fill, np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _align_block(items: list[str], weights: list[np.ndarray], texts: list[str]) -> list[int]:
    bits = 24
    s, t = _codes(items, -1), _codes(texts, -2)
    w = np.zeros(s.shape, np.int64)
    for i, x in enumerate(weights):
        w[i, : len(x)] = x
    gap, miss, one = np.int64(-GAP) << bits, np.int64(MISMATCH) << bits, np.int64(1) << bits
    hit = w * ((np.int64(MATCH) << bits) + 1)  # what does not count scores nothing, else stock text could be the best passage
    ramp = np.arange(t.shape[1] + 1, dtype=np.int64) * gap
    row = np.zeros((len(items), t.shape[1] + 1), np.int64)
    new = np.zeros_like(row)
    best = np.zeros(len(items), np.int64)
    for i in range(s.shape[1]):
        step = np.where(t == s[:, i : i + 1], hit[:, i : i + 1], miss)
        step += row[:, :-1]
        np.maximum(step, row[:, 1:] - gap, out=new[:, 1:])
        new[:, 0] = 0
        new[new < one] = 0
        new += ramp
        np.maximum.accumulate(new, axis=1, out=new)
        new -= ramp
        new[new < one] = 0
        row, new = new, row
        np.maximum(best, row.max(axis=1), out=best)
    return [int(x) & ((1 << bits) - 1) for x in best]


def align(item: str, weight: np.ndarray, text: str) -> int:
    """``align_many`` for one pair."""
    return align_many([item], [weight], [text])[0]


def hits(items: Items, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Seeds found in texts given as one array of token hashes: token, item, place in the item, weight of each hit."""
    out = []
    for n, (keys, item, place, weight) in items.seeds.items():
        h = _grams(ids, n).view(np.int64) & ~1
        lo = np.searchsorted(keys, h, "left")
        at = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h) if len(keys) else np.zeros(0, np.int64)
        text = np.searchsorted(starts, at, "right")
        at = at[np.searchsorted(starts, at + n - 1, "right") == text]  # within one text
        lo = lo[at]
        many = np.searchsorted(keys, h[at], "right") - lo
        posting = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        out.append((np.repeat(at, many), item[posting], place[posting], weight[posting]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 4


def stretches(size: int, least: float, diagonals: list[int], weights: list[float], length: int) -> list[tuple[int, int]]:
    """Stretches of a document around the diagonals whose seeds weigh at least ``least``, densest first."""
    slack = max(24, size // 5)
    bands: Counter = Counter()
    for d, w in zip(diagonals, weights):
        bands[d // slack] += w
    out: list[tuple[int, int]] = []
    for band, _ in bands.most_common():
        if bands[band] + max(bands.get(band + 1, 0), bands.get(band - 1, 0)) < least:
            continue
        lo, hi = max(0, (band - 1) * slack), min(length, (band + 2) * slack + size)
        if not any(a <= lo + slack and hi - slack <= b for a, b in out):
            out.append((lo, hi))
    return out


def leaked(items: Items, texts: list[str | None], share: float = SHARE) -> list[tuple[int, int]]:
    """``(place in texts, item id)`` of the items found in texts; equal texts are judged once."""
    copies: dict[str, list[int]] = defaultdict(list)
    for n, text in enumerate(texts):
        if text:
            copies[text].append(n)
    if not copies or not items.seeds:
        return []
    own = [tokens(t) for t in copies]
    starts = np.cumsum([0] + [len(toks) for toks, _, _ in own])
    ids = np.fromiter((_hashes[t] for toks, _, _ in own for t in toks), np.uint64, int(starts[-1]))
    at, item, place, weight = hits(items, ids, starts[1:])
    text = np.searchsorted(starts[1:], at, "right")
    pair, group = np.unique(text * len(items.ids) + item, return_inverse=True)
    least = SEED_SHARE * items.weight[pair % len(items.ids)] - 1e-6
    enough = np.bincount(group, weight, len(pair)) >= least if len(pair) else np.zeros(0, bool)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(len(pair) + 1))
    waiting = []
    for p in np.flatnonzero(enough).tolist():
        t, k = divmod(int(pair[p]), len(items.ids))
        own_hits = order[bounds[p] : bounds[p + 1]]
        places = own[t][1]
        diagonals = [places[i - starts[t]] - q for i, q in zip(at[own_hits].tolist(), place[own_hits].tolist())]
        if where := stretches(items.size[k], least[p], diagonals, weight[own_hits].tolist(), places[-1]):
            waiting.append((t, k, where))
    found, turn = [], 0
    while waiting:  # the densest stretch of every pair first, the next one only where that was not enough
        got = align_many([items.bare[k] for _, k, _ in waiting], [items.stock[k] for _, k, _ in waiting], [own[t][2][slice(*where[turn])] for t, _, where in waiting])
        rest = []
        for pair, n in zip(waiting, got):
            if n >= share * items.size[pair[1]]:
                found.append(pair[:2])
            elif len(pair[2]) > turn + 1:
                rest.append(pair)
        waiting, turn = rest, turn + 1
    where = list(copies.values())
    return [(n, i) for t, k in found for n in where[t] for i in items.ids[k]]


def leaks(documents: DataFrame, eval_items: DataFrame, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id`` for every document that contains an item, wholly or in part."""
    spark = documents.sparkSession
    classes = item_classes(eval_items)
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("bare") + 8 * F.size("ids")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["bytes"] // block_bytes))
    out = None
    for block in range(blocks):
        part = classes.where(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Items(part.collect(), size["n"]))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                docs = b.column("doc_id").to_pylist()
                got = leaked(shared.value, b.column("text").to_pylist(), share)
                ids, found = [docs[n] for n, _ in got], [item for _, item in got]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        got = documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(find, "doc_id long, item_id long")
        out = got if out is None else out.unionByName(got)
    return out
