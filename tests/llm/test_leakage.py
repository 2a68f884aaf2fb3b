"""Leaked test items: recall whatever the repetition, classes of items, short items, blocks, brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexassay.llm import leakage

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(3)) for _ in range(600)]


def _text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in leakage.leaks(d, e, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("repeats", [1, 5, 20, 200])
@pytest.mark.parametrize("share", [0.55, 0.75, 1.0])
def test_recall_does_not_fall_with_repetition(spark, repeats, share):
    items = [(i, _text(40)) for i in range(10)]
    docs = [(100 + i, _text(60)) for i in range(40)]
    want = set()
    for i, t in items:
        for k in range(repeats):
            doc = 10_000 + 1000 * i + k
            docs.append((doc, f"{_text(15)} {' '.join(t.split()[: round(40 * share)])} {_text(15)}"))
            want.add((doc, i))
    assert _found(spark, docs, items) == want


@pytest.mark.parametrize("repeats", [1, 5, 20])
def test_recall_of_edited_copies(spark, repeats):
    items = [(i, _text(40)) for i in range(20)]
    docs, want = [(100 + i, _text(60)) for i in range(40)], set()
    for i, t in items:
        for k in range(repeats):
            passage = [RNG.choice(WORDS) if n % 8 == k % 8 else w for n, w in enumerate(t.split()[:24])]
            docs.append((10_000 + 1000 * i + k, f"{_text(15)} {' '.join(passage)} {_text(15)}"))
            want.add((docs[-1][0], i))
    found = _found(spark, docs, items)
    assert found <= want and len(found) >= 0.95 * len(want)


def test_equal_items_are_one_class_with_all_members(spark):
    same = _text(30)
    items = [(1, same), (2, same.upper()), (3, same.replace(" ", ", ")), (4, _text(30))]
    docs = [(1, f"{_text(20)} {same} {_text(20)}"), (2, _text(50))]
    assert _found(spark, docs, items) == {(1, 1), (1, 2), (1, 3)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 8, 11])
def test_short_items(spark, n):
    words = [f"zz{WORDS[i]}" for i in range(n)]
    items = [(1, " ".join(words)), (2, _text(30))]
    docs = [(1, f"{_text(20)} {' '.join(words)} {_text(20)}"), (2, _text(50)), (3, " ".join(words)), (4, ""), (5, None), (6, "。")]
    assert _found(spark, docs, items) == {(1, 1), (3, 1)}


def test_variants_of_an_item_are_no_stock_text(spark):
    sentences = [_text(8) + "." for _ in range(5)]
    items = [(i, " ".join([*sentences, f"variant {w}."])) for i, w in enumerate(["one", "two", "three", "four"])] + [(9, _text(40))]
    docs = [(1, f"{_text(20)}. {' '.join(sentences)} {_text(20)}"), (2, _text(60))]
    assert _found(spark, docs, items) == {(1, i) for i in range(4)}


def test_stock_instructions_do_not_leak(spark):
    stock = "read all of the following statements with care and choose the one that is right."
    items = [(i, f"{_text(20)}. {stock}") for i in range(6)]
    docs = [(1, f"{_text(20)}. {stock} {_text(20)}."), (2, f"{_text(9)}. {items[3][1]}")]
    assert _found(spark, docs, items) == {(2, 3)}


def test_blocks_do_not_change_the_answer(spark):
    items = [(i, _text(RNG.randint(3, 40)) + ". choose the answer that is right.") for i in range(60)]
    docs = []
    for d in range(150):
        own = [t for _, t in RNG.sample(items, 2)]
        docs.append((d, f"{_text(10)} {own[0][: len(own[0]) * RNG.randint(2, 10) // 10]} {_text(10)} {own[1]}"))
    one = _found(spark, docs, items)
    total = sum(len(t) for _, t in items)
    assert _found(spark, docs, items, block_bytes=total // 10) == one
    # brute force: every item aligned with every whole document
    classes = leakage.item_classes(spark.createDataFrame(items, "item_id long, text string")).collect()
    prepared = leakage.Items(classes, len(classes))
    bare = {d: leakage.tokens(t)[2] for d, t in docs}
    pairs = [(d, k) for d in bare for k in range(len(prepared.ids))]
    got = leakage.align_many([prepared.bare[k] for _, k in pairs], [prepared.stock[k] for _, k in pairs], [bare[d] for d, _ in pairs])
    want = {(d, i) for (d, k), n in zip(pairs, got) if n >= leakage.SHARE * prepared.size[k] for i in prepared.ids[k]}
    assert one <= want and len(one) >= 0.99 * len(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab 我你。", max_size=12), max_size=5), st.integers(1, 5))
def test_grams_of_a_batch_are_those_of_its_texts(texts, n):
    toks = [leakage.tokens(t)[0] for t in texts]
    rows = [{"ids": [i], "bare": "".join(t), "at": np.cumsum([0] + [len(x) for x in t]).tolist(), "ends": [], "keys": [], "shared": None} for i, t in enumerate(toks) if t]
    for r, t in zip(rows, [t for t in toks if t]):
        r["keys"] = (leakage.grams(t, leakage.seed_length(len(t))).view(np.int64) & ~1).tolist()
    items = leakage.Items(rows, len(rows))
    for r, t in zip(rows, [t for t in texts if leakage.tokens(t)[0]]):
        assert {i for _, i in leakage.leaked(items, [None, "", t])} >= {r["ids"][0]}
