"""Equal-looking texts: ends of items, hot spellings, letters of other scripts."""

import pytest

from lexassay.llm import canonical as C

from .test_llm import _questions


def _pairs(spark, rows, **more):
    got = [tuple(r) for r in C.same_looking_pairs(C.question_texts(_questions(spark, rows)), **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_ends_of_items_count(spark):
    lists = [["a", "b"], ["a\nb"], ["a\x1e", "b"], ["a", "b\u200b"], ["ab"], ["a", "", "b"], ["a", None, "ｂ"], ["", "ab"]]
    rows = [(i, 1.0, None, None, x, None) for i, x in enumerate(lists)]
    # 2 holds a control character, which draws nothing
    assert _pairs(spark, rows) == {(0, 2, "solutions"), (0, 3, "solutions"), (2, 3, "solutions"), (5, 6, "solutions")}


@pytest.mark.parametrize("block", [3, 1000])
def test_hot_spellings_are_split(spark, block):
    rows = [(i, 1.0, "boiler plate" if i < 25 else "boiler\u00a0plate" if i < 45 else "boiler\u2003plate", None, None, None) for i in range(50)]
    group = lambda i: 0 if i < 25 else 1 if i < 45 else 2
    assert _pairs(spark, rows, block=block) == {(i, j, "description") for i in range(50) for j in range(i + 1, 50) if group(i) != group(j)}


@pytest.mark.parametrize("a, b", [("ԌԚԜ", "GQW"), ("ᎪᎳ", "AW"), ("ⲞⲢ", "OP"), ("ꓮꓐꓚ", "ABC"), ("ɡ", "g"), ("ρ", "p")])
def test_letters_of_other_scripts(a, b):
    assert C.canonical(a) == b


def test_the_dotless_i_is_drawn_otherwise():
    assert C.canonical("ı") != "i"


def test_tables_of_lookalikes_fit():
    for a, b in [*C.LOOKALIKES.values(), C.RADICALS]:
        assert len(a) == len(b)
    folded = [c for a, _ in C.LOOKALIKES.values() for c in a]
    assert len(folded) == len(set(folded))
