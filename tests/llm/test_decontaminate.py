"""Passages against a plain search for the fewest edits in any stretch of a text, and hostile texts."""

from __future__ import annotations

import random
import time

import pytest

from flowlab.llm import decontaminate


def fewest_edits(passage: str, text: str) -> int:
    """Edits between the passage and the stretch of the text that is nearest to it, row by row."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def found(texts: list[str], items: list[str]) -> dict[tuple[int, int], int]:
    out = {}
    for passages in decontaminate.both_lengths(list(enumerate(items))):
        for (t, w), (e, _) in decontaminate.hits(texts, passages).items():
            out[t, passages.item[w]] = e
    return out


def wanted(texts: list[str], items: list[str]) -> dict[tuple[int, int], int]:
    out = {}
    for i, item in enumerate(items):
        for t, text in enumerate(texts):
            plain, passage = (" ".join(x.lower().split()) for x in (text, item))
            edits = fewest_edits(passage, plain)
            if len(passage) >= decontaminate.Q and edits <= decontaminate.budget(len(passage)):
                out[t, i] = edits
    return out


def edited(r: random.Random, text: str, edits: int) -> str:
    chars = list(text)
    for _ in range(edits):
        at = r.randrange(len(chars))
        kind = r.randrange(3)
        if kind == 0:
            chars[at] = r.choice("abcdefg ")
        elif kind == 1:
            chars.insert(at, r.choice("abcdefg"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("letters", ["abcdefghijklmnop ", "ab ", "a"])
def test_equals_a_search_of_all_places(letters):
    r = random.Random(len(letters))
    items = ["".join(r.choice(letters) for _ in range(m)) for m in (8, 9, 12, 20, 30, 31, 39, 40, 41, 64, 90, 130)]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(25)]
    for item in items:
        m = len(item)
        for edits in {0, 1, m // 10, m // 10 + 1}:
            texts.append("".join(r.choice(letters) for _ in range(30)) + edited(r, item, edits) + "".join(r.choice(letters) for _ in range(30)))
    mine, theirs = found(texts, items), wanted(texts, items)
    assert mine == theirs and theirs


def test_a_passage_that_repeats_itself_within_other_text():
    items = ["x" * 300, "ab" * 200 + "the end of it all", "once upon a time there was " + "z" * 60]
    texts = [edited(random.Random(3), f"before it {i} and after", n) for i in items for n in (0, 3)] + ["x" * 269, "x" * 270, "ab" * 100]
    assert found(texts, items) == wanted(texts, items)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ab" * 500_000, "a b " * 250_000])
def test_repetition_takes_linear_time(text):
    items = ["a" * 1000, "ab" * 400, "a b " * 200, "some plain passage that stands in no text of this test at all", text[:777]]
    start = time.perf_counter()
    got = found([text], items)
    assert time.perf_counter() - start < 20
    assert got[0, 4] == 0


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    r = random.Random(4)
    items = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    docs = spark.createDataFrame([(i, f"so {x} it is") for i, x in enumerate(items)] + [(99, "clean")], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = sorted(map(tuple, decontaminate.found(docs, bench).collect()))
    assert len(rows) == 12
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert sorted(map(tuple, decontaminate.found(docs, bench).collect())) == rows
    assert [x.doc_id for x in decontaminate.cleaned(docs, bench).collect()] == [99]
