"""Ids against the tokenizers library: every character in places where words end, and random strings."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlab.llm.token_output import WordEncoder


def unequal(file: str, texts: list[str]) -> list[str]:
    mine, theirs = WordEncoder(file), Tokenizer.from_file(file)
    bad = []
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        coded = theirs.encode_batch(part, add_special_tokens=False)
        bad += [t for t, a, b in zip(part, mine.encode(part), coded) if a.tolist() != b.ids]
    return bad


def random_texts(n: int) -> list[str]:
    r = random.Random(8)
    pool = ["\u0130", "\u0958", "e\u0301", "\u00df", "\u1e9e", "\ufb01", "'s", "'", ".", ",", " ", "\n", "\t", "\x0b", "1", "a", "B", "\u00c9", "\u4e2d", "\u0301", "<|endoftext|>", "<|", "\u01c5", "\u0149"]
    return ["".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(n)]


def test_every_character_before_a_word_end():
    chars = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    assert unequal(public_tokenizers.path("word_bpe_49k.json"), [t for c in chars for t in (f"{c}, b", f"a{c}.")]) == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_strings(name):
    assert unequal(public_tokenizers.path(name), ["", *random_texts(100_000)]) == []
