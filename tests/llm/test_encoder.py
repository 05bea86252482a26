"""The piece encoder against the tokenizers library on whole texts: many scripts and signs, row edges, a small cache, and long texts in stretches."""

import random

import numpy as np
import pytest

from treedex.llm import common, tokens

PARTS = ["the", "I'll", "we're", "'s", "''t", "'", "rock'n'roll", "x's,'d", "ÉCOLE", "ñandú", "straße", "Ωmega ΣΑΣ", "é", "́", "漢字かな", "ば", "عربى", "हिन्दी", "İ", "ſ", "ŉ", "×÷", "«no»", "naïve—dash", "😀👍🏽", "\x00", "\x1c", "\x85", "\xa0", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>a", "1234", "a1b2", "_x_", "....", "supercalifragilisticexpialidocious" * 2, "‍", "ﬁ", "﻿"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def made(rng, n):
    return "".join(rng.choice(PARTS) + rng.choice(["", " ", "\n", "\t", "  ", ".", "\r\n", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("cache", [tokens.CACHE_PIECES, 40])
def test_random_texts(library, cache):
    rng, e = random.Random(9), tokens.WordEncoder(tokens.tokenizer_path(), cache_pieces=cache)
    assert e.by_piece
    for _ in range(150):
        texts = [made(rng, rng.randint(0, 12)) for _ in range(rng.randint(1, 8))]
        assert [x.tolist() for x in e.encode(texts)] == [library(t) for t in texts], texts
        raw = [t.encode() for t in texts]
        ids, n = e.block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert ids.tolist() == [i for t in texts for i in [*library(t), tokens.END_ID]] and n.tolist() == [len(library(t)) + 1 for t in texts]


def test_long_text_in_stretches(library, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 3000)
    rng, e = random.Random(1), tokens.WordEncoder(tokens.tokenizer_path())
    for text in (made(rng, 4000), "x" * 20000 + " y " + "é" * 9000, "word " * 5000):
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, n = e.stream(raw, np.array([0, len(raw)]))
        assert ids.tolist() == [*library(text), tokens.END_ID] and n.tolist() == [len(ids)]
