"""Words of many texts are cut together, with the library's ids."""

import random

import numpy as np
import public_tokenizers
import pytest

from fraylens.llm import words
from fraylens.llm.words import WordEncoder, load

WORDS = public_tokenizers.path("word_bpe_49k.json")
PLAIN = [" ", "\n", "a", "s", "t", "m", "d", "re", "VE", "ll", "l", "r", "'", "'", "'s", "!", "1", "É", "é", "ß", "ÿ"]
ODD = [*PLAIN, "\t", "\x0b", "\x0c", "\x1c", "\x7f", "\x85", "\xa0", "×", "÷", "µ", "²", "«", "Ā", "İ", "́", "̧", "’", "Σ", "日", "😀", "<|", "<|endoftext|>"]


@pytest.mark.parametrize("together", [1, 60, 4_000_000])
def test_cuts_equal_the_library(monkeypatch, together):
    monkeypatch.setattr(words, "SIDE_BY_SIDE", together)
    dice, library, encoder = random.Random(together), load(WORDS), WordEncoder(WORDS, limit=200)
    for k in range(120):
        texts = ["".join(dice.choices(ODD if k % 3 == 0 else PLAIN, k=dice.randint(0, 25))) for _ in range(dice.randint(0, 30))]
        assert encoder.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_plain_chunks_are_not_cut_one_by_one(monkeypatch):
    asked = []
    pieces = WordEncoder.pieces
    monkeypatch.setattr(WordEncoder, "pieces", staticmethod(lambda chunk: asked.append(chunk) or pieces(chunk)))
    encoder = WordEncoder(WORDS)
    texts = [" ".join(f"Été{i},{k}isn't" for i in range(50)) for k in range(50)]  # 2,500 chunks of 14 words
    library = load(WORDS)
    assert encoder.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert not asked and len(encoder.words) == 14
    encoder.encode(["plain «odd» plain"])
    assert asked == ["«odd»".encode()]


def test_a_full_memory_keeps_the_latest_words(monkeypatch):
    encoder, merged = WordEncoder(WORDS, limit=20), []
    resolve = encoder.resolve
    monkeypatch.setattr(encoder, "resolve", lambda w: merged.extend(w) or resolve(w))
    encoder.encode([" ".join(f"old{chr(97 + i)}" for i in range(15))])
    latest = [" ".join(f"new{chr(97 + i)}" for i in range(15))]
    first = encoder.encode(latest)
    assert len(merged) == 30 and len(encoder.words) == 15
    assert encoder.encode(latest) == first and len(merged) == 30
