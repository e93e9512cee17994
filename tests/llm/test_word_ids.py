"""The table of words of op2, op10 and the pipeline against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from souk.llm import packing, queries
from souk.llm.bpe_automaton import read_spec


@pytest.fixture(scope="module")
def spec():
    return read_spec(queries.WORD_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORD_BPE)


def same(words, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(text), "<u4").tolist() == want, text


@pytest.mark.parametrize("limit", [1, 7, 800_000])
def test_equals_the_library_with_tables_of_any_size(monkeypatch, spec, library, limit):
    monkeypatch.setattr(packing, "TABLE_LIMIT", limit)
    rng = random.Random(7)
    parts = ["The", "tion", "STRASSE", "straße", "Naïve", "ÀÉÎ", "ÿ", "µ", "x1", "12", "²", "ª", "don't", "IT'S", "a.b", "'", "_",
             "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|", "x" * 50]
    wide = ["漢字", "Ÿ", "İ", "ΣΑΣ", "ʰ", "É", "é", " ", "　"]
    marks = ["", "", ".", ",", ".###", ",***", "'", "''", "'.", "_", "%%%", "$$$&", "\\^`", "{|}~", "<=>@", "[/]", "\x85", "\xa0", "\x1c"]
    words = packing.WordIds(spec)
    for i in range(600):
        some = parts + wide if i % 3 == 0 else parts
        same(words, library, " ".join("".join(rng.choice(some) for _ in range(rng.randrange(1, 4))) + rng.choice(marks)
                                      for _ in range(rng.randrange(12))))
    assert len(words) <= limit


def test_every_latin1_character_beside_a_letter_and_an_ascii_mark(spec, library):
    words = packing.WordIds(spec)
    for c in map(chr, range(1, 256)):
        for text in (c, f"A{c}", f"{c}b", f"A{c}b", f"Ab.{c}", f"É{c} É."):
            same(words, library, text)


def test_forms_of_a_word_ask_the_tokenizer_once(monkeypatch, spec, library):
    """Capitals make no entry, and closing ASCII marks no way through the whole tokenizer
    for each word: what is new is asked for once."""
    words, asked = packing.WordIds(spec), []

    class Whole:
        def encode(self, word, **options):
            asked.append(word)
            return library.encode(word, **options)

    monkeypatch.setattr(words, "tokenizer", Whole())
    for text in ("nding NDING Nding nDing", "nding.### Éreau.### thhend.### NDING.###"):
        same(words, library, text)
    assert asked == [".###"]
    assert set(words) == {"nding", "nding.###", ".###", "éreau", "éreau.###", "thhend", "thhend.###"}
