"""op1's bounded tables, and texts that meet each way past them, against the library."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from souk.llm import bpe_automaton as bpe
from souk.llm import queries


@pytest.fixture(scope="module")
def spec():
    return bpe.read_spec(queries.BYTE_BPE)


@pytest.fixture(scope="module")
def automaton(spec):
    return bpe.Automaton.from_spec(spec)


def texts():
    rng = random.Random(3)
    parts = ["the", "tion", "straße", "naïve", "漢字", "é", "x1", "12", "don't", "it's", "", "a.b", "'", " ", "²", "ʰ", "́"]
    marks = ["", "", ".", ",", "..", ",.", "'", ".\nThe", ", a", "!", "\t"]
    out = ["", " ", ".", ",", " .", "a.", "a .", "a ,b", "  a.  b,", "the. ", "1. 2,", "word.'s x", "é. É,", "ʰ. ²,"]
    for _ in range(400):
        out.append(" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(4))) + rng.choice(marks)
                            for _ in range(rng.randrange(12))))
    return out


@pytest.mark.parametrize("limit,begun", [(200_000, 7), (1, 7), (3, 1), (50, 0)])
def test_equals_the_library_with_tables_of_any_size(monkeypatch, automaton, limit, begun):
    monkeypatch.setattr(bpe, "TABLE_LIMIT", limit)
    monkeypatch.setattr(bpe, "BEGUN", begun)
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    encoder = bpe.Encoder(automaton)
    for text in texts():
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == want, text
    assert all(len(t) <= limit and len(t.older) <= limit
               for t in (encoder.words, encoder.after_space, encoder.begun, encoder.arcs, encoder.step))


def test_a_full_table_keeps_what_is_asked_for_again(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_LIMIT", 4)
    made = []
    table = bpe._Table(lambda key: made.append(key) or key)
    for i in range(100):
        assert table["often"] == "often" and table[str(i)] == str(i)
    assert made.count("often") == 1 and len(made) == 101
    assert table["x" * 100] == "x" * 100 and not any(len(k) > 40 for k in [*table, *table.older])


def test_a_word_begins_where_others_did(automaton):
    encoder = bpe.Encoder(automaton)
    encoder.encode_word(b" internationally")
    kept = dict(encoder.begun)
    assert list(kept) == [b" internationally"[:bpe.BEGUN]]
    for word in (b" internal", b" interns", b" inter", b" i"):
        assert encoder.encode_word(word) == bpe.Encoder(automaton).encode_word(word)
    assert encoder.begun.keys() == kept.keys()
    assert encoder.begun == kept


def test_decoding_needs_no_automaton(spec, monkeypatch):
    monkeypatch.setattr(bpe.Automaton, "from_spec", None)
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    decoder = bpe.Decoder(*bpe.read_labels(json.loads(spec)))
    lists = [tok.encode(t, add_special_tokens=False).ids for t in texts()] + [list(range(0, 50_000, 7))]
    ends = np.cumsum([0, *map(len, lists)])
    assert decoder.decode(np.concatenate([np.array(x, int) for x in lists]), ends) == [
        tok.decode(x, skip_special_tokens=False) for x in lists]
