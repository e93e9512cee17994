"""The pipeline's stages against plain Python, whole rows, one after the other."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from souk.llm import hd_language, queries
from tests.conftest import SF_SMALL
from tests.llm.test_op6_short_sets import by_force
from tests.llm.test_op9_long_lines import verdicts
from tests.llm.test_operators import ASSIGN, base_spans

COLUMNS = corpus_pipeline.COLUMNS


def bundle(text: str | None) -> np.ndarray:
    """Sum over the text's letter trigrams of the product of their shifted vectors."""
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
    out = np.zeros(hd_language.DIMENSIONS)
    if not words:
        return out
    line = " " + " ".join(words) + " "
    grams = Counter(line[i:i + 3] for i in range(len(line) - 2))
    for gram, n in grams.items():
        codes = [0 if c == " " else ord(c) for c in gram]
        a, b, c = (hd_language.letter_vector(x) for x in codes)
        out += n * np.roll(a, 2) * np.roll(b, 1) * c
    return out / np.linalg.norm(out) if out.any() else out


def languages(rows):
    sums = defaultdict(lambda: np.zeros(hd_language.DIMENSIONS))
    for r in rows:
        if r.lang is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sums[r.lang] += np.rint(bundle(r.text) * hd_language.UNIT)
    units = [v / np.linalg.norm(v) for v in sums.values()]
    return [r for r in rows if (v := bundle(r.text)).any()
            and max(float(v @ u) for u in units) >= corpus_pipeline.MIN_LANGUAGE_SCORE]


def made(r, text):
    return r if text == r.text else type(r)(r.doc_id, text, r.lang, r.source, len(text))


def quality(rows):
    judged = {doc_id: (gone, kept) for doc_id, gone, _, kept in verdicts(rows)}
    out = []
    for r in rows:
        gone, kept = judged[r.doc_id]
        if kept:
            lines = (r.text or "").split("\n")
            out.append(made(r, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def copies(rows):
    stays = set(by_force(rows).values())
    return [r for r in rows if r.doc_id in stays]


def secrets(rows):
    spans, owners = {}, defaultdict(set)
    for r in rows:
        base = base_spans(r.text)
        tokens = [(m.start(), 3, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", r.text)
                  if all(re.search(x, m[0]) for x in ("[0-9]", "[a-z]", "[A-Z]"))
                  and not any(s < m.end() and m.start() < e for s, _, e in base)]
        spans[r.doc_id] = sorted(base + tokens)
        for s, kind, e in spans[r.doc_id]:
            value = ASSIGN.fullmatch(r.text[s:e])[2] if kind == 0 else r.text[s:e]
            owners[value].add(r.source)
    out = []
    for r in rows:
        text, top = "", 0
        for s, kind, e in spans[r.doc_id]:
            if kind == 3 and len(owners[r.text[s:e]]) >= 3:
                continue
            if s >= top:
                text += r.text[top:s] + "[SECRET]"
            top = max(top, e)
        out.append(made(r, text + r.text[top:]))
    return out


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*COLUMNS)
    steps = [languages, quality, copies, secrets]
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], steps):
        rows = docs.collect()
        got = spark.createDataFrame(stage(spark, docs, SF_SMALL).collect(), docs.schema)
        want = plain(rows)
        assert 0 < len(want) <= len(rows)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want)), name
        docs = got
    # packing: every id of every document once, in gapless sequences of at most 4096
    tok = Tokenizer.from_file(queries.WORD_BPE)
    ids = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF_SMALL).collect():
        assert bytes(r.ids) == ids[r.doc_id][r.start:r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for found in (pieces, sequences):
        for name, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == len(ids[name]) if found is pieces else at <= 4096
