"""Every text is like its own edited text."""

from __future__ import annotations

import time

import numpy as np

from souk.llm import syncmers
from tests.conftest import SF_SMALL


def test_edited_texts_keep_anchors(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz    "))
    for n in range(1, 200):
        for other in (n, n // 3, 0):
            text, following = ("".join(rng.choice(letters, m)) for m in (n, other))
            a = syncmers.anchors(text)
            assert syncmers.likeness(a, syncmers.anchors(syncmers.edited_with(text, following))) > 0
            assert syncmers.likeness(a, a) == 1
    rows = syncmers.fingerprints(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    assert all(r.near_edited > 0 for r in rows if r.n_chars)


def test_edits_far_apart_keep_most(spark):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3000))
    changed = "".join("#" if i % 40 == 20 else c for i, c in enumerate(text))
    assert syncmers.likeness(syncmers.anchors(text), syncmers.anchors(changed)) > 0.4


def test_repeated_anchors_do_not_multiply():
    a, b = np.tile(np.arange(3, dtype="u4"), 8000), np.tile(np.arange(2, -1, -1, dtype="u4"), 8000)
    began = time.monotonic()
    assert syncmers.likeness(a, b) > 0.3
    assert time.monotonic() - began < 20


def test_one_more_character_changes_little():
    """No length at which the fingerprint takes another form."""
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz    ")
    for n in range(1, 260):
        text = "".join(rng.choice(letters, n))
        for more in (text + "x", "x" + text, text[:n // 2] + "x" + text[n // 2:]):
            near = syncmers.likeness(syncmers.anchors(text), syncmers.anchors(more))
            assert near > (0.5 if n >= 20 else 0.2), (n, near)


def test_closed_syncmers_by_definition():
    """The places by the definition on plain strings, with the module's hash of s-mers."""
    rng = np.random.default_rng(7)
    for k, s in ((16, 8), (7, 3), (5, 5), (9, 1)):
        for n in (0, 4, 5, 16, 40, 300):
            text = "".join(rng.choice(list("ab é漢"), n))
            codes = np.array([ord(c) for c in text], np.uint64)
            order = [int(x) for x in syncmers._poly(codes, s)]
            want = []
            for i in range(n - k + 1):
                inner = order[i:i + k - s + 1]
                if min(inner) in (inner[0], inner[-1]):
                    want.append(i)
            grams = n and len({*range(min(24, n + 2)), *range(max(0, n + 1 - 23), n + 2)})
            assert len(syncmers.anchors(text, k, s)) == (len(want) + grams or 1), (k, s, n)
            # equal k-mers are syncmers wherever they stand, and have one hash
            twice = syncmers.anchors(text + "#" * k + text, k, s)
            assert len(want) == 0 or len(set(syncmers.anchors(text, k, s)) & set(twice)) > 0
