"""The join at 5 words and 80 % against all pairs."""

from __future__ import annotations

from itertools import combinations

from souk.llm import adapt_join
from tests.llm.test_operators import GAP

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, words=5, percent=80) -> dict:
    """The least id of each document's component, over all pairs."""
    sets = {}
    for r in rows:
        w = [x for x in GAP.split((r.text or "").translate(LOWER)) if x]
        sets[r.doc_id] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(d for d in sets if sets[d]), 2):
        x, y = sets[a], sets[b]
        if (100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
                and 100 * len(x & y) >= percent * len(x | y)):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: find(d) for d in sets}


def components(docs, **how) -> dict:
    return {r.doc_id: r.component_id for r in adapt_join.similar_components(docs, **how).collect()}


def test_short_texts_of_frequent_words(spark):
    """Sets of 4 and 5 shingles whose shingles stand in about 40 texts each."""
    texts = []
    for g in range(6):
        w = [f"g{g}w{i}" for i in range(8)]
        texts += [" ".join(w), " ".join([*w, f"g{g}last"])]
        for i in range(4):
            texts += [" ".join([*w[i:i + 5], *(f"g{g}i{i}f{f}x{k}" for k in range(8))]) for f in range(38)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = by_force(docs.collect())
    assert sum(a != b for a, b in want.items()) == 6
    assert components(docs, words=5, percent=80) == want
