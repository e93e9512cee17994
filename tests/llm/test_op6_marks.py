"""Texts travel only for documents that their marks allow to be alike; the links stay all there are."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from souk.llm import adapt_join
from tests.llm.test_op6_short_sets import by_force, components


def unlike(n: int) -> list[str]:
    """Texts of their own words that all hold the same 30 rare passages."""
    shared = [" ".join(f"s{k}x{i}" for i in range(3)) for k in range(30)]
    return [" ".join(x for k in range(30) for x in (shared[k], *(f"d{d}w{k}x{i}" for i in range(4))))
            for d in range(n)]


def near(n: int, seed: int, most: int) -> list[str]:
    """Copies of one text with up to ``most`` words changed."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        w = [f"n{seed}w{i}" for i in range(240)]
        for at in rng.integers(0, 240, rng.integers(0, most + 1)):
            w[at] = f"y{rng.integers(0, 9999)}"
        out.append(" ".join(w))
    return out


@pytest.fixture
def tables(monkeypatch):
    """The rows of each table that the join writes, by its label."""
    seen: dict[str, list[int]] = {}
    write = adapt_join.stored

    def counted(df, label, *a, **b):
        out = write(df, label, *a, **b)
        seen.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(adapt_join, "stored", counted)
    return seen


def test_op6_unlike_texts_of_long_lists_do_not_travel(spark, monkeypatch, tables):
    monkeypatch.setattr(adapt_join, "SMALL_LIST", 8)
    monkeypatch.setattr(adapt_join, "HOT_TOKENS", 0)  # as beside many more frequent tokens
    docs = spark.createDataFrame(list(enumerate(unlike(80))), "doc_id long, text string")
    assert components(docs) == {i: i for i in range(80)}
    assert sum(tables["join-cells"]) >= 80 and sum(tables["join-texts"]) == 0


def test_op6_lists_hold_like_sizes(spark, monkeypatch, tables):
    """Texts of unlike sizes that share passages are in no list together, whatever its length."""
    monkeypatch.setattr(adapt_join, "SMALL_LIST", 8)
    monkeypatch.setattr(adapt_join, "HOT_TOKENS", 0)
    texts = [t + " " + " ".join(f"d{d}y{i}" for i in range(int(210 * (1.3 ** d - 1)))) for d, t in enumerate(unlike(11))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert components(docs) == {i: i for i in range(11)}
    assert sum(tables["join-shared"]) == sum(tables["join-cells"]) == 0


def test_op6_texts_of_near_copies_do_not_grow_with_blocks(spark, monkeypatch, tables):
    monkeypatch.setattr(adapt_join, "SMALL_LIST", 8)
    monkeypatch.setattr(adapt_join, "BLOCK", 8)
    docs = spark.createDataFrame(list(enumerate(near(80, 1, 2))), "doc_id long, text string")
    assert set(components(docs).values()) == {0}
    assert sum(tables["join-texts"]) <= 80 and sum(tables.get("join-blocks", [])) == 0


@pytest.mark.parametrize("marked, few, hot", [(4_096, 64, 200_000), (4_096, 4, 0), (16, 4, 0)])
def test_op6_marks_lose_no_link(spark, monkeypatch, marked, few, hot):
    """Groups about the limit, in one block and in several, beside unlike texts."""
    for name, v in (("SMALL_LIST", 8), ("BLOCK", 16), ("MARKED", marked), ("FEW", few), ("HOT_TOKENS", hot)):
        monkeypatch.setattr(adapt_join, name, v)
    texts = unlike(20) + near(50, 1, 2) + near(50, 2, 6) + near(50, 3, 12) + near(7, 4, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = by_force(docs.collect(), words=3, percent=90)
    assert 20 < len(set(want.values())) < 120
    assert components(docs, words=3, percent=90) == want


def test_op6_marks_differ_in_no_more_places_than_sets(spark):
    rng = np.random.default_rng(5)
    for sizes in ((1, 1), (3, 70), (60, 65), (500, 520), (1000, 1030), (40_000, 41_000)):
        for keep in (0, 0.5, 0.95):
            a = rng.integers(-2**63, 2**63, sizes[0], np.int64)
            b = np.concatenate([a[:int(keep * len(a))], rng.integers(-2**63, 2**63, sizes[1], np.int64)])[:sizes[1]]
            a, b = np.unique(a), np.unique(b)
            x, y = adapt_join.parities(a), adapt_join.parities(b)
            for size in {8, min(len(x), len(y))}:
                p, q = (int.from_bytes(adapt_join._folded(m, size)) for m in (x, y))
                assert (p ^ q).bit_count() <= len(np.setxor1d(a, b))


def test_op6_look_alike_joins_and_allows(spark):
    """Against all pairs: allowed are those of the bound, pairs join what looks alike."""
    rng = np.random.default_rng(6)
    base = rng.integers(-2**63, 2**63, 200, np.int64)
    sets = [np.unique(np.concatenate([base[rng.random(200) > gone], rng.integers(-2**63, 2**63, 8, np.int64)]))
            for gone in rng.choice([0.0, 0.02, 0.3, 0.9], 90)]
    n = np.array([len(s) for s in sets])
    marks = [adapt_join.parities(s) for s in sets]
    short = min(map(len, marks))
    differ = {(x, y): (int.from_bytes(adapt_join._folded(marks[x], short))
                       ^ int.from_bytes(adapt_join._folded(marks[y], short))).bit_count()
              for x, y in combinations(range(90), 2)}
    for side in (np.zeros(90, int), np.repeat([0, 1], 45)):
        met = {p: d for p, d in differ.items() if side[0] == side[-1] or side[p[0]] != side[p[1]]}
        pairs, allowed = adapt_join._look_alike(n, np.ones(90, bool), side, np.arange(90), marks, 90)
        want = {i for (x, y), d in met.items() if 190 * d <= 10 * (n[x] + n[y]) for i in (x, y)}
        assert set(np.flatnonzero(allowed)) == want
        assert all(p in met and 190 * met[p] <= 10 * (n[p[0]] + n[p[1]]) for p in pairs)
        assert len(pairs) < 90 and (side[0] != side[-1] or len(pairs) > 20)
