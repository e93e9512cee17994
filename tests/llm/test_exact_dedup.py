"""op11 against grouping in Python: edge rows, a full filter, hot groups, carried texts."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from souk.llm import exact_dedup
from tests.conftest import SF_SMALL

GAP = re.compile("[ \t-\r]+")


def even(text: str | None) -> str:
    return GAP.sub(" ", text or "")


def want(rows):
    """Multiset of (doc_id, keep_id, size, kept, digest) by plain grouping."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[even(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        for i, x in enumerate(ids):
            out.append((x, ids[0], len(ids), i == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex())
                   for r in df.collect()), key=str)


def test_edge_rows(spark, edge, none):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(exact_dedup.exact_dedup(edge)) == want(rows)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.deduplicated(edge)
    assert kept.columns == edge.columns
    assert sorted(even(r.text) for r in kept.collect()) == sorted({even(t) for _, t in rows})


@pytest.mark.parametrize("hot_groups", [10_000, 3])
@pytest.mark.parametrize("bits", [exact_dedup.MAX_FILTER_BITS, 64])
def test_whole_groups_whatever_the_filter(spark, monkeypatch, bits, hot_groups):
    """A third of the rows is one text; with 64 positions nearly every row may repeat."""
    monkeypatch.setattr(exact_dedup, "FEWEST_BITS", 1)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", hot_groups)
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i // 2}" if i % 5 == 0 else f"own {i}")
            for i in range(600, 0, -1)] + [(None, "same text"), (5, None), (5, ""), (9, "own 7 \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(exact_dedup.exact_dedup(df, max_filter_bits=bits)) == want(rows)


def test_unlike_rows_are_not_shuffled(spark):
    """The filter tells nearly all single texts apart from repeated ones."""
    rows = [(i, f"text {i}") for i in range(2000)] + [(5000 + i, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", exact_dedup.text_digest(exact_dedup.F.col("text")).alias("digest"))
    half = exact_dedup.BITS_PER_ROW * len(rows)
    flagged = exact_dedup.may_repeat(df, exact_dedup.repeat_filter(df, half), half)
    again = {r.doc_id for r in flagged.where("again").collect()}
    assert again >= {*range(50), *range(5000, 5050)}
    assert len(again) < 100 + 0.05 * len(rows)


def test_long_texts_and_ids_of_text(spark):
    rows = [("b", "ab " * 400_000), ("a", "ab\t" * 400_000), ("c", "é 漢 " * 9)]
    df = spark.createDataFrame(rows, "n string, `a.text` string")
    found = exact_dedup.exact_dedup(df, "n", "a.text").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == [
        ("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]


def test_query(spark):
    from souk.llm import queries
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_exact_dedup(spark, SF_SMALL).collect()
    assert sorted(map(str, want(rows))) == sorted(
        str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in found)
