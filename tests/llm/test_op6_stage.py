"""The near-duplicate stage, 5 words and 80 %, against all pairs."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_op6_short_sets import by_force


def test_stage_drops_near_copies_of_80_percent(spark):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(20):
        w = [f"g{g}w{i}" for i in range(200)]
        for edits in range(8):  # each changed word changes five shingles
            v = list(w)
            for at in rng.integers(0, 200, edits):
                v[at] = f"x{rng.integers(0, 9999)}"
            texts.append(" ".join(v))
    own = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    for docs in (own, small):
        groups = by_force(docs.collect())
        kept = {r.doc_id for r in corpus_pipeline.duplicate_stage(spark, docs, SF_SMALL).collect()}
        assert kept == set(groups.values())


def test_stage_tells_rows_of_one_id_apart(spark):
    """Three unrelated texts of one id all stay; a copy goes without them; rows without
    id or words stay; of rows alike in every column one stays."""
    words = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    near = words["a"].replace("a59", "x")
    rows = [(1, words["a"], "en", "s"), (1, words["b"], "en", "s"), (1, words["c"], "de", "t"),
            (2, near, "en", "s"), (3, words["d"], "en", "s"), (3, words["d"], "en", "s"),
            (4, words["e"], "en", "s"), (4, words["e"], "fr", "s"), (5, "", "en", "s"), (5, None, "en", "s"),
            (None, words["a"], "en", "s"), (None, words["a"], "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.duplicate_stage(spark, docs, SF_SMALL).collect()]
    assert sorted(kept, key=str) == sorted(
        [(1, words["a"]), (1, words["b"]), (1, words["c"]), (3, words["d"]), (4, words["e"]), (5, ""), (5, None),
         (None, words["a"]), (None, words["a"])], key=str)


def test_ids_with_several_texts_lose_no_link(spark):
    """A pair is verified on the text of its class, whatever other texts its ids have."""
    from souk.llm import adapt_join
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(12):
        v = list(base)
        v[20 * i] = f"y{i}"
        rows += [(i, " ".join(v)), (i, f"other text of {i} " * 20), (i, f"third {i} of these")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = adapt_join.similar_components(docs, words=5, percent=80).collect()
    big = {r.component_set for r in found if r.n_shingles == 296}
    assert len(big) == 1 and sum(r.n_shingles == 296 for r in found) == 12
    assert len({r.component_set for r in found}) == 1 + 24
