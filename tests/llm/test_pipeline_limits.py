"""What the pipeline's stages hold and write does not follow from batch sizes or the number of shuffle partitions."""

from __future__ import annotations

import tracemalloc
from pathlib import Path

import numpy as np

from souk.llm import adapt_join, common, hd_language
from souk.session import ensure_checkpoint_dir


def test_files_follow_the_rows(spark):
    """1200 rows dealt over 96 shuffle partitions that Spark does not merge."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1200):
        words = [f"{i // 3}x{j}" for j in range(40)] if i < 900 else list(base)
        words[rng.integers(0, 40)] = f"y{rng.integers(0, 3)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    souk = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "souk"
    before = set(souk.glob("*"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "96")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = adapt_join.similar_components(docs, words=3, percent=80).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(found) == 1200 and len({r.component_id for r in found if r.doc_id >= 900}) == 1
    most = max(2 * spark.sparkContext.defaultParallelism, 1)
    made = {p.name: len(list(p.glob("part-*"))) for p in set(souk.glob("*")) - before}
    assert made and max(made.values()) <= most, made


def test_worker_keeps_one_operators_tables():
    held = dict(common.WORKER)
    try:
        common.worker_tables("one")["table"] = 1
        assert common.worker_tables("one") == {"table": 1}
        assert common.worker_tables("other") == {} and common.worker_tables("one") == {}
    finally:
        common.WORKER.clear()
        common.WORKER.update(held)


def test_memory_of_trigram_vectors():
    """Sixty thousand distinct trigrams; the vectors are those of one block after the other."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(letters, 600)) for _ in range(100)]
    hd_language.text_vectors(texts)   # the letters' vectors are made
    tracemalloc.start()
    got = hd_language.text_vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak
    alone = np.concatenate([hd_language.text_vectors([t]) for t in texts])
    assert (got == alone).all()
