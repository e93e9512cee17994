"""op3 on texts with very many spans: exact places, and time in proportion."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from souk.llm import secret_scan


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_max_and_halving(spark, n):
    rng = random.Random(n)
    items = [rng.randrange(2 * n + 1) for _ in range(n)]
    row = spark.createDataFrame([(items, sorted(items))], "a array<int>, b array<int>").select(
        secret_scan.running_max(F.col("a")).alias("m"), secret_scan.chunks(F.col("a")).alias("c"),
        F.transform(F.sequence(F.lit(-1), F.lit(2 * n + 2)), lambda x: secret_scan.count_up_to(F.col("b"), x)).alias("k")
    ).first()
    assert row.m == [max(items[:i + 1]) for i in range(n)]
    assert [x for c in row.c for x in c] == items
    assert row.k == [sum(i <= x for i in items) for x in range(-1, 2 * n + 3)]


def test_redact_merges_and_keeps_the_rest(spark):
    rng = random.Random(1)
    for n in (1, 5, 300, 700):
        text = "".join(rng.choice("ab é漢😀\n") for _ in range(4 * n + 9))
        spans = sorted({(s, min(len(text), s + rng.randrange(1, 9))) for s in (rng.randrange(len(text)) for _ in range(n))})
        want, top = "", 0
        for s, e in spans:
            if s >= top:
                want += text[top:s] + "[SECRET]"
            top = max(top, e)
        want += text[top:]
        got = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int>>").select(
            secret_scan.redact(F.col("t"), F.col("s")).alias("r")).first().r
        assert got == want


def test_time_grows_with_the_text(spark):
    """64,000 keys in one text of 2 MB: found, judged and replaced in seconds."""
    n = 64_000
    text = "é " + " ".join(f"password={i:012d}" if i % 2 else f"Tk{i:06d}Zq{i:06d}xYwW" for i in range(n))
    docs = spark.createDataFrame([(1, text, "a"), (2, "nothing here", "a")], "doc_id long, text string, source string")
    began = time.monotonic()
    rows = {r.doc_id: r for r in secret_scan.scan(docs).join(docs, "doc_id").select(
        "doc_id", "text", "spans", secret_scan.redact(F.col("text"), F.col("spans")).alias("cut")).collect()}
    assert time.monotonic() - began < 60
    spans = [(x.kind, x.start, x.end) for x in rows[1].spans]
    assert sum(k == 0 for k, _, _ in spans) == n // 2 and sum(k == 3 for k, _, _ in spans) == n // 2
    for kind, start, end in spans[:5] + spans[-5:]:
        assert text[start:end].startswith("password=" if kind == 0 else "Tk")
    assert rows[1].cut == "é " + " ".join(["[SECRET]"] * n)
    assert rows[2].cut == "nothing here" and rows[2].spans == []
