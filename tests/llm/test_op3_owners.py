"""Owners, not the number of documents, make a value a copied example."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from souk.llm import secret_scan
from tests.conftest import SF_SMALL
from tests.llm.test_operators import ASSIGN, base_spans

TOKEN = "Ab3" + "xY9k" * 6
KEY = "AKIA" + "Q7" * 8


def spans(rows) -> Counter:
    """(doc_id, spans) of each row, by plain scanning and counting."""
    found, owners = [], defaultdict(set)
    for r in rows:
        text = r.text or ""
        base = base_spans(text)
        own = [(m.start(), 3, m.end()) for m in re.finditer(
                   r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", text)
               if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))
               and not any(s < m.end() and m.start() < e for s, _, e in base)]
        named = [(s, k, e, ASSIGN.match(text, s)[2] if k == 0 else text[s:e]) for s, k, e in base + own]
        found.append((r.doc_id, named))
        for *_, value in named:
            owners[value].add(r.source)
    return Counter((d, tuple(sorted((s, k, e, len(owners[v]) >= 3) for s, k, e, v in named
                                    if k < 3 or len(owners[v]) < 3))) for d, named in found)


def scanned(docs, **how) -> Counter:
    return Counter((r.doc_id, tuple(tuple(x) for x in r.spans))
                   for r in secret_scan.scan(docs, **how).collect())


def test_many_documents_of_one_owner_stay_live(spark):
    rows = [(i, f"page {i % 4} uses {TOKEN} and {KEY}", "one", f"r{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    for how in ({}, {"repo_col": "repo"}):
        out = scanned(docs, **how)
        assert sum(out.values()) == 12
        assert all([(k, copied) for _, k, _, copied in found] == [(3, False), (1, False)]
                   for _, found in out)
    assert scanned(docs) == spans(docs.collect())
    # ten repositories of two owners, by a column that names repositories
    two = docs.selectExpr("doc_id", "text", "concat('o', doc_id % 2) as source", "repo")
    assert all([(k, copied) for _, k, _, copied in found] == [(1, True)]
               for _, found in scanned(two, repo_col="repo"))


def test_all_spans_equal_plain_scanning(spark, edge):
    tokens = spark.createDataFrame(
        [(100 + i, f"{TOKEN} x{KEY} {TOKEN}{i % 5}", f"s{i % 4}") for i in range(40)],
        "doc_id long, text string, source string")
    for docs in (edge, tokens, spark.read.parquet(f"{SF_SMALL}/documents.parquet")):
        assert scanned(docs) == spans(docs.collect())
