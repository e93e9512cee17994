"""Lines of any length are counted and removed."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from souk.llm import line_quality
from tests.conftest import SF_SMALL
from tests.llm.test_operators import GAP, base_rules


def verdicts(rows, rules=line_quality.LineRules()) -> Counter:
    """(doc_id, removed words, kept) of each row, by plain counting."""
    hosts, held = defaultdict(set), defaultdict(set)

    def lines(text):
        for number, line in enumerate((text or "").split("\n")):
            if GAP.sub("", line):
                yield number, re.sub("[ \t-\r]+", " ", line).strip(" ").lower()

    for r in rows:
        hosts[r.source].add(r.text or "")
        for _, line in lines(r.text):
            held[r.source, line].add(r.text or "")
    out = Counter()
    for r in rows:
        gone = [(number, line) for number, line in lines(r.text)
                if len(held[r.source, line]) >= rules.min_docs
                and (len(held[r.source, line]) > rules.max_share * len(hosts[r.source])
                     or len(held[r.source, line]) >= rules.max_docs)]
        n_words, *_, failed = base_rules(r.text or "")
        removed = sum(len(line.split(" ")) for _, line in gone)
        out[r.doc_id, tuple(number for number, _ in gone), removed,
            not failed and removed <= rules.max_removed * n_words] += 1
    return out


def got(docs, rules=line_quality.LineRules()) -> Counter:
    return Counter((r.doc_id, tuple(sorted(r.drop_lines or ())), r.removed_words, r.kept)
                   for r in line_quality.line_quality(docs, rules=rules).collect())


def test_long_lines_are_removed_and_deplete(spark):
    passage = " ".join(f"licence{i}" for i in range(80))
    assert len(passage) > 300
    rows = [(d, f"{passage.upper()}\n" + " ".join(f"d{d}w{i}" for i in range(60 if d else 200)), "h")
            for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert got(docs) == Counter({(d, (0,), 80, d == 0): 1 for d in range(12)})


def test_verdicts_equal_plain_counting(spark, edge):
    for docs in (edge, spark.read.parquet(f"{SF_SMALL}/documents.parquet")):
        assert got(docs) == verdicts(docs.collect())


def test_an_absolute_limit_holds_on_hosts_of_any_size(spark):
    """A line of 40 documents goes although it is far below the share of its host."""
    rules = line_quality.LineRules(min_docs=5, max_share=0.5, max_docs=40)
    rows = [(d, ("common head\n" if d < 40 else "rarer head\n" if d < 79 else "")
             + " ".join(f"d{d}w{i}" for i in range(60)), "h") for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = got(docs, rules)
    assert found == verdicts(docs.collect(), rules)
    assert sum(n for (_, gone, _, _), n in found.items() if gone) == 40


def test_time_grows_with_the_lines(spark):
    """100,000 different lines in one text, half of them removed, in seconds."""
    import time
    from pyspark.sql import functions as F
    text = "\n".join(f"line number {i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    began = time.monotonic()
    assert line_quality.line_quality(docs).first().n_dup_lines == 0
    cut = docs.select(line_quality.drop_lines(
        F.col("text"), F.transform(F.sequence(F.lit(0), F.lit(99_998), F.lit(2)), lambda i: i)).alias("t")).first().t
    assert cut == "\n".join(f"line number {i}" for i in range(1, 100_000, 2))
    assert time.monotonic() - began < 60
