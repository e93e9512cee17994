"""op13 against plain counting in whole numbers."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from souk.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def want(rows, min_df, top=10):
    df, n, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        n[lang, source].update(terms)
        n[lang, None].update(terms)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for x, t in df if x == lang and df[x, t] >= min_df]
        share = {}
        for key in [g for g in groups if g[0] == lang] + [(lang, None)]:
            total = sum(n[key][t] for t in kept)
            share[key[1]] = {t: 1 + 10 ** 9 * (n[key][t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) * (p - q) // (p + q)
        sources = [s for x, s in groups if x == lang]
        for a in sources:
            pairs = [(-sum(f(share[a][t], share[b][t]) for t in kept), b.encode(), b) for b in sources if b != a]
            terms = [(-f(share[a][t], share[None][t]), t.encode(), t) for t in kept
                     if n[lang, a][t] and share[a][t] > share[None][t]]
            for part, found, last in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, a, part, x[2], -x[0], i) for i, x in enumerate(sorted(found)[:last], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus():
    words = "Alpha beta naïve ÉTÉ été x y zeta K über straße".split()
    rows = []
    for i in range(120):
        text = " ".join(words[(i * j + j * j) % len(words)] for j in range(i % 13))
        rows.append((text + ("-A1b\x00c" if i % 7 == 0 else ""), ("en", "de", "xx")[i % 3 if i < 119 else 2],
                     f"s{i % 4}" if i % 3 < 2 else ("only" if i % 2 else None)))
    return rows + [(None, None, None), ("", "en", "empty"), ("!!! 12", "de", ""), ("alone", "lone", "s"), (None, "lone", "t")]


@pytest.mark.parametrize("min_df,slice_terms,large", [
    (10, 4_000_000, 64), (1, 4_000_000, 3), (2, 4_000_000, 1), (2, 400, 64)])
def test_equals_plain_counting(spark, monkeypatch, min_df, slice_terms, large):
    """A fit per language, all languages in one fit, some of each, and terms in slices."""
    if slice_terms < 1000:   # look at every term, so that few make several slices
        monkeypatch.setattr(divergence, "SAMPLED", 1)
        slice_terms = 5
    rows = corpus()
    df = spark.createDataFrame([(*r, "v", "t") for r in rows], "text string, lang string, source string, value string, term string")
    found = divergence.source_divergence(df.repartition(4), min_df=min_df, slice_terms=slice_terms, large=large)
    assert got(found) == want(rows, min_df)


def test_edge_rows(spark, edge, none):
    rows = [(r.text, r.lang, r.source) for r in edge.collect()]
    assert got(divergence.source_divergence(edge)) == want(rows, 10)
    assert got(divergence.source_divergence(edge, min_df=2)) == want(rows, 2)
    assert divergence.source_divergence(none).count() == 0


def test_long_texts_and_large_counts(spark):
    rows = [("Word other " * 200_000, "en", "a"), ("word", "en", "b"), ("other third", "en", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(divergence.source_divergence(df, min_df=1)) == want(rows, 1)
    big = spark.sql("select 9000000000000L as c, 90000000000000L as n, 7L as v").select(
        divergence.share(*(divergence.F.col(x) for x in "cnv")).alias("p")).first().p
    assert big == 1 + 10 ** 9 * 9000000000002 // 90000000000014


def test_every_ascii_character_and_letters_of_others():
    """Each byte of a spaced text stands where it stood; other letters stay as they are."""
    for i in range(256):
        c = bytes([i]) if i < 128 else b""
        want_byte = c.lower() if c.isalpha() else b" " if i < 128 else bytes([i])
        assert divergence.SPACED[i:i + 1] == want_byte
    text = "Ab\x00c\x7fÉTÉ_straße\tＫelvin K-1\n"
    assert text.encode().translate(divergence.SPACED).decode().split() == TERM.findall(text.translate(LOWER))


@pytest.mark.parametrize("entries", [1, 7, 10 ** 6])
def test_sums_of_stretches(spark, entries):
    """Dense and sparse indices, empty vectors, and rows of a group in several stretches."""
    rows = [(f"l{i % 2}", f"s{i % 3}", [j * (1 if i % 2 else 10 ** 8) for j in range(i % 5)], [float(i + j) for j in range(i % 5)])
            for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, source string, indices array<int>, values array<double>")
    found, sums = Counter(), Counter()
    for r in divergence.vector_sums(df.repartition(3), entries).collect():
        found[r.lang, r.source, r["at"]] += r["count"]
    for lang, source, at, count in rows:
        for a, c in zip(at, count):
            sums[lang, source, a] += int(c)
    assert +found == +sums


def test_words_are_written_as_texts(spark, monkeypatch):
    """What is written once and read for every fit is a text a row, no list of words."""
    seen = []
    kept = divergence.scratch_path

    def path(session, label):
        seen.append(kept(session, label))
        return seen[-1]
    monkeypatch.setattr(divergence, "scratch_path", path)
    df = spark.createDataFrame(corpus(), "text string, lang string, source string")
    assert got(divergence.source_divergence(df)) == want(corpus(), 10)
    assert [f.dataType.simpleString() for f in spark.read.parquet(seen[0]).schema if f.name not in ("part", "sample")] == ["string"] * 3


def test_keys_of_words(spark):
    """A key for each word of each text, equal for equal words, whatever stands around them or meets at a text's end."""
    texts = ["", "Alpha beta", "", "x", "x y", " lead trail ", "straße-über.K12 abcdefghijklmnopq abcdefghijklmnopq", "beta", "alpha,x"]
    df = spark.createDataFrame([("l", "s", x) for x in texts], "lang string, source string, text string").coalesce(1)
    found = divergence.spaced(df, 1).collect()
    keys = {}
    for text, r in zip(texts, found):
        words = TERM.findall(text.translate(LOWER))
        assert r.text.split() == words and len(r.sample) == len(words)
        for w, k in zip(words, r.sample):
            assert keys.setdefault(w, k) == k
    assert len(set(keys.values())) == len(keys)


@pytest.mark.parametrize("min_df,together", [(1, 10 ** 6), (3, 10 ** 6), (10, 10 ** 6), (3, 400), (3, 1)])
def test_a_fit_reads_only_what_decides(spark, min_df, together):
    """The same terms stand in ``min_df`` documents of their language; others of them are left out."""
    rows = [(t.translate(LOWER).encode().translate(divergence.SPACED).decode(), lang or "")
            for t, lang, _ in corpus() if t is not None] + [("a\u2003b\u0085c", "en")] * 4
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2).cache()
    whole, left = Counter(), Counter()
    for text, lang in rows:
        whole.update((lang, t) for t in set(TERM.findall(text)))
    for r in divergence.deciding(df, min_df, together).collect():
        assert len(set(r.terms)) == len(r.terms)
        left.update((r.lang, t) for t in r.terms)
    assert {t for t in left if left[t] >= min_df} == {t for t in whole if whole[t] >= min_df}
    assert all(left[t] == whole[t] for t in whole if whole[t] < min_df) and not left.keys() - whole.keys()
    if together > 1000:   # two tasks
        assert max(left.values()) <= 2 * min_df < max(whole.values())


def test_the_vocabulary_is_fitted_on_what_decides(spark, monkeypatch):
    """The fit reads at most ``min_df`` documents of a term from each task."""
    read = []
    fit = divergence.CountVectorizer.fit
    monkeypatch.setattr(divergence.CountVectorizer, "fit", lambda self, df: read.append(
        sum(len(r.terms) for r in df.select("terms").collect())) or fit(self, df))
    rows = [("one two one", "en", f"s{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    assert got(divergence.source_divergence(df)) == want(rows, 10)
    assert sum(read) == 20   # of 600
    whole = divergence.share(*(divergence.F.col(x) for x in "cnv"))
    for c in (8_999_999_999, 9_000_000_000, 9_223_372_036_854_775_000 // 2):
        p = spark.sql(f"select {c}L as c, {2 * c}L as n, 7L as v").select(whole.alias("p")).first().p
        assert p == 1 + 10 ** 9 * (c + 2) // (2 * c + 14)


def test_only_the_greatest_are_sorted(spark):
    """No row of the first ten, nor one equal to the last of them, is left out; most others are."""
    values = {("l", "a"): [0] * 30, ("l", "b"): list(range(1000)) + [512] * 20, ("m", "a"): [5], ("m", "b"): [1 << 40, *range(12)]}
    rows = [(*k, v) for k, x in values.items() for v in x]
    df = spark.createDataFrame(rows, "lang string, source string, value long").withColumn("digits", divergence.F.length(divergence.F.bin("value")))
    left = Counter((r.lang, r.source, r.value) for r in divergence._greatest(df, 10).collect())
    for k, x in values.items():
        last = sorted(x, reverse=True)[:10][-1]
        assert all(left[(*k, v)] == x.count(v) for v in x if v >= last)
    assert sum(n for k, n in left.items() if k[:2] == ("l", "b")) < 600
