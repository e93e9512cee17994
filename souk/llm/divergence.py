"""How far the sources of a language differ in their words.

Per language, a CountVectorizer with a least document frequency and no other limit
(``vocabSize`` is the largest integer) turns each document into an exact sparse
vector of term counts. Languages of more than one in ``LARGE`` documents (fewer
than ``LARGE`` of them) have a fit each; all smaller ones share a fit, in which
every term is marked with its language, so that it keeps its own document frequency.

Texts are written once with ASCII letters lowered and a space for other ASCII, and
split into terms where they are read. The vectors are unwrapped into index and value
arrays, which each task sums per (language, source) over stretches of ``ENTRIES``
entries before Spark shuffles and sums them as whole numbers: like the Summarizer's
sums, but exact and without a dense buffer per group. From then on only the terms that a source has are rows. Pairs of sources are
evaluated over terms that both have; the terms that one or neither has enter by
how often each count occurs in a source, as their share in the other source is one
and the same number.

A fit only has to find which terms stand in ``min_df`` documents, so it reads no
occurrence that cannot matter: of documents that lie together (``TOGETHER`` bytes) a
term is read from ``min_df`` ones of a language at most. The vocabulary is the same;
counts are taken from the vectors of the whole texts.

CountVectorizer holds its vocabulary on the driver, so the terms of a fit are dealt
into slices by hash, as many as an estimate of its distinct terms asks for
(``SLICE_TERMS`` each), and one slice is fitted after the other. The estimate counts
the distinct terms of one in ``SAMPLED`` hash values, taken while the texts are translated.
The pairs of one language's sources are as many as the contract asks for.

Shares are in whole billionths: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the
sum of the group's counts, V the language's number of terms. The divergence of a
term is floor((p - q)^2 / (p + q)). Products that could pass 64 bits are decimals.

Defined cases: NULL texts, languages and sources are empty strings; a
(language, source) without terms is a group all the same; a language without
kept terms has pairs of value 0 and no terms; a language of one source has no
pairs; equal values rank by name; repeated rows count as often as they stand;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import ship, stored
from souk.llm.syncmers import _mixed
from souk.session import scratch_path

SPACED = bytes(i if i >= 128 or chr(i).islower() else i + 32 if chr(i).isupper() else 32 for i in range(256))
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)   # the first i bytes of eight
ROWS = 500                   # texts translated at once
MARK = "\x00"                # between language and term; never in a term
MIN_DF = 10                  # documents that hold a kept term
ALL_TERMS = 2 ** 31 - 1      # vocabSize: the largest integer
LARGE = 64                   # a language of more than one in so many documents has its own fit
SLICE_TERMS = 4_000_000      # distinct terms of one fit, about
ENTRIES = 2_000_000          # entries of vectors that a task sums at once (24 MB)
ROWS_TOGETHER = 10_000       # and rows
TOGETHER = 8_000_000         # bytes of texts that are looked through at once for a fit
SAMPLED = 256                # one in so many hash values is looked at for that
TOP = 10                     # ranks of part ``term``
ONE = 10 ** 9


def read_texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, text as strings without NULLs."""
    def col(name: str, as_name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(as_name)

    return docs.select(col(lang_col, "lang"), col(source_col, "source"), col(text_col, "text"))


def word_keys(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of spaced texts side by side starts, and its key: a hash of its first and
    last eight bytes and its length. ``bounds`` are the texts' ends, after a first 0."""
    inside = text != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = bounds[:-1][bounds[:-1] < len(text)], bounds[1:][bounds[1:] > 0] - 1
    first[begins], last[ends] = inside[begins], inside[ends]
    starts, after = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = after - starts
    eight = np.ndarray(len(text) + 1, "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
    mask = MASKS[np.minimum(size, 8)]
    head, tail = eight[starts] & mask, eight[np.maximum(after - 8, starts)] & mask
    return starts, _mixed(_mixed(head + size.astype(np.uint64)) ^ tail)


def spaced(texts: DataFrame, sampled: int = SAMPLED) -> DataFrame:
    """The same rows; in the texts ASCII letters are lowered and other ASCII is a space.
    ``sample`` has the keys of the words of one in ``sampled`` key values.

    Each byte becomes one byte and those of other letters stay, so the texts of
    ``ROWS`` rows are translated at once, whatever their lengths.
    """
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(2).cast(pa.string())
            offsets = np.frombuffer(text.buffers()[1] or b"", np.int32)[text.offset:]
            for at in range(0, b.num_rows, ROWS):
                n = min(ROWS, b.num_rows - at)
                bounds = offsets[at:at + n + 1]
                some, bounds = (int(bounds[0]), int(bounds[-1] - bounds[0])), bounds - bounds[0]
                data = text.buffers()[2].slice(*some).to_pybytes().translate(SPACED) if some[1] else b""
                starts, keys = word_keys(np.frombuffer(data, np.uint8), bounds)
                chosen = keys % np.uint64(sampled) == 0
                sample = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts[chosen], bounds), pa.int32()),
                                                  pa.array(keys[chosen].view(np.int64)))
                made = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), made, sample],
                                                 ["lang", "source", "text", "sample"])

    return texts.mapInArrow(run, "lang string, source string, text string, sample array<long>")


def terms_of(text: Column) -> Column:
    """The terms of a spaced text, and empty ones: no fit has those, so no vector counts them."""
    return F.split(text, " ")


def deciding(texts: DataFrame, min_df: int, together: int = TOGETHER) -> DataFrame:
    """lang and distinct terms of spaced texts, of ``together`` bytes at once: a term is left
    out where it stands in ``min_df`` earlier ones of the language. What stands in ``min_df``
    documents of a language does so here, and the reverse."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                upto = np.searchsorted(ends, together + (ends[at - 1] if at else 0), "right")
                n = int(min(max(upto - at, 1), ROWS_TOGETHER))
                lang = b.column(0).slice(at, n)
                words = pc.split_pattern(b.column(1).slice(at, n), " ")
                coded = words.flatten().dictionary_encode()
                terms = coded.dictionary
                doc = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy())
                code = coded.indices.to_numpy().astype(np.int64)
                some = code != terms.index("").as_py()   # -1: none is empty
                of_lang = lang.dictionary_encode().indices.to_numpy().astype(np.int64) * len(terms)
                keys = ((of_lang[doc] + code) * n + doc)[some]   # at most rows, terms and rows: 64 bits hold it
                keys.sort()
                first = np.ones(len(keys), bool)
                first[1:] = keys[1:] != keys[:-1]
                term, doc = np.divmod(keys[first], n)
                kept = np.ones(len(term), bool)
                kept[min_df:] = term[min_df:] != term[:-min_df]
                doc, code = doc[kept], term[kept] % max(len(terms), 1)
                by_doc = np.argsort(doc, kind="stable")
                offsets = np.searchsorted(doc[by_doc], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([lang, pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), terms.take(pa.array(code[by_doc])))], ["lang", "terms"])
                at += n

    return texts.select("lang", "text").mapInArrow(run, "lang string, terms array<string>")


def once(value: Column) -> Column:
    """``value`` as a generated column: what reads it twice does not compute it twice."""
    return F.explode(F.array(value))


def vector_sums(vectors: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """lang, source, at, count: sums of the vectors (lang, source, indices, values), by stretches of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            for (lang, source), parts in held.items():
                at, count = (np.concatenate(x) for x in zip(*parts))
                if len(at) * 16 > at.max(initial=0):   # a row for each index there is
                    sums = np.bincount(at, count)
                    at = np.flatnonzero(sums)
                    sums = sums[at]
                else:
                    at, which = np.unique(at, return_inverse=True)
                    sums = np.bincount(which, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(at)), pa.repeat(source, len(at)), pa.array(at.astype(np.int32)),
                     pa.array(sums.astype(np.int64))], ["lang", "source", "at", "count"])

        for b in batches:
            if not b.num_rows:
                continue
            offsets = b.column(2).offsets.to_numpy().tolist()
            at, count = b.column(2).values.to_numpy(), b.column(3).values.to_numpy()
            for i, group in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                begin, end = offsets[i], offsets[i + 1]
                if begin < end:
                    held.setdefault(group, []).append((at[begin:end], count[begin:end]))
            size += offsets[-1] - offsets[0]
            if size >= entries:
                yield from summed()
                held, size = {}, 0
        yield from summed()

    return vectors.mapInArrow(run, "lang string, source string, at int, count long")


def _fitted(lists: DataFrame, deciders: DataFrame, min_df: int, lang: str | None,
            fit: int) -> tuple[DataFrame, DataFrame] | None:
    """The kept terms' counts (lang, source, number, count) and names (number, lang, term) of
    one fit; None if no term is kept. ``deciders`` are the lists that the fit needs. ``number``
    is the term's index, with the fit; a fit of several languages (``lang`` None) has terms
    that are marked with theirs."""
    spark = lists.sparkSession
    try:
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df),
                                vocabSize=ALL_TERMS).fit(deciders)
    except IllegalArgumentException as e:
        if "vocabulary size" in str(e):   # no term stands in so many documents
            return None
        raise
    first = fit << 32
    sparse = model.transform(lists).select("lang", "source", once(F.unwrap_udt("vector")).alias("v"))
    sums = vector_sums(sparse.select("lang", "source", "v.indices", "v.values"))
    key = ["lang", "source", "at"] if lang is None else ["source", "at"]
    # tasks have summed already, so rows are dealt first
    sums = sums.select(*key, "count").repartition(*key).groupBy(*key).agg(F.sum("count").alias("count"))
    if lang is not None:
        sums = sums.withColumn("lang", F.lit(lang))
    marked = [x.rsplit(MARK, 1) if lang is None else (lang, x) for x in model.vocabulary]
    langs, terms = [x for x, _ in marked], [x for _, x in marked]
    names = spark.createDataFrame(pa.table({"number": pa.array(range(first, first + len(terms)), pa.int64()),
                                            "lang": pa.array(langs, pa.string()), "term": pa.array(terms, pa.string())}))
    return (stored(sums.select("lang", "source", (F.col("at") + F.lit(first)).alias("number"), "count"), "term-counts"),
            stored(names, "term-names"))


def group_counts(texts: DataFrame, min_df: int = MIN_DF, slice_terms: int = SLICE_TERMS,
                 large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Counts of every kept term in every (lang, source) that has it, and the terms' names."""
    spark = texts.sparkSession
    per_lang = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    total = texts.count()
    # fewer than ``large`` languages hold more than one in so many documents
    own = [r.lang for r in per_lang.where(F.col("docs") * large > total).orderBy("lang").collect()]
    part = F.array_position(F.lit(own) if own else F.array().cast("array<string>"), F.col("lang")).cast("int")
    path = scratch_path(spark, "term-texts")
    # read a few times and thrown away: written the way that costs the least
    (spaced(texts, SAMPLED).select("lang", "source", "text", "sample", part.alias("part")).write.partitionBy("part")
     .option("compression", "lz4").option("parquet.enable.dictionary", "false").parquet(path))
    dealt = spark.read.schema("lang string, source string, text string, sample array<long>, part int").parquet(path)
    seen = {r.part: r.n * SAMPLED for r in dealt.select("part", "lang", F.explode("sample").alias("t")).groupBy("part").agg(F.approx_count_distinct(F.struct("lang", "t")).alias("n")).collect()}
    counts = spark.createDataFrame([], "lang string, source string, number long, count long")
    names = spark.createDataFrame([], "number long, lang string, term string")
    fit = 0
    for number in range(len(own) + 1):   # 0: the small languages together
        mine = dealt.where(F.col("part") == number).select("lang", "source", "text")
        slices = max(1, -(-seen.get(number, 0) // slice_terms))
        for i in range(slices):
            def chosen(lists: DataFrame, i: int = i) -> DataFrame:
                if slices > 1:
                    lists = lists.withColumn("terms", F.filter("terms", lambda x: F.pmod(F.xxhash64(x), F.lit(slices)) == i))
                if number == 0:
                    lists = lists.withColumn("terms", F.transform("terms", lambda x: F.concat("lang", F.lit(MARK), x)))
                return lists
            lists = mine.select("lang", "source", terms_of(F.col("text")).alias("terms"))
            found = _fitted(chosen(lists), chosen(deciding(mine, min_df)), min_df, own[number - 1] if number else None, fit)
            fit += 1
            if found is not None:
                counts, names = counts.unionByName(found[0]), names.unionByName(found[1])
    return counts, names


def share(count: Column, total: Column, terms: Column) -> Column:
    """p in billionths; NULL where the language keeps no term."""
    whole = (count + 2).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")
    of = F.nullif(total + 2 * terms, F.lit(0))
    small = F.call_function("div", (count + 2) * ONE, of)   # 64 bits hold the product
    return F.try_add(F.lit(1).cast("long"), F.when(count < 9 * ONE, small).otherwise(
        F.call_function("div", whole, of.cast("decimal(20,0)"))))


def term_divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so 64 bits hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of sources of a language.

    ``counts`` has the shares p by term number, ``groups`` total, terms (kept by the language), own (terms
    the source has) and p_none (share of a term it does not have).
    """
    side = groups.select("lang", F.col("source").alias("item"), F.col("p_none").alias("q_none"),
                         F.col("own").alias("item_own"))
    pairs = groups.join(side, "lang").where("source != item")
    # every term of the source against the item's share of an absent term
    often = counts.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    absent = (often.join(pairs.select("lang", "source", "item", "q_none"), ["lang", "source"])
              .groupBy("lang", "source", "item")
              .agg(F.sum(F.col("times") * term_divergence(F.col("p"), F.col("q_none"))).alias("apart")))
    # terms that both have: their true value instead of the two taken above
    a = counts.select("lang", "number", "source", "p", "p_none")
    b = counts.select("number", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p_none").alias("q_none"))
    shared = (a.join(b, "number").where("source < item").groupBy("lang", "source", "item")
              .agg(F.count("*").alias("both"), F.sum(
                  term_divergence(F.col("p"), F.col("q")) - term_divergence(F.col("p"), F.col("q_none"))
                  - term_divergence(F.col("p_none"), F.col("q"))).alias("change")))
    one_way = (pairs.join(absent, ["lang", "source", "item"], "left")
               .select("lang", "source", "item", "terms", "own", "item_own", "p_none", "q_none",
                       F.coalesce("apart", F.lit(0)).alias("apart")))
    back = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                          F.col("apart").alias("apart_back"))
    both = F.coalesce("both", F.lit(0))
    neither = F.col("terms") - F.col("own") - F.col("item_own") + both
    value = (F.col("apart") + F.col("apart_back") + F.coalesce("change", F.lit(0))
             + F.coalesce(neither * term_divergence(F.col("p_none"), F.col("q_none")), F.lit(0)))
    half = (one_way.where("source < item").join(back, ["lang", "source", "item"])
            .join(shared, ["lang", "source", "item"], "left")
            .select("lang", "source", "item", value.cast("long").alias("value")))
    half = stored(half, "source-pairs")
    return half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))


def _greatest(values: DataFrame, top: int) -> DataFrame:
    """Rows (lang, source, digits) of each group without those of fewer digits than the first
    ``top`` have: few are left to sort."""
    above = Window.partitionBy("lang", "source").orderBy(F.desc("digits")).rowsBetween(Window.unboundedPreceding, -1)
    least = (values.groupBy("lang", "source", "digits").agg(F.count(F.lit(1)).alias("times"))
             .withColumn("above", F.coalesce(F.sum("times").over(above), F.lit(0))).where(F.col("above") < top)
             .select("lang", "source", "digits"))
    return values.join(least, ["lang", "source", "digits"])


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                      source_col: str = "source", min_df: int = MIN_DF, top: int = TOP,
                      slice_terms: int = SLICE_TERMS, large: int = LARGE) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources and each source's
    ``top`` terms that it uses more than its language."""
    texts = read_texts(docs, text_col, lang_col, source_col)
    found, names = group_counts(texts, min_df, slice_terms, large)
    # a term has a row per source of its language at most
    per_term = F.sum("count").over(Window.partitionBy("number"))
    per_group = stored(found.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("own")),
                       "term-totals")
    per_lang = (per_group.groupBy("lang").agg(F.sum("total").alias("lang_total"))
                .join(names.groupBy("lang").agg(F.count("*").alias("terms")), "lang"))
    groups = stored(
        texts.select("lang", "source").distinct().join(per_lang, "lang", "left").join(per_group, ["lang", "source"], "left")
        .fillna(0, ["terms", "lang_total", "total", "own"])
        .withColumn("p_none", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "term-groups")
    counts = stored(
        found.withColumn("lang_count", per_term).join(groups.select("lang", "source", "total", "terms", "lang_total", "p_none"), ["lang", "source"])
        .select("lang", "source", "number", "p_none", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"),
                share(F.col("lang_count"), F.col("lang_total"), F.col("terms")).alias("q")), "term-shares")
    pairs = _ranked(_pairs(counts.drop("q"), groups)).withColumn("part", F.lit("pair"))
    # only what is among the first by value, or equal to the last of them, needs its name
    value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    more = (counts.where("p > q").select("lang", "source", "number", term_divergence(F.col("p"), F.col("q")).alias("value"))
            .withColumn("digits", F.length(F.bin("value"))))
    first = _greatest(more, top).withColumn("at_least", F.rank().over(value)).where(F.col("at_least") <= top)
    terms = _ranked(first.join(names.select("number", F.col("term").alias("item")), "number")
                    .select("lang", "source", "item", "value")).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
