"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends on the letter
alone. A trigram is bound by multiplying its letters' vectors, the first
permuted (rolled) twice, the second once. A text is the sum (bundle) of its
trigrams' vectors, a language prototype the sum of its documents' vectors, each
scaled to length 1; a document gets the language whose prototype has the
greatest cosine with it. Letters are taken in lower case; anything else is a
gap, and gaps in a row are one.

Prototypes are learned from at most ``PER_LANGUAGE`` training documents of each
language, those with the smallest id hashes. Sums are taken over whole
numbers, so they do not depend on the order of rows. What reaches the driver
and is broadcast is one vector per language.

Defined cases: a NULL text, or one without letters, is ``und`` with score 0; so
is every text when nothing could be learned. NULL languages are not learned
from, nor are rows without an id. Equal cosines go to the first language by
name; a score below 0 is 0. Repeated rows each give a row; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from souk.llm.common import ship, worker_tables

DIMENSIONS = 1024
PER_LANGUAGE = 1500    # documents learned from, per language
SALTS = 64             # parts of a language's ids in which the least are found first
UNIT = 10_000          # whole-number scale of a document's unit vector
BLOCK_ROWS = 128       # texts worked on at once, at most
BLOCK_CHARS = 400_000  # characters worked on at once (a longer text is taken alone)
KINDS = 2_000          # distinct trigrams whose vectors are held at once (8 MB)
SEED = 20
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Code point -> lower-case letter's code point, 0 for anything else."""
    kept = worker_tables("language")
    if "letters" not in kept:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                table[c] = ord(x.lower()[0])
        kept["letters"] = table
    return kept["letters"]


def letter_vector(letter: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, letter])
    return (2 * rng.integers(0, 2, DIMENSIONS) - 1).astype(np.float32)


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    """One row per trigram (three letters in 21 bits each)."""
    known = worker_tables("language").setdefault("letter vectors", {})
    out = None
    for place, shift in enumerate((42, 21, 0)):
        letters, which = np.unique(grams >> shift & 0x1FFFFF, return_inverse=True)
        for x in letters.tolist():
            if (x, place) not in known:
                if len(known) > 6_000:
                    known.clear()
                known[x, place] = np.roll(letter_vector(x), 2 - place)
        rolled = np.stack([known[x, place] for x in letters.tolist()])[which]
        out = rolled if out is None else np.multiply(out, rolled, out=out)
    return out


def text_vectors(texts: list[str]) -> np.ndarray:
    """The bundle of each text's trigrams, scaled to length 1 (0 without letters)."""
    table = _letters()
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    grams, owners = [], []
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        x = np.concatenate([[0], table[codes], [0]])
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        if len(x) >= 3:
            grams.append(x[:-2] << 42 | x[1:-1] << 21 | x[2:])
            owners.append(np.full(len(x) - 2, i))
    if grams:
        kinds, which = np.unique(np.concatenate(grams), return_inverse=True)
        owner = np.concatenate(owners)
        for at in range(0, len(kinds), KINDS):
            some = (which >= at) & (which < at + KINDS)
            width = min(KINDS, len(kinds) - at)
            counts = np.bincount(owner[some] * width + which[some] - at,
                                 minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(np.float32) @ trigram_vectors(kinds[at:at + width])
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(rows, texts) of runs of rows of bounded size; the text is the last column."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):  # strings of a whole batch would be many
            part = b.slice(at, BLOCK_ROWS)
            texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK_CHARS or i == len(texts) - 1:
                    yield part.slice(begin, i + 1 - begin), texts[begin:i + 1]
                    begin, size = i + 1, 0


def held_out(id_: Column, parts: int, part: int) -> Column:
    """Whether a document's id falls into that part (false without an id)."""
    return F.coalesce(F.crc32(id_.cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> dict[str, list[int]]:
    """The prototype of each language, from labelled training documents."""
    ship(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang")).where("doc_id is not null and lang is not null")
    # the least of each (language, salt), then of each language: no task sees more
    # than a share of one language's ids, or SALTS * per_language of them
    chosen = read.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):
        by_hash = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= per_language)
    chosen = chosen.select("doc_id", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, texts in _blocks(batches):
            vectors = np.rint(text_vectors(texts) * UNIT).astype(np.int64)
            for lang, v in zip(rows.column(0).to_pylist(), vectors):
                sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(v), "at": np.arange(len(v)),
                                              "x": v})

    # at most per_language rows of (id, language) for each language
    rows = (read.join(F.broadcast(chosen), ["doc_id", "lang"], "semi").select("lang", "text")
            .mapInArrow(run, "lang string, at long, x long")
            .groupBy("lang", "at").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
            .select("lang", F.col("v.x").alias("v")).collect())
    return {r.lang: r.v for r in sorted(rows, key=lambda r: r.lang)}


def predict(docs: DataFrame, prototypes: dict[str, list[int]], id_col: str = "doc_id",
            text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (the id by default) with lang_pred and score, from the text alone."""
    ship(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), DIMENSIONS)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast(
        (names, np.divide(matrix, norms, out=matrix, where=norms > 0)))
    kept = docs.select(*(carry or [F.col(id_col).alias("doc_id")]))
    read = docs.select(*(carry or [F.col(id_col).alias("doc_id")]),
                       F.col(text_col).alias("text to read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = shared.value
        for rows, texts in _blocks(batches):
            vectors = text_vectors(texts)
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if names:
                cosines = np.round(vectors @ unit.T, 6)
                best = cosines.argmax(axis=1)
                for i in np.flatnonzero(vectors.any(axis=1)).tolist():
                    langs[i] = names[best[i]]
                    scores[i] = float(min(1.0, max(0.0, cosines[i, best[i]])))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*rows.schema.names[:-1], "lang_pred", "score"])

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])
    return read.mapInArrow(run, schema)
