"""Document fingerprints of closed syncmers.

A k-mer of a text is a closed syncmer when its smallest s-mer (by hash, the
leftmost of equal ones) is its first or its last. Whether it is one depends on
the k-mer alone, so an edit moves no anchor that it does not touch. A
fingerprint lists the hashes of a text's syncmers in the order of their
positions. Two fingerprints are matched by position: the longest run of common
anchors in the same order, without crossings, counted twice over the anchors
of both (1 for equal texts, 0 for nothing in common).

Every stretch of 2k - s - 1 characters holds a syncmer, but a short text may keep
none when half of it is replaced. So every text, whatever its length, also lists
the runs of ``GRAM`` characters that begin in its first or end in its last ``EDGE``
characters, with marks before its start and after its end: what keeps its first or
last character keeps an anchor, and a character more changes a few anchors at any
length. The empty text has one anchor, the hash of the whole text. Characters are
code points.

``neighbours`` gives each document the next one by id. Documents are dealt by
id ranges whose bounds are ids of the table; the document on a bound goes to
its own range and, as the last row, to the range before it, so no row is
looked up and each text is shuffled once.

Defined cases: a NULL text is empty; the empty text has the anchor of the
empty text; NULL ids come before all others; equal ids are ordered by text;
repeated rows each give a row; an only document is its own next; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import ship

K = 16   # characters of a k-mer
S = 8    # characters of its s-mers
GRAM = 3  # characters of the runs that are listed besides
EDGE = 22  # characters at each end of a text whose runs are listed
BASE = 0x9E3779B97F4A7C15
ROWS = 200


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of hashes (multiply and fold)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _poly(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` items, by doubling."""
    out = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    done, power, width, level = 0, codes, 1, BASE
    while width <= size:  # ``power`` holds the hashes of runs of ``width``
        if size & width:
            out = out * np.uint64(level) + power[done:done + len(out)]
            done += width
        power = (_mixed(power[:-width] * np.uint64(level) + power[width:])
                 if len(power) > width else power[:0])
        width *= 2
        level = (level * BASE + 1) % 2 ** 64
    return _mixed(out)


def _mixed_runs(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the run of ``GRAM`` items at each start."""
    out = np.full(len(starts), GRAM, np.uint64)
    for i in range(GRAM):
        out = _mixed(out * np.uint64(BASE) + codes[starts + i])
    return out


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` items, by doubling."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(text: str, k: int = K, s: int = S) -> np.ndarray:
    """32-bit hashes of the closed syncmers (and short runs) of ``text``, by position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    closed, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(text) >= k:
        inner = _poly(codes, s)
        least = _sliding_min(inner, k - s + 1)
        n = len(least)
        closed = np.flatnonzero((inner[:n] == least) | (inner[k - s:k - s + n] == least))
        if len(closed):
            # two s-mer ends and the middle tell k-mers apart; hash all of each k-mer
            pieces = inner[closed[:, None] + np.arange(0, k - s + 1, s)]
            out = np.zeros(len(closed), np.uint64)
            for column in pieces.T:
                out = _mixed(out * np.uint64(BASE) + column)
    if len(text):
        before, after = (np.full(GRAM - 1, mark, np.uint64) for mark in (1 << 32, 1 << 33))
        edged = np.concatenate([before, codes, after])
        last = len(edged) - GRAM   # where the last run begins
        starts = np.unique(np.concatenate([np.arange(0, min(EDGE + GRAM - 1, last + 1)),
                                           np.arange(max(0, last - EDGE - GRAM + 2), last + 1)]))
        runs = _mixed_runs(edged, starts)
        places = np.concatenate([starts - (GRAM - 1), closed])
        out = np.concatenate([runs, out])[np.argsort(places, kind="stable")]
    if len(out):
        return (out >> np.uint64(32)).astype(np.uint32)
    whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
    return np.frombuffer(whole, ">u4").astype(np.uint32)


def _equal_head(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the longest common ordered run of anchors over the anchors of both."""
    size = len(a) + len(b)
    matched = _equal_head(a, b)
    a, b = a[matched:], b[matched:]
    tail = _equal_head(a[::-1], b[::-1])
    matched += tail
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if shared := set(a.tolist()).intersection(b.tolist()):
        places: dict[int, int] = defaultdict(int)  # a bit per place among b's shared anchors
        width = 0
        for x in b.tolist():
            if x in shared:
                places[x] |= 1 << width
                width += 1
        full = (1 << width) - 1
        free = full  # the run's length is the number of cleared bits
        for x in a.tolist():
            if x in shared:
                hit = free & places[x]
                free = ((free + hit) | (free - hit)) & full
        matched += width - free.bit_count()
    return 2.0 * matched / size


def fingerprint_text(marks: np.ndarray) -> str:
    return marks.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt by id range and sorted, each range closed by its next document.

    Columns: range, last (true for the closing copy), doc_id, text.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    row = read.agg(F.percentile_approx("doc_id", shares, 10_000).alias("q"),
                   F.min("doc_id").alias("least")).first()
    bounds = sorted({x for x in row.q or [] if x > row.least})  # at most one per partition
    # ids are long: range i holds bounds[i-1] <= id < bounds[i]; NULL ids are in range 0
    held = F.array(*(F.lit(x).cast("long") for x in bounds)) if bounds else F.array().cast("array<long>")
    own = F.coalesce(F.size(F.filter(held, lambda x: x <= F.col("doc_id"))), F.lit(0))
    on_bound = F.array_contains(held, F.col("doc_id"))
    dealt = read.select("doc_id", "text", own.alias("range")).select(
        "doc_id", "text", F.explode(F.when(on_bound, F.array(
            F.struct(F.col("range").alias("range"), F.lit(False).alias("last")),
            F.struct((F.col("range") - 1).alias("range"), F.lit(True).alias("last"))))
            .otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("last"))))
        ).alias("x")).select("x.range", "x.last", "doc_id", "text")
    first = (read.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1)
             .select(F.lit(len(bounds)).alias("range"), F.lit(True).alias("last"), "doc_id", "text"))
    return (dealt.union(first).repartition(parts, "range")
            .sortWithinPartitions("range", "last", F.col("doc_id").asc_nulls_first(), "text"))


def edited_with(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the next text's start."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = K, s: int = S) -> DataFrame:
    """Per document: its text's and its edited text's fingerprint and likenesses."""
    ship(docs.sparkSession)
    dealt = with_next(docs, id_col, text_col)
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, kind = None, [], None

        def made() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(
                zip(*out), [kind, pa.int64(), pa.string(), pa.string(), pa.string(),
                            pa.float64(), pa.float64()])]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            kind = b.column(2).type
            for number, last, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0] != number:
                    held = None  # a further copy of the closing document was passed
                marks = anchors(text, k, s)
                if held:
                    _, before, own_text, own = held
                    edited = edited_with(own_text, text)
                    new = anchors(edited, k, s)
                    out.append((before, len(own_text), edited, fingerprint_text(own),
                                fingerprint_text(new), likeness(own, new), likeness(own, marks)))
                held = None if last else (number, doc, text, marks)
                if len(out) >= ROWS:
                    yield made()
        if out:
            yield made()

    kind = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
