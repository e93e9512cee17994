"""Quality rules with cross-document line frequency (DataFrame functions only).

``profile`` reads each text once and keeps, per row, the word and line counts
of the base rules and a compact record of its lines: the 128-bit hash of
(host, normalised line), the line's number and its words. ``frequent_lines``
counts, per host, the distinct documents that hold a line; exact copies of a
document count once, so a much-copied page does not turn its own lines into
furniture. A line is removed when it stands in at least ``min_docs`` distinct
documents and in more than ``max_share`` of its host's documents, or in ``max_docs``
documents, however many its host has. Its length does not matter; lines without a
word stay. A document that loses more than
``max_removed`` of its words is depleted and rejected, and so is one that fails
the base rules.

Shuffled are line hashes and row digests, never texts. Line counts combine
before the shuffle, first by (line, document), then by line, so one line that
stands in every document spreads over all tasks; the join back to the rows
salts the line by the row.

Defined cases: a NULL text has no words and fails the base rules; a NULL host
is a host of its own; a NULL id is kept; repeated rows each give a row and
count as one document; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import GAP, digest128, stored, words_of

SYMBOLS = r"[#*$%&|<>]"
SALTS = 16


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50       # fewer words: rejected
    max_repeat_pct: int = 50  # more of the words in repeated windows: rejected
    min_docs: int = 10        # a removed line stands in this many documents of its host
    max_share: float = 0.01   # ... and in more than this share of them,
    max_docs: int = 1000      # or in so many documents of a host of any size
    max_removed: float = 0.5  # a larger share of removed words: rejected


def _window_hashes(words: Column) -> Column:
    hashed = F.transform(words, lambda w, i: F.xxhash64(
        w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, F.slice(hashed, F.lit(1), F.size(words) - 2)).otherwise(
        F.array().cast("array<bigint>"))


MANY = 12  # repeated windows of a text that are looked up one by one


def _sorted_pairs(hashes: Column, twice: Column) -> Column:
    """(hash, start) sorted, for texts with many repeated windows; else empty."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(twice) > MANY, F.sort_array(pairs))


def _repeat_starts(hashes: Column, twice: Column, pairs: Column) -> Column:
    """Ascending starts of the windows that occur more than once.

    Each argument is a column, not an expression: the lambdas read them per
    element. Few repeated hashes are looked up directly; with many, equal
    windows stand side by side in ``pairs``.
    """
    looked_up = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1),
                         lambda i: F.array_contains(twice, F.get(hashes, i)))
    beside = F.filter(F.transform(pairs, lambda p, k: F.when(
        (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"])),
        lambda i: i.isNotNull())
    return (F.when(F.size(twice) == 0, F.array().cast("array<int>"))
            .when(F.size(twice) <= MANY, looked_up).otherwise(F.sort_array(beside)))


def _covered(starts: Column) -> Column:
    """Words inside the three-word windows that begin at ``starts``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(starts, zero, lambda acc, s: F.struct(
        (acc["n"] + s + 3 - F.greatest(s, acc["end"])).alias("n"), (s + 3).alias("end")),
        lambda acc: acc["n"])


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source", rules: LineRules = LineRules()) -> DataFrame:
    """One row per document: base counts, digests and its lines (stored)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
                        F.col(text_col).alias("text"))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(
        i.alias("number"), x.alias("line")))
    worded = F.filter(lines, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    split = read.select(
        "doc_id", "host", "text",
        *digest128("row", F.col("doc_id"), F.col("host"), F.col("text")),
        F.xxhash64(text, F.lit("document")).alias("doc_hash"),
        words_of(F.col("text")).alias("words"), worded.alias("lines"))
    hashed = split.withColumn("hashes", _window_hashes(F.col("words")))
    ordered = hashed.withColumn(
        "ordered", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"),
                          F.sort_array("hashes")).otherwise(F.array().cast("array<bigint>")))
    twice = ordered.withColumn("twice", F.array_distinct(F.filter(
        F.col("ordered"), lambda h, i: (i > 0) & (F.get(F.col("ordered"), i - 1) == h))))
    paired = twice.withColumn("pairs", _sorted_pairs(F.col("hashes"), F.col("twice")))
    starts = paired.withColumn("starts", _repeat_starts(
        F.col("hashes"), F.col("twice"), F.col("pairs")))

    def line_key(x: Column) -> Column:
        line = F.lower(F.trim(F.regexp_replace(x["line"], GAP, " ")))
        return F.struct(x["number"].alias("number"),
                        F.size(F.split(line, " ")).alias("n"), *digest128("line", F.col("host"), line))

    plain = F.transform("lines", lambda x: x["line"])
    measured = starts.select(
        "doc_id", "row_a", "row_b", "host", "doc_hash",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(plain))).cast("long").alias("n_dup_lines"),
        _covered(F.col("starts")).cast("long").alias("n_repeat_words"),
        F.transform("lines", line_key).alias("lines"))
    failed = ((F.col("n_words") < rules.min_words)
              | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")))
    return stored(measured.withColumn("base_failed", failed), "line-profile")


def frequent_lines(profiled: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(line_a, line_b, n_docs) of the lines above the limits of their host."""
    held = profiled.select("host", "doc_hash", F.explode(
        F.transform("lines", lambda x: F.struct(x["line_a"], x["line_b"]))).alias("x")).select("host", "doc_hash", "x.line_a", "x.line_b")
    counted = (held.distinct().groupBy("host", "line_a", "line_b")
               .agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= rules.min_docs))
    hosts = (profiled.select("host", "doc_hash").distinct()
             .groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
             .withColumnRenamed("host", "its_host"))
    return (counted.join(hosts, F.col("host").eqNullSafe(F.col("its_host")))
            .where((F.col("n_docs") > rules.max_share * F.col("host_docs"))
                   | (F.col("n_docs") >= rules.max_docs))
            .select("line_a", "line_b", "n_docs"))


def removed_lines(profiled: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per row digest: the line numbers to remove and the words they hold."""
    salted = frequent.select("line_a", "line_b", F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = (profiled.dropDuplicates(["row_a", "row_b"])
            .select("row_a", "row_b", F.explode("lines").alias("x"))
            .select("row_a", "row_b", "x.*", F.pmod("row_b", F.lit(SALTS)).cast("int").alias("salt")))
    return (held.join(salted, ["line_a", "line_b", "salt"])
            .groupBy("row_a", "row_b").agg(F.collect_list("number").alias("drop_lines"),
                                           F.sum("n").alias("removed_words")))


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 host_col: str = "source", rules: LineRules = LineRules()) -> DataFrame:
    """Per document: base counts, base_failed, removed lines and the verdict ``kept``."""
    profiled = profile(docs, id_col, text_col, host_col, rules)
    removed = removed_lines(profiled, frequent_lines(profiled, rules))
    depleted = F.coalesce(F.col("removed_words"), F.lit(0)) > rules.max_removed * F.col("n_words")
    return (profiled.drop("lines", "host", "doc_hash").join(removed, ["row_a", "row_b"], "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
            .withColumn("kept", ~F.col("base_failed") & ~depleted))


def drop_lines(text: Column, numbers: Column) -> Column:
    """``text`` without the lines of those numbers (0 is the first).

    The lines and the kept numbers are bound once, as the one item of an array,
    so that the inner lambda does not split the text for every line.
    """
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(numbers, lambda i: i.cast("int")))
    bound = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))
    left = F.transform(bound, lambda x: F.array_join(F.transform(x["kept"], lambda i: F.get(x["lines"], i)), "\n"))
    return F.when(numbers.isNull(), text).otherwise(F.get(left, F.lit(0)))
