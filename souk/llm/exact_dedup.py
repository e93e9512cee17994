"""Exact duplicates by two passes over a Bloom filter.

Equal texts are those that are identical after every run of ASCII white space
became one space; they are told apart by the SHA-256 of that text. The digests
are written once, so each text is read and hashed once.

Pass one inserts every digest into a Bloom filter of two halves, one position in
each, and keeps the positions that were set more than once: the filter of what
may repeat. A task's part of the filter is sparse, so its set positions and how
often each was set are shuffled (combined in the task first), never whole bit
maps and never rows. Equal digests set equal positions, so no repeated digest
can be missing from the second filter.

Pass two looks every row up in that filter, which has a fixed largest size
(``max_filter_bits``) and is broadcast. Rows whose two positions are not both
there are unlike all others and pass straight through. Only the others shuffle:
they are grouped by their whole digest, which also sorts out the filter's errors.
A group of more than one in ``HOT_GROUPS`` of all rows is met by a broadcast
(there are fewer than ``HOT_GROUPS`` of them), all others by a join on the digest.

The filter has ``BITS_PER_ROW`` positions a row in each half. Beyond its largest
size it fills up, more rows shuffle (digest and id) and the result stays the same.

Defined cases: a NULL text is empty, and empty texts equal each other; NULL ids
come after all others, so a row without id stays only where no equal one has an
id; of rows that repeat both text and id one stays; an empty table gives no
rows; only the named columns are read, whatever the others are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import GAP, stored

BITS_PER_ROW = 8            # positions a row in each half of the filter
MAX_FILTER_BITS = 2 ** 28   # largest filter, 32 MB, both halves together
HOT_GROUPS = 10_000         # larger than one in so many rows: a hot group
FEWEST_BITS = 2 ** 15       # a half of the filter of a small table


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of a text with its white space made even."""
    even = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), GAP, " ")
    return F.unhex(F.sha2(even.cast("binary"), 256))


def _positions(half: int) -> list[Column]:
    """The digest's position in each half (from 1, the halves side by side)."""
    return [F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(half)) + F.lit(1 + i * half) for i in (0, 1)]


def repeat_filter(rows: DataFrame, half: int) -> DataFrame:
    """Positions set more than once, as (bucket, bits) rows of 4 KB each."""
    often = (rows.select(F.explode(F.array(*_positions(half))).alias("position"))
             .groupBy("position").agg(F.count("*").alias("times")).where("times > 1"))
    return (often.select(F.bitmap_bucket_number("position").alias("bucket"), "position")
            .repartition("bucket").groupBy("bucket")
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits")))


def _bit_set(bits: Column, position: Column) -> Column:
    at = F.bitmap_bit_position(position).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def may_repeat(rows: DataFrame, found: DataFrame, half: int) -> DataFrame:
    """Adds ``again``: whether the row's digest may stand in other rows too."""
    out, flag = rows, F.lit(True)
    for i, position in enumerate(_positions(half)):
        bits = f"bits_{i}"
        part = F.broadcast(found.select(F.col("bucket").alias(f"bucket_{i}"), F.col("bits").alias(bits)))
        out = out.join(part, F.bitmap_bucket_number(position) == F.col(f"bucket_{i}"), "left")
        flag = flag & _bit_set(F.col(bits), position)
    return out.withColumn("again", flag).drop("bucket_0", "bits_0", "bucket_1", "bits_1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Every row with the id that stays of its group of equal texts.

    Columns: doc_id, keep_id, group_size, kept, digest (binary) and ``row``, a
    struct of the ``carry`` columns (absent without any).
    """
    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    held = [F.struct(*(col(c).alias(c) for c in carry)).alias("row")] if carry else []
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row_no"),
                              col(id_col).alias("doc_id"), text_digest(col(text_col)).alias("digest"),
                              *held), "digests")
    total = rows.count()
    half = max(FEWEST_BITS, min(BITS_PER_ROW * total, max_filter_bits // 2))
    found = stored(repeat_filter(rows, half), "repeat-filter")
    flagged = may_repeat(rows, found, half)

    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("least")
    groups = stored(flagged.where("again").groupBy("digest")
                    .agg(F.count("*").alias("size"), least).where("size > 1"), "equal-texts")
    hot = F.col("size") > max(1, total // HOT_GROUPS)
    of_hot = groups.where(hot).select(F.col("digest").alias("hot_digest"), "size", "least")
    of_rest = groups.where(~hot)

    met = flagged.join(F.broadcast(of_hot), F.col("digest") == F.col("hot_digest"), "left").drop("hot_digest")
    straight = met.where(~F.col("again") | F.col("size").isNotNull()).drop("again")
    shuffled = (met.where(F.col("again") & F.col("size").isNull()).drop("again", "size", "least")
                .join(of_rest, "digest", "left"))
    alone = F.col("size").isNull()
    out = straight.unionByName(shuffled)
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.col("least.row_no"))).alias("kept"), "digest",
        *(["row"] if carry else []))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    return exact_dedup(docs, id_col, text_col, docs.columns).where("kept").select("row.*")
