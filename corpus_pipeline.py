"""Pipeline from raw documents to packed training sequences.

Stages: language ID, quality rules, near duplicates, secrets, packing. Each
takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared scratch folder and rereads it for the next stage. All but
the last return the columns of ``documents``.

A row's decision is joined to it by a digest of its columns, never by its id, so
different documents of one id are judged each for itself; only rows with a
decision are on the other side of those joins. Rows without id are judged like
all others and never taken for copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import adapt_join, hd_language, line_quality, packing, secret_scan
from souk.llm.common import digest128, stored
from souk.llm.queries import WORD_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_LANGUAGE_SCORE = 0.05   # a smaller cosine with every language: rejected
COPY_WORDS = 5              # words of a shingle of the near-duplicate stage
COPY_PERCENT = 80           # least similarity of near copies


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letters, or like no language)."""
    learned = hd_language.learn(docs.where(~hd_language.held_out(F.col("doc_id"), 4, 2)))
    found = hd_language.predict(docs, learned, carry=list(COLUMNS))
    return found.where((F.col("lang_pred") != hd_language.UNDETERMINED)
                       & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents and removes the lines above the limits."""
    judged = line_quality.line_quality(docs)
    decided = (judged.where(~F.col("kept") | F.col("drop_lines").isNotNull())
               .select("row_a", "row_b", "kept", "drop_lines").dropDuplicates(["row_a", "row_b"]))
    rows = docs.select(*COLUMNS).select(*COLUMNS, *digest128(
        "row", F.col("doc_id"), F.col("source"), F.col("text")))
    text = line_quality.drop_lines(F.col("text"), F.col("drop_lines"))
    return (rows.join(decided, ["row_a", "row_b"], "left")
            .where(F.coalesce("kept", F.lit(True)))
            .select("doc_id", text.alias("text"), "lang", "source")
            .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies, the document with the least id.

    Decided by row digest: rows of one id that are no near copies of each other all
    stay. Of rows of that least id the one with the least digest stays, and one of
    rows that are alike in every column.
    """
    row, rows_in = [F.col(c) for c in COLUMNS], docs.count()
    found = stored(adapt_join.similar_components(docs, words=COPY_WORDS, percent=COPY_PERCENT, row=row)
                   .where("doc_id is not null and set_id is not null")
                   .groupBy("component_set", "doc_id", "row_a", "row_b").agg(F.count(F.lit(1)).alias("times")),
                   "near-copies", rows=rows_in)
    least = found.groupBy("component_set").agg(F.min(F.struct("doc_id", "row_a", "row_b")).alias("least"))
    stays = ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("row_a") == F.col("least.row_a"))
             & (F.col("row_b") == F.col("least.row_b")))
    judged = found.join(least, "component_set").withColumn("stays", stays).where(~F.col("stays") | (F.col("times") > 1))
    judged = stored(judged.select("row_a", "row_b", "stays"), "copies", rows=rows_in)
    rows = docs.select(*COLUMNS).select(*COLUMNS, *digest128("row", *row))
    kept = rows.join(judged.where("not stays"), ["row_a", "row_b"], "anti")
    repeated = judged.where("stays").select("row_a", "row_b")
    if not repeated.isEmpty():  # rows alike in every column: one of them
        once = kept.join(repeated, ["row_a", "row_b"], "semi").dropDuplicates(["row_a", "row_b"])
        kept = kept.join(repeated, ["row_a", "row_b"], "anti").unionByName(once)
    return kept.select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of a secret by a mark."""
    found = (secret_scan.scan(docs).where(F.size("spans") > 0)
             .select("row_a", "row_b", "spans").dropDuplicates(["row_a", "row_b"]))
    rows = docs.select(*COLUMNS).select(*COLUMNS, *secret_scan.row_digest())
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(
        secret_scan.redact(F.col("text"), F.col("spans")))
    return (rows.join(found, ["row_a", "row_b"], "left")
            .select("doc_id", text.alias("text"), "lang", "source")
            .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, WORD_BPE)


STAGES = [("language ID", language_stage), ("quality rules", quality_stage),
          ("n-gram Jaccard join", duplicate_stage), ("secret scans", secret_stage),
          ("packing", packing_stage)]

# Language ID, the tokenizer and the order of packing have no SQL form. The
# near-duplicate stage is tested against all pairs, op3 and op9 against plain
# counting; the pipeline as a whole has no brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
