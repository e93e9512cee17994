"""Data-quality profile of raw tables (S3, S4a-S4e).

Each profile is one aggregate pass per table; per-table results are unioned
into one long DataFrame (table, ...). Nothing is collected to the driver:
column lists come from the schema, values from distributed aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources.csv_source import LoadAccount
from souk.sources.publish import content_digest, row_hashes, stored_values


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    return _union([
        df.agg(F.count(F.lit(1)).alias("num_rows"))
        .select(F.lit(name).alias("table_name"), "num_rows",
                F.lit(len(df.columns)).alias("num_columns"))
        for name, df in tables.items()])


def _column_counts(name: str, df: DataFrame) -> DataFrame:
    """One pass: (table, position, column, type, null count, non-null count)."""
    aggs = []
    for c in df.columns:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n{len(aggs)}"))
        aggs.append(F.count(F.col(c)).alias(f"n{len(aggs)}"))
    wide = df.agg(*aggs)

    def lit(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    stack_args = ", ".join(
        f"{i + 1}, {lit(f.name)}, {lit(f.dataType.simpleString())}, n{2 * i}, n{2 * i + 1}"
        for i, f in enumerate(df.schema.fields))
    return wide.selectExpr(
        f"stack({len(df.columns)}, {stack_args}) "
        "AS (position, column_name, data_type, null_count, non_null_count)"
    ).select(F.lit(name).alias("table_name"), "position", "column_name", "data_type",
             "null_count", "non_null_count")


def profile_dtypes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column types per table, with how many values each column holds."""
    return _union([_column_counts(n, df) for n, df in tables.items()]).select(
        "table_name", "position", "column_name", "data_type", "non_null_count")


def profile_nulls(tables: Mapping[str, DataFrame]) -> DataFrame:
    """NULL count per column, only columns that have NULLs."""
    return (_union([_column_counts(n, df) for n, df in tables.items()])
            .where(F.col("null_count") > 0)
            .select("table_name", "column_name", "null_count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows after the first occurrence of an identical row (NULL equals NULL).

    Rows are grouped by a 128-bit digest, so the shuffle carries 16 bytes of a row
    (and a heavily repeated row is collapsed map-side). Only the rows of
    digests that repeat, met by a semi join, are then grouped on all their columns,
    which settles whether equal digests are equal rows.
    """
    a, b = row_hashes([F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumn("_digest_a", a).withColumn("_digest_b", b)
    digest = ["_digest_a", "_digest_b"]
    repeated = keyed.groupBy(*digest).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*digest)
    g = (keyed.join(repeated, digest, "left_semi").groupBy(*digest, *(f"`{c}`" for c in df.columns))
         .agg(F.count(F.lit(1)).alias("_n")))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long")
                 .alias("duplicate_rows"))


def profile_duplicates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """S4d: duplicate row count per table."""
    return _union([duplicate_rows(df).select(F.lit(n).alias("table_name"), "duplicate_rows")
                   for n, df in tables.items()])


def profile_sample(df: DataFrame, key: Sequence[str], n: int = 3) -> DataFrame:
    """S4e: the first ``n`` rows by key (Spark has no file order; the key,
    then the remaining columns as tie-breakers, make the sample
    deterministic). Planned as a top-k, not a full sort."""
    order = list(key) + [c for c in df.columns if c not in key]
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n)


def reconcile_counts(source: Mapping[str, DataFrame], stored: Mapping[str, DataFrame]) -> DataFrame:
    """S3: source rows vs stored rows per table, by number and by content."""
    sides = []
    for side, tables in (("source", source), ("stored", stored)):
        sides.append(_union([
            df.agg(*content_digest(stored_values(df))).select(
                F.lit(name).alias("table_name"), F.lit(side).alias("side"), "num_rows",
                F.concat_ws(":", "digest_a", "digest_b").alias("digest"))
            for name, df in ((n, tables[n]) for n in source)]))
    both = sides[0].unionByName(sides[1])

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return (both.groupBy("table_name").agg(
        of("source", "num_rows").alias("source_rows"), of("stored", "num_rows").alias("stored_rows"),
        (of("source", "digest") == of("stored", "digest")).alias("same_contents"))
        .withColumn("matches", (F.col("source_rows") == F.col("stored_rows")) & F.col("same_contents")))


def reconcile_loads(accounts: Mapping[str, LoadAccount], stored: Mapping[str, DataFrame]) -> DataFrame:
    """S3 after a load: what the source texts held vs the stored rows, and what was lost.

    The source side was counted and hashed from the texts while they were loaded, so
    a value that did not survive its conversion is a difference. ``matches`` needs
    equal rows, equal contents and no loss.
    """
    parts = []
    for name, seen in accounts.items():
        df = stored[name]
        parts.append(df.agg(*content_digest(stored_values(df))).select(
            F.lit(name).alias("table_name"), F.lit(seen.rows).cast("long").alias("source_rows"),
            F.col("num_rows").alias("stored_rows"), F.lit(seen.broken_rows).cast("long").alias("broken_rows"),
            F.lit(seen.lost_values).cast("long").alias("lost_values"),
            ((F.col("digest_a") == seen.digest[0]) & (F.col("digest_b") == seen.digest[1])).alias("same_contents")))
    return _union(parts).withColumn(
        "matches", (F.col("source_rows") == F.col("stored_rows")) & F.col("same_contents")
        & (F.col("broken_rows") == 0) & (F.col("lost_values") == 0))


def load_losses(spark: SparkSession, accounts: Mapping[str, LoadAccount]) -> DataFrame:
    """What loads lost: a row per table, column (NULL: whole rows) and reason."""
    rows = [(name, *loss) for name, seen in accounts.items() for loss in seen.losses()]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, reason string, num_lost long")
