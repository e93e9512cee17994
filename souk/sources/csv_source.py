"""CSV source for the nine raw tables (S1) and raw materialization.

Ingestion reads every column as text and takes it by its name in the header
(a missing or unknown name raises, and every file's header must agree), turns
the pandas-style missing-value tokens into NULL, then converts each column to
its declared type with ``try_cast`` (text that is no number becomes NULL
instead of failing the job; ``3.0`` is the integer 3). Only tables whose text
fields may span lines are read with ``multiLine``; the others stay
splittable, so a large file is read by many tasks in parallel.

What a load loses is counted while it is written (``open_csv``): rows that do not
have the header's columns, and per column the texts that became NULL, told apart
into numbers that do not fit the type (``3.5`` in a column of whole numbers) and
texts that are no numbers. The same pass takes a digest of the source, made from
the texts: a value that was lost or changed on its way into the table makes
it differ from the digest of the stored rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.schemas import MULTILINE_TABLES, NA_TOKENS, RAW_FILES, RAW_SCHEMAS
from souk.sources.publish import content_digest

BROKEN = "_broken_row"   # the text of a row that does not have the header's columns


def normalize_na(c: Column | str) -> Column:
    """NULL for any missing-value token, else the text unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~c.isin(*NA_TOKENS), c)


def _typed(field: T.StructField) -> Column:
    text = normalize_na(field.name)
    if isinstance(field.dataType, T.StringType):
        return text
    exact = text.try_cast(field.dataType)
    if isinstance(field.dataType, T.IntegralType):
        number = text.try_cast("double")
        whole = F.when(number == F.floor(number), number).try_cast(field.dataType)
        exact = F.coalesce(exact, whole)
    return exact


def _read_texts(spark: SparkSession, path: str, table: str, schema: T.StructType,
                multiline: bool | None) -> DataFrame:
    """Every column as text, and ``BROKEN``; the header must have the schema's names."""
    if multiline is None:
        multiline = table in MULTILINE_TABLES
    reader = (spark.read
              .option("header", True)
              .option("quote", '"')
              .option("escape", '"')
              .option("multiLine", multiline)
              .option("mode", "PERMISSIVE"))
    header = reader.csv(path).columns or schema.names
    if sorted(header) != sorted(schema.names):
        raise ValueError(f"{table}: header {header} does not have the columns {schema.names}")
    text_schema = T.StructType([T.StructField(n, T.StringType(), True) for n in [*header, BROKEN]])
    return (reader.schema(text_schema).option("enforceSchema", False)
            .option("columnNameOfCorruptRecord", BROKEN).csv(path))


def read_raw_csv(spark: SparkSession, path: str, table: str,
                 schema: T.StructType | None = None,
                 multiline: bool | None = None) -> DataFrame:
    """Read one raw CSV (file or folder) with a header into its declared schema."""
    schema = schema or RAW_SCHEMAS[table]
    df = _read_texts(spark, path, table, schema, multiline)
    return df.select([_typed(f).alias(f.name) for f in schema])


@dataclass(frozen=True)
class LoadAccount:
    """What one load read, and what of it did not reach the table."""

    rows: int
    broken_rows: int
    not_whole: Mapping[str, int]    # column -> numbers that do not fit its whole-number type
    no_number: Mapping[str, int]    # column -> texts that are no value of its type
    digest: tuple[str, str]         # of the source texts, as the stored rows would give it

    @property
    def lost_values(self) -> int:
        return sum(self.not_whole.values()) + sum(self.no_number.values())

    def losses(self) -> list[tuple[str | None, str, int]]:
        """(column, reason, count) of everything that was lost."""
        found = [(None, "broken row", self.broken_rows)]
        found += [(c, "number does not fit", n) for c, n in self.not_whole.items()]
        found += [(c, "not a value of its type", n) for c, n in self.no_number.items()]
        return [x for x in found if x[2]]


def _account_columns(schema: T.StructType) -> list[Column]:
    """Aggregates of the text rows, in one pass with whatever reads them."""
    out = [F.count(F.col(BROKEN)).alias("broken")]
    values = []
    for i, f in enumerate(schema):
        text, typed = normalize_na(f.name), _typed(f)
        if isinstance(f.dataType, T.StringType):
            values.append(text)
            continue
        gone = text.isNotNull() & typed.isNull()
        number = text.try_cast("double").isNotNull()
        out += [F.count_if(gone & number).alias(f"not_whole_{i}"),
                F.count_if(gone & ~number).alias(f"no_number_{i}")]
        # a value as the stored row shows it, a lost one as its text
        values.append(F.when(gone, F.concat(F.lit("lost "), text)).otherwise(typed.cast("string")))
    values[0] = F.when(F.col(BROKEN).isNull(), values[0]).otherwise(F.concat(F.lit("broken "), F.col(BROKEN)))
    return out + content_digest(values)


def open_csv(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None,
             multiline: bool | None = None) -> tuple[DataFrame, Callable[[], LoadAccount]]:
    """The typed rows of a CSV, and their account once one action has read them all."""
    schema = schema or RAW_SCHEMAS[table]
    seen = Observation()
    texts = _read_texts(spark, path, table, schema, multiline).observe(seen, *_account_columns(schema))

    def account() -> LoadAccount:
        got = seen.get

        def counts(kind: str) -> dict[str, int]:
            return {f.name: got[f"{kind}_{i}"] for i, f in enumerate(schema) if got.get(f"{kind}_{i}")}

        return LoadAccount(got["num_rows"], got["broken"], counts("not_whole"), counts("no_number"),
                           (got["digest_a"], got["digest_b"]))

    return texts.select([_typed(f).alias(f.name) for f in schema]), account


def widened(schema: T.StructType, account: LoadAccount) -> T.StructType:
    """``schema`` with doubles for whole-number columns that hold other numbers."""
    return T.StructType([T.StructField(f.name, T.DoubleType() if f.name in account.not_whole else f.dataType)
                         for f in schema])


def read_raw_folder(spark: SparkSession, folder: str,
                    files: Mapping[str, str] = RAW_FILES) -> dict[str, DataFrame]:
    """All nine raw tables from ``folder/<file>.csv``."""
    base = folder.rstrip("/")
    return {t: read_raw_csv(spark, f"{base}/{f}", t) for t, f in files.items()}


def write_csv(df: DataFrame, path: str) -> str:
    """Write a table as CSV with a header and RFC 4180 quoting (doubled quotes)."""
    (df.write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"')
     # Spark trims whitespace on write by default; keep values as they are.
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return path


def materialize_raw(df: DataFrame, path: str) -> str:
    """Idempotent full overwrite of a raw table as Parquet, no transformation."""
    df.write.mode("overwrite").parquet(path)
    return path
