"""Tables that are replaced at once, with a record of what they hold.

A set of tables lives under one folder. Each table has two slots, and a small
manifest says which one is live and what is in it: rows, files, bytes, schema and
a digest of the contents. ``publish`` writes every table into its other slot, then
appends the new entries to the manifest in one commit; readers go by the newest
entry of a table. A rebuild that fails before that commit leaves all tables as they
were, and at most two copies of a table are kept.

The digest does not depend on the order or the files of the rows: the sums of two
64-bit row hashes, taken while the rows are written. ``read_published`` can check
files, bytes, rows and digest before it hands a table out.

One publisher at a time per folder. A reader that still holds a table's
DataFrame when the table is published for the second time after it must read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = ("version long, table_name string, slot string, num_rows long, num_files long, "
            "size_bytes long, digest_a string, digest_b string, schema string")


class DamagedTable(ValueError):
    """A published table does not hold what its manifest says."""


def row_hashes(values: Sequence[Column]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row; NULLs are told apart from each other and from text."""
    flat = [x for v in values for x in (v.isNull(), v)]
    return F.xxhash64(*flat), F.xxhash64(F.lit("second"), *flat)


def content_digest(values: Sequence[Column]) -> list[Column]:
    """Aggregates num_rows, digest_a, digest_b of the rows made of ``values``."""
    a, b = row_hashes(values)
    return [F.count(F.lit(1)).alias("num_rows"),
            *(F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias(n)
              for n, h in (("digest_a", a), ("digest_b", b)))]


def stored_values(df: DataFrame) -> list[Column]:
    """The columns of a stored table as the digest takes them (their text)."""
    return [F.col(f"`{c}`").cast("string") for c in df.columns]


def manifest(spark: SparkSession, base: str) -> dict[str, Row]:
    """The newest entry of every published table; empty if nothing was published."""
    try:
        entries = spark.read.schema(MANIFEST).json(f"{base.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    newest = entries.groupBy("table_name").agg(F.max_by(F.struct(*entries.columns), "version").alias("e"))
    return {r.table_name: r.e for r in newest.collect()}


def _slot_path(base: str, name: str, slot: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet/{slot}"


def _files(spark: SparkSession, base: str, slots: Mapping[str, str]) -> dict[str, tuple[int, int]]:
    """Files and bytes of each table's slot (only names and lengths are read)."""
    paths = [_slot_path(base, n, s) for n, s in slots.items()]
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths)
             .select(F.regexp_extract("path", r"/([^/]+)\.parquet/[^/]+/[^/]+$", 1).alias("name"), "length")
             .groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")))
    return {r.name: (r.files, r.bytes) for r in found.collect()}


def publish(tables: Mapping[str, DataFrame], base: str, one_file: bool = False,
            max_concurrent_jobs: int = 4) -> dict[str, Row]:
    """Write ``tables`` and make them the live ones together; returns the manifest.

    The tables are independent jobs, of which a few run at once.
    """
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    before = manifest(spark, base)
    slots = {n: "slot-1" if n in before and before[n].slot == "slot-0" else "slot-0" for n in tables}

    def write(name: str) -> Row:
        df, seen = tables[name], Observation()
        rows = df.observe(seen, *content_digest(stored_values(df)))
        (rows.coalesce(1) if one_file else rows).write.mode("overwrite").parquet(
            _slot_path(base, name, slots[name]))
        return Row(**seen.get)

    with ThreadPoolExecutor(max_workers=max(1, max_concurrent_jobs)) as pool:
        seen = dict(zip(tables, pool.map(write, tables)))
    sizes = _files(spark, base, slots)
    version = 1 + max((e.version for e in before.values()), default=0)
    entries = {n: Row(version=version, table_name=n, slot=slots[n], num_rows=seen[n].num_rows,
                      num_files=sizes.get(n, (0, 0))[0], size_bytes=sizes.get(n, (0, 0))[1],
                      digest_a=seen[n].digest_a, digest_b=seen[n].digest_b,
                      schema=tables[n].schema.json()) for n in tables}
    (spark.createDataFrame(list(entries.values()), MANIFEST).coalesce(1)
     .write.mode("append").json(f"{base.rstrip('/')}/manifest"))
    return {**before, **entries}


def read_published(spark: SparkSession, base: str, name: str, check: bool = False) -> DataFrame:
    """The live version of a table; ``FileNotFoundError`` if it was never published.

    With ``check`` its files, rows and contents are compared with the manifest first
    (one pass over the table), and ``DamagedTable`` is raised if they differ.
    """
    entry = manifest(spark, base).get(name)
    if entry is None:
        raise FileNotFoundError(f"{base}: no published table {name}")
    return _opened(spark, base, entry, check)


def read_all_published(spark: SparkSession, base: str, names: Sequence[str],
                       live: Mapping[str, Row] | None = None) -> dict[str, DataFrame]:
    """Several tables from one look at the manifest (``live``: the one just published)."""
    live = manifest(spark, base) if live is None else live
    missing = [n for n in names if n not in live]
    if missing:
        raise FileNotFoundError(f"{base}: no published tables {missing}")
    return {n: _opened(spark, base, live[n], False) for n in names}


def _opened(spark: SparkSession, base: str, entry: Row, check: bool) -> DataFrame:
    name = entry.table_name
    df = spark.read.schema(_schema(entry)).parquet(_slot_path(base, name, entry.slot))
    if check:
        files = _files(spark, base, {name: entry.slot}).get(name, (0, 0))
        if files != (entry.num_files, entry.size_bytes):
            raise DamagedTable(f"{name}: files and bytes {files}, published with "
                               f"{(entry.num_files, entry.size_bytes)}")
        found = df.agg(*content_digest(stored_values(df))).first()
        if tuple(found) != (entry.num_rows, entry.digest_a, entry.digest_b):
            raise DamagedTable(f"{name}: {found.num_rows} rows whose digest is not that of the "
                               f"{entry.num_rows} published")
    return df


def _schema(entry: Row) -> T.StructType:
    import json
    return T.StructType.fromJson(json.loads(entry.schema))
