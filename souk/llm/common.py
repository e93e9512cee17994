"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.session import scratch_path

FILE_ROWS = 250_000  # short rows of a file of ``stored``

# ASCII white space as the operators' word rules name it.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage: what follows reads files that outlive any executor,
    and a plan used twice is computed once. ``rows``, if known, is about how many
    short rows (of a few numbers) it has: they go to as many files as that asks for,
    and two for each core at least, instead of one for each shuffle partition.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Non-empty words of a text (NULL: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def digest128(name: str, *cols: Column) -> list[Column]:
    """Two 64-bit hashes of ``cols`` (NULLs told apart), named name_a, name_b."""
    flat = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*flat).alias(f"{name}_a"),
            F.xxhash64(F.lit(name), *flat).alias(f"{name}_b")]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    it need not be installed on the executors. Spark serves the archive."""
    sc = spark.sparkContext
    name = f"souk-{sc.applicationId}.zip"
    if any(name in f for f in sc._python_includes):
        return
    package = Path(__file__).parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="souk-code-"), name)
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)


# What a Python worker keeps from task to task (bounded tables, by operator).
WORKER: dict[str, dict] = {}


def worker_tables(operator: str) -> dict:
    """The tables that this Python worker keeps for ``operator``. A worker serves one stage
    after the other, so it lets go of what it kept for another operator."""
    if operator not in WORKER:
        WORKER.clear()
        WORKER[operator] = {}
    return WORKER[operator]
