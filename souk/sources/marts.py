"""Mart export (S7), export manifest (S8) and mart source by name.

The marts are the serving contract: consumers read the exported Parquet,
never the raw tables. Marts are bounded by key cardinality (months, states,
categories, routes), so each is written as one file in its sorted order. They are
published together (``souk.sources.publish``): a failed export leaves the last one
readable, and what each mart held is recorded and checked when it is read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from souk.sources.publish import manifest, publish, read_all_published, read_published

# The twelve marts that are exported, in export order.
EXPORTED_MARTS = (
    "sales_monthly_trend",
    "sales_by_category",
    "sales_by_state",
    "sales_payment_breakdown",
    "logistics_delivery_by_state",
    "logistics_delay_distribution",
    "logistics_freight_ratio",
    "logistics_route_performance",
    "reviews_score_distribution",
    "reviews_score_by_delay",
    "reviews_score_by_category",
    "reviews_score_by_payment",
)


def export_marts(marts: Mapping[str, DataFrame], base: str,
                 names=EXPORTED_MARTS, max_concurrent_jobs: int = 4) -> dict[str, Row]:
    """Publish each allow-listed mart under ``base``, all of them at once; their entries.

    Helper and cleaning views are not exported even if present in ``marts``. The
    marts are independent jobs, of which up to ``max_concurrent_jobs`` run at once;
    readers see the old marts until all new ones are written.
    """
    return publish({n: marts[n] for n in names}, base, one_file=True, max_concurrent_jobs=max_concurrent_jobs)


def load_mart(spark: SparkSession, name: str, base: str, check: bool = True) -> DataFrame:
    """Read an exported mart by name.

    Raises ``ValueError`` for a name that is not an exported mart,
    ``FileNotFoundError`` if the mart has not been exported yet and (with ``check``)
    ``DamagedTable`` if its files or contents are not those that were exported.
    """
    if name not in EXPORTED_MARTS:
        raise ValueError(f"Unknown mart '{name}'. Valid marts: {sorted(EXPORTED_MARTS)}")
    try:
        return read_published(spark, base, name, check)
    except FileNotFoundError as e:
        raise FileNotFoundError(f"{base}/{name} not found. Export the marts first.") from e


def export_manifest(spark: SparkSession, base: str, names=EXPORTED_MARTS,
                    entries: Mapping[str, Row] | None = None) -> DataFrame:
    """Rows and columns of each exported mart, counted in the written Parquet."""
    live = read_all_published(spark, base, names, entries)
    parts = [df.agg(F.count(F.lit(1)).alias("num_rows"))
             .select(F.lit(i).alias("export_order"), F.lit(name).alias("mart"),
                     "num_rows", F.lit(len(df.columns)).alias("num_columns"))
             for i, (name, df) in enumerate(live.items(), start=1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_sizes(spark: SparkSession, base: str, names=EXPORTED_MARTS) -> DataFrame:
    """S8 (sizes): files, bytes, rows and content digest of each exported mart, as
    its manifest entry records them."""
    live = manifest(spark, base)
    return spark.createDataFrame(
        [(i, n, live[n].num_files, live[n].size_bytes, live[n].num_rows,
          f"{live[n].digest_a}:{live[n].digest_b}") for i, n in enumerate(names, start=1) if n in live],
        "export_order int, mart string, num_files long, size_bytes long, num_rows long, digest string")
