"""Query keys for sources, sinks, profiling and the view registry.

Jobs that write use a fresh folder under the cluster's shared scratch folder
(``spark.checkpoint.dir``) and return a DataFrame read back from what they
wrote. The raw tables come from the driver tables via the adapter; for the
CSV jobs they are first staged as CSV files, then ingested like the real
source files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.operators import profile as P
from souk.plans.build import build_and_export, ingest_raw, load_raw, stage_csv
from souk.plans.queries import TEST_PARAMS, Query, model_for
from souk.plans.registry import register_views, view_catalog, view_names, view_registry
from souk.schemas import RAW_FILES, RAW_KEYS
from souk.session import scratch_path
from souk.sources.csv_source import read_raw_csv
from souk.sources.marts import EXPORTED_MARTS, export_sizes, load_mart
from souk.sources.testdata import driver_tables


def _raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return driver_tables(spark, sf_dir)


def _csv_ingest(table: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = _raw(spark, sf_dir)
        paths = stage_csv({table: raw[table]}, scratch_path(spark, "csv"))
        return read_raw_csv(spark, paths[table], table)
    return q


def raw_materialize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine tables from CSV to published Parquet; rows and columns of what is stored."""
    paths = stage_csv(_raw(spark, sf_dir), scratch_path(spark, "csv"))
    stored, _ = load_raw(spark, paths, scratch_path(spark, "raw"))
    return P.profile_shape(stored)


def raw_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    paths = stage_csv({"raw_orders": raw["raw_orders"]}, scratch_path(spark, "csv"))
    stored, _ = load_raw(spark, paths, scratch_path(spark, "raw"))
    return stored["raw_orders"]


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = stage_csv(_raw(spark, sf_dir), scratch_path(spark, "csv"))
    _, report = ingest_raw(spark, paths, scratch_path(spark, "raw"))
    return report


def _damaged_items(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The order items as CSV with planted damage: item numbers that are not whole,
    prices that are no numbers, and rows with a field too many."""
    items = _raw(spark, sf_dir)["raw_order_items"]
    order, number = F.col("order_id").cast("long"), F.col("order_item_id")
    planted = {
        "order_item_id": F.when((number == 1) & (order % 11 == 0), "1.5"),
        "price": F.when((number == 2) & (order % 7 == 0), "abc"),
        "freight_value": F.when((number == 3) & (order % 5 == 0), F.concat(
            F.col("freight_value").cast("string"), F.lit(",surplus"))),
    }
    texts = [F.coalesce(planted.get(c, F.lit(None)), F.col(c).cast("string")).alias(c) for c in items.columns]
    path = scratch_path(spark, "csv-damaged")
    # without quoting, the planted comma makes one field more
    items.select(*texts).write.option("header", True).option("quote", "\u0000").csv(path)
    return {"raw_order_items": path}


def damaged_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of damaged order items reports as lost, by column and reason."""
    _, accounts = load_raw(spark, _damaged_items(spark, sf_dir), scratch_path(spark, "raw"))
    return P.load_losses(spark, accounts)


def damaged_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same load compared with its source: as many rows, other contents."""
    _, report = ingest_raw(spark, _damaged_items(spark, sf_dir), scratch_path(spark, "raw"))
    return report


def widened_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item numbers after a load that widens them: 1.5 is kept as a double."""
    stored, _ = load_raw(spark, _damaged_items(spark, sf_dir), scratch_path(spark, "raw"), widen=True)
    return (stored["raw_order_items"].groupBy("order_item_id").agg(F.count(F.lit(1)).alias("num_items")))


def changed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw table against a copy in which one row of the payments has one cent
    more: as many rows everywhere, other contents in one table."""
    raw = _raw(spark, sf_dir)
    payments = raw["raw_order_payments"]
    least = payments.select(F.min("order_id")).scalar()
    changed = payments.withColumn("payment_value", F.when(
        (F.col("order_id") == least) & (F.col("payment_sequential") == 1),
        F.col("payment_value") + 0.01).otherwise(F.col("payment_value")))
    return P.reconcile_counts(raw, {**raw, "raw_order_payments": changed})


def mart_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the exported marts, read back."""
    base = scratch_path(spark, "marts")
    build_and_export(_raw(spark, sf_dir), base, TEST_PARAMS)
    return load_mart(spark, "logistics_route_performance", base)


def mart_export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of all twelve exported marts, read back and checked:
    (mart, row key, column, value as text) without the order of the rows."""
    base = scratch_path(spark, "marts")
    build_and_export(_raw(spark, sf_dir), base, TEST_PARAMS, staging_folder=scratch_path(spark, "clean"))
    parts = []
    for name in EXPORTED_MARTS:
        df = load_mart(spark, name, base)
        numbers = [f.name for f in df.schema if not isinstance(f.dataType, T.StringType)]
        key = F.concat_ws("|", *(F.coalesce(F.col(f.name), F.lit("-")) for f in df.schema
                                 if isinstance(f.dataType, T.StringType)))
        parts.append(df.select(F.lit(name).alias("mart"), key.alias("row_key"), F.explode(F.array(*(
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in numbers))).alias("x"))
            .select("mart", "row_key", "x.column_name", "x.value"))
    return reduce(DataFrame.unionByName, parts)


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_and_export(_raw(spark, sf_dir), scratch_path(spark, "marts"), TEST_PARAMS,
                            staging_folder=scratch_path(spark, "clean"))


def export_sizes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "marts")
    build_and_export(_raw(spark, sf_dir), base, TEST_PARAMS)
    return export_sizes(spark, base)


def mart_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "marts")
    build_and_export(_raw(spark, sf_dir), base, TEST_PARAMS, names=("reviews_score_by_payment",))
    return load_mart(spark, "reviews_score_by_payment", base)


def _sample(table: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.profile_sample(_raw(spark, sf_dir)[table], RAW_KEYS[table])
    return q


def view_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(model_for(spark, sf_dir))
    return view_names(spark)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(model_for(spark, sf_dir))
    return view_catalog(spark)


def source_queries() -> dict[str, Query]:
    return {
        "csv_ingest": _csv_ingest("raw_order_reviews"),
        "csv_ingest_orders": _csv_ingest("raw_orders"),
        **{f"csv_ingest_{t[len('raw_'):]}": _csv_ingest(t)
           for t in RAW_KEYS if t not in ("raw_orders", "raw_order_reviews")},
        "raw_materialize": raw_materialize,
        "raw_materialize_all": raw_materialize_all,
        "reconcile_counts": reconcile,
        "reconcile_changed": changed_contents,
        "load_losses": damaged_losses,
        "load_reconcile": damaged_reconcile,
        "load_widened": widened_items,
        "profile_shape": lambda s, d: P.profile_shape(_raw(s, d)),
        "profile_dtypes": lambda s, d: P.profile_dtypes(_raw(s, d)),
        "profile_nulls": lambda s, d: P.profile_nulls(_raw(s, d)),
        "profile_duplicates": lambda s, d: P.profile_duplicates(_raw(s, d)),
        "profile_sample": lambda s, d: P.profile_sample(_raw(s, d)["raw_orders"],
                                                        RAW_KEYS["raw_orders"]),
        **{f"profile_sample_{t[len('raw_'):]}": _sample(t)
           for t in RAW_KEYS if t != "raw_orders"},
        "view_registry": lambda s, d: view_registry(model_for(s, d)),
        "view_names": view_names_query,
        "view_catalog": catalog,
        "mart_export": mart_export,
        "mart_export_all": mart_export_all,
        "export_manifest": export_manifest,
        # File sizes depend on the Parquet encoder: no SQL twin (rows-only check).
        "export_sizes": export_sizes_query,
        "mart_load": mart_load,
    }


assert set(RAW_FILES) == set(RAW_KEYS)
