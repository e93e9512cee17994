"""Named queries over a folder of driver tables: ``key -> fn(spark, sf_dir)``.

Each query derives the raw marketplace tables from the given Parquet tables
(see :mod:`souk.sources.testdata`), builds the model and returns one lazy
DataFrame. This is the catalog behind ``__spark_entry__.queries()`` and
``bench.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from souk.plans.registry import VIEW_NAMES, Marketplace, Params
from souk.sources.testdata import PLACEHOLDER_PAYMENT_TYPE, driver_tables

Query = Callable[[SparkSession, str], DataFrame]

# Parameters for the driver tables: the placeholder payment type is the
# priority that plays it in the adapter; all thresholds keep their defaults.
TEST_PARAMS = Params(excluded_payment_types=(PLACEHOLDER_PAYMENT_TYPE,))

# Thresholds that make HAVING drop rows on the sf0.01 test tables (the
# defaults drop nothing there); run next to the default variants.
STRICT_PARAMS = replace(TEST_PARAMS, min_items_freight=890, min_reviews_category=591,
                        min_reviews_payment=486)


def model_for(spark: SparkSession, sf_dir: str, params: Params = TEST_PARAMS) -> Marketplace:
    return Marketplace(driver_tables(spark, sf_dir), params)


def _view_query(name: str, params: Params = TEST_PARAMS) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return model_for(spark, sf_dir, params).view(name)
    q.__name__ = name
    return q


def view_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in VIEW_NAMES:
        out[name.lstrip("_")] = _view_query(name)
    out["logistics_freight_ratio_strict"] = _view_query("logistics_freight_ratio", STRICT_PARAMS)
    out["reviews_score_by_category_strict"] = _view_query("reviews_score_by_category",
                                                          STRICT_PARAMS)
    out["reviews_score_by_payment_strict"] = _view_query("reviews_score_by_payment",
                                                         STRICT_PARAMS)
    return out


def all_queries() -> dict[str, Query]:
    from souk.plans.metric_queries import metric_queries
    from souk.plans.source_queries import source_queries
    return {**view_queries(), **metric_queries(), **source_queries()}
