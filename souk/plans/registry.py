"""View DAG of the marketplace model (S5) and the view catalog.

``Marketplace`` turns the nine raw tables into the eight cleaning views and
twelve marts, each a lazy DataFrame built from the DataFrames it depends
on. ``register_views`` publishes them as temp views in dependency order so
that SQL users can query them by name; ``view_catalog`` lists them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import buckets as B
from souk.operators import clean, logistics, reviews, sales
from souk.sources.marts import EXPORTED_MARTS


@dataclass(frozen=True)
class Params:
    """Every filter value and threshold of the model, with the defaults."""
    excluded_statuses: Sequence[str] = B.EXCLUDED_STATUSES
    excluded_payment_types: Sequence[str] = B.EXCLUDED_PAYMENT_TYPES
    min_items_freight: int = B.MIN_ITEMS_FREIGHT
    min_orders_route: int = B.MIN_ORDERS_ROUTE
    min_reviews_category: int = B.MIN_REVIEWS_CATEGORY
    min_reviews_payment: int = B.MIN_REVIEWS_PAYMENT


@dataclass(frozen=True)
class ViewSpec:
    name: str
    layer: str          # "clean", "helper", "sales", "logistics", "reviews"
    exported: bool
    depends_on: tuple[str, ...] = field(default=())


# The twenty views in build order, their layer and inputs.
VIEW_SPECS: tuple[ViewSpec, ...] = (
    ViewSpec("clean_orders", "clean", False, ("raw_orders",)),
    ViewSpec("clean_products", "clean", False, ("raw_products", "raw_category_translation")),
    ViewSpec("_geo_avg", "helper", False, ("raw_geolocation",)),
    ViewSpec("_geo_mode", "helper", False, ("raw_geolocation",)),
    ViewSpec("clean_geolocation", "clean", False, ("_geo_avg", "_geo_mode")),
    ViewSpec("clean_order_items", "clean", False, ("raw_order_items",)),
    ViewSpec("clean_payments", "clean", False, ("raw_order_payments",)),
    ViewSpec("clean_reviews", "clean", False, ("raw_order_reviews",)),
    ViewSpec("sales_monthly_trend", "sales", True, ("clean_orders", "clean_order_items")),
    ViewSpec("sales_by_category", "sales", True,
             ("clean_order_items", "clean_products", "clean_orders")),
    ViewSpec("sales_by_state", "sales", True,
             ("clean_orders", "clean_order_items", "raw_customers")),
    ViewSpec("sales_payment_breakdown", "sales", True, ("clean_payments",)),
    ViewSpec("logistics_delivery_by_state", "logistics", True, ("clean_orders", "raw_customers")),
    ViewSpec("logistics_delay_distribution", "logistics", True, ("clean_orders",)),
    ViewSpec("logistics_freight_ratio", "logistics", True,
             ("clean_order_items", "clean_products")),
    ViewSpec("logistics_route_performance", "logistics", True,
             ("clean_orders", "clean_order_items", "raw_sellers", "raw_customers")),
    ViewSpec("reviews_score_distribution", "reviews", True, ("clean_reviews",)),
    ViewSpec("reviews_score_by_delay", "reviews", True, ("clean_reviews", "clean_orders")),
    ViewSpec("reviews_score_by_category", "reviews", True,
             ("clean_reviews", "clean_order_items", "clean_products")),
    ViewSpec("reviews_score_by_payment", "reviews", True, ("clean_reviews", "clean_payments")),
)
VIEW_NAMES = tuple(v.name for v in VIEW_SPECS)
assert tuple(v.name for v in VIEW_SPECS if v.exported) == EXPORTED_MARTS


class Marketplace:
    """Cleaning views and marts over nine raw DataFrames (all lazy)."""

    def __init__(self, raw: Mapping[str, DataFrame], params: Params | None = None):
        self.raw = raw  # may be lazy: a table is resolved on first use
        self.p = params or Params()

    # -- cleaning layer -----------------------------------------------------
    @cached_property
    def clean_orders(self) -> DataFrame:
        return clean.clean_orders(self.raw["raw_orders"])

    @cached_property
    def clean_products(self) -> DataFrame:
        return clean.clean_products(self.raw["raw_products"], self.raw["raw_category_translation"])

    @cached_property
    def _geo_avg(self) -> DataFrame:
        return clean.geo_avg(self.raw["raw_geolocation"])

    @cached_property
    def _geo_mode(self) -> DataFrame:
        return clean.geo_mode(self.raw["raw_geolocation"])

    @cached_property
    def clean_geolocation(self) -> DataFrame:
        return clean.clean_geolocation(self.raw["raw_geolocation"])

    @cached_property
    def clean_order_items(self) -> DataFrame:
        return clean.clean_order_items(self.raw["raw_order_items"])

    @cached_property
    def clean_payments(self) -> DataFrame:
        return clean.clean_payments(self.raw["raw_order_payments"], self.p.excluded_payment_types)

    @cached_property
    def clean_reviews(self) -> DataFrame:
        return clean.clean_reviews(self.raw["raw_order_reviews"])

    @property
    def customers(self) -> DataFrame:
        return self.raw["raw_customers"]

    @property
    def sellers(self) -> DataFrame:
        return self.raw["raw_sellers"]

    # -- marts ----------------------------------------------------------------
    @cached_property
    def sales_monthly_trend(self) -> DataFrame:
        return sales.sales_monthly_trend(self.clean_orders, self.clean_order_items,
                                         self.p.excluded_statuses)

    @cached_property
    def sales_by_category(self) -> DataFrame:
        return sales.sales_by_category(self.clean_orders, self.clean_order_items,
                                       self.clean_products, self.p.excluded_statuses)

    @cached_property
    def sales_by_state(self) -> DataFrame:
        return sales.sales_by_state(self.clean_orders, self.clean_order_items, self.customers,
                                    self.p.excluded_statuses)

    @cached_property
    def sales_payment_breakdown(self) -> DataFrame:
        return sales.sales_payment_breakdown(self.clean_payments)

    @cached_property
    def logistics_delivery_by_state(self) -> DataFrame:
        return logistics.logistics_delivery_by_state(self.clean_orders, self.customers)

    @cached_property
    def logistics_delay_distribution(self) -> DataFrame:
        return logistics.logistics_delay_distribution(self.clean_orders)

    @cached_property
    def logistics_freight_ratio(self) -> DataFrame:
        return logistics.logistics_freight_ratio(self.clean_order_items, self.clean_products,
                                                 self.p.min_items_freight)

    @cached_property
    def logistics_route_performance(self) -> DataFrame:
        return logistics.logistics_route_performance(
            self.clean_orders, self.clean_order_items, self.sellers, self.customers,
            self.p.min_orders_route)

    @cached_property
    def reviews_score_distribution(self) -> DataFrame:
        return reviews.reviews_score_distribution(self.clean_reviews)

    @cached_property
    def reviews_score_by_delay(self) -> DataFrame:
        return reviews.reviews_score_by_delay(self.clean_reviews, self.clean_orders)

    @cached_property
    def reviews_score_by_category(self) -> DataFrame:
        return reviews.reviews_score_by_category(self.clean_reviews, self.clean_order_items,
                                                 self.clean_products, self.p.min_reviews_category)

    @cached_property
    def reviews_score_by_payment(self) -> DataFrame:
        return reviews.reviews_score_by_payment(self.clean_reviews, self.clean_payments,
                                                self.p.min_reviews_payment)

    # -- access by name -------------------------------------------------------
    def view(self, name: str) -> DataFrame:
        if name not in VIEW_NAMES:
            raise ValueError(f"Unknown view '{name}'")
        return getattr(self, name)

    def marts(self) -> dict[str, DataFrame]:
        return {n: self.view(n) for n in EXPORTED_MARTS}


def register_views(model: Marketplace, prefix: str = "") -> list[str]:
    """Publish raw tables and all twenty views as temp views, in order.

    Re-registering replaces existing views (idempotent rebuild). Returns
    the registered view names in build order.
    """
    for name, df in model.raw.items():
        df.createOrReplaceTempView(prefix + name)
    for spec in VIEW_SPECS:
        model.view(spec.name).createOrReplaceTempView(prefix + spec.name)
    return [prefix + s.name for s in VIEW_SPECS]


def view_registry(model: Marketplace) -> DataFrame:
    """S5 report: build position, name, layer, exported flag and row count of
    every view (one count aggregate per view, unioned into one job)."""
    parts = []
    for pos, spec in enumerate(VIEW_SPECS, start=1):
        row = model.view(spec.name).agg(F.count(F.lit(1)).alias("num_rows"))
        cols = [F.lit(pos).alias("position"), F.lit(spec.name).alias("view_name"),
                F.lit(spec.layer).alias("layer"), F.lit(spec.exported).alias("exported")]
        parts.append(row.select(*cols, "num_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def view_names(spark: SparkSession, names: Sequence[str] = VIEW_NAMES) -> DataFrame:
    """Names of the registered views, from the catalog alone (no view is run)."""
    present = spark.sql("SHOW VIEWS").where("isTemporary").select(F.col("viewName").alias("view_name"))
    return present.where(F.col("view_name").isin(*names)).orderBy("view_name")


def view_catalog(spark: SparkSession, names: Sequence[str] = VIEW_NAMES) -> DataFrame:
    """The registered views that exist in the session catalog, sorted by
    name, each with its row count read through the catalog."""
    present = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    parts = [spark.table(n).agg(F.count(F.lit(1)).alias("num_rows"))
             .select(F.lit(n).alias("view_name"), "num_rows")
             for n in sorted(names) if n in present]
    if not parts:
        return spark.createDataFrame([], "view_name string, num_rows bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("view_name")
