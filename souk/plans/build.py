"""Batch jobs of the model: CSV ingest, raw materialization, mart export.

These are the entry points a scheduled rebuild runs, each a full
recompute whose tables replace the last ones together, or not at all:

* ``ingest_raw``: nine CSVs -> raw Parquet tables (S1, S2) + reconciliation (S3);
* ``build_and_export``: raw tables -> twenty views -> twelve Parquet marts
  (S5, S7) + manifest (S8).

All paths may be on a shared file system (``hdfs://``, ``s3a://``, ...);
nothing is written to a machine-local folder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from souk.operators import facts as item_facts
from souk.operators import logistics, reviews, sales
from souk.operators.profile import reconcile_loads
from souk.plans.registry import Marketplace, Params
from souk.schemas import RAW_FILES, RAW_SCHEMAS
from souk.sources.csv_source import LoadAccount, open_csv, widened, write_csv
from souk.sources.marts import EXPORTED_MARTS, export_manifest, export_marts
from souk.sources.publish import publish, read_all_published


def stage_csv(raw: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write raw tables as CSV folders named like the source files."""
    base = folder.rstrip("/")
    return {t: write_csv(df, f"{base}/{RAW_FILES[t]}") for t, df in raw.items()}


def load_raw(spark: SparkSession, csv_paths: Mapping[str, str], raw_folder: str, widen: bool = False
             ) -> tuple[dict[str, DataFrame], dict[str, LoadAccount]]:
    """Load each CSV with its declared schema and publish all as raw tables.

    Each file is read once: its rows are counted, hashed and typed in the pass that
    writes them. With ``widen`` a table whose whole-number columns hold other numbers
    (``3.5``) is loaded and published again with doubles there. Returns the stored
    tables and what each load read and lost.
    """
    accounts: dict[str, LoadAccount] = {}
    live = None
    schemas = {t: RAW_SCHEMAS[t] for t in csv_paths}
    while schemas:
        opened = {t: open_csv(spark, csv_paths[t], t, schema) for t, schema in schemas.items()}
        live = publish({t: df for t, (df, _) in opened.items()}, raw_folder)
        accounts |= {t: account() for t, (_, account) in opened.items()}
        schemas = {t: widened(schemas[t], accounts[t]) for t in schemas
                   if widen and accounts[t].not_whole and widened(schemas[t], accounts[t]) != schemas[t]}
    return read_all_published(spark, raw_folder, list(csv_paths), live), accounts


def ingest_raw(spark: SparkSession, csv_paths: Mapping[str, str], raw_folder: str, widen: bool = False
               ) -> tuple[dict[str, DataFrame], DataFrame]:
    """``load_raw`` with the comparison of sources and stored tables."""
    stored, accounts = load_raw(spark, csv_paths, raw_folder, widen)
    return stored, reconcile_loads(accounts, stored)


# Inputs that several marts read, with the columns they use, and who reads them. The
# items are not among them: the marts that read items share the item facts.
STAGED_INPUTS = {
    "clean_orders": (("order_id", "customer_id", "order_status", "order_purchase_ts",
                      "order_delivered_customer_ts", "delivery_delay_days", "is_on_time"),
                     {"sales_monthly_trend", "sales_by_category", "sales_by_state", "logistics_delivery_by_state",
                      "logistics_delay_distribution", "logistics_route_performance", "reviews_score_by_delay"}),
    "clean_payments": (("order_id", "payment_type", "payment_installments", "payment_value"),
                       {"sales_payment_breakdown", "reviews_score_by_payment"}),
    "clean_reviews": (("order_id", "review_score"),
                      {"reviews_score_distribution", "reviews_score_by_delay", "reviews_score_by_category",
                       "reviews_score_by_payment"}),
    "customers": (("customer_id", "customer_state"),
                  {"sales_by_state", "logistics_delivery_by_state", "logistics_route_performance"}),
}
FACT_MARTS = {"sales_monthly_trend", "sales_by_category", "sales_by_state", "logistics_freight_ratio",
              "logistics_route_performance", "reviews_score_by_category"}


class StagedMarketplace(Marketplace):
    """A model whose shared inputs were written once as Parquet tables.

    The marts start from those tables: the raw tables are read and cleaned once,
    and the items are looked up and added up once (``item_facts``), not once per
    mart. Lineage is cut at the written tables, so a lost executor recomputes from
    them rather than from raw. Inputs that were not staged come from ``raw``.
    """

    def __init__(self, raw: Mapping[str, DataFrame], staged: Mapping[str, DataFrame], params: Params | None = None):
        super().__init__(raw, params)
        self.facts = staged.get("item_facts")
        self._customers = staged.get("customers")
        self.__dict__.update({n: df for n, df in staged.items() if n.startswith("clean_")})
        if self.facts is not None:
            self.__dict__.update(self._fact_marts(self.facts))

    def _fact_marts(self, facts: DataFrame) -> dict[str, DataFrame]:
        p, revenue = self.p, sales.revenue_of_facts(facts)
        return {
            "sales_monthly_trend": sales.monthly_trend(self.clean_orders, revenue, p.excluded_statuses),
            "sales_by_category": sales.by_category(self.clean_orders, item_facts.sold(facts), p.excluded_statuses),
            "sales_by_state": sales.by_state(self.clean_orders, revenue, self.customers, p.excluded_statuses),
            "logistics_freight_ratio": logistics.freight_ratio(item_facts.freight_sums(facts), p.min_items_freight),
            "logistics_route_performance": logistics.route_performance(
                self.clean_orders, item_facts.sent(facts), self.customers, p.min_orders_route),
            "reviews_score_by_category": reviews.score_by_category(
                self.clean_reviews, item_facts.sold(facts), p.min_reviews_category),
        }

    @property
    def customers(self) -> DataFrame:
        return super().customers if self._customers is None else self._customers


def stage_shared(model: Marketplace, folder: str, names=EXPORTED_MARTS, max_concurrent_jobs: int = 4
                 ) -> StagedMarketplace:
    """Write what several of the requested marts share (used columns only), once.

    An input that a single requested mart reads is left in that mart's own plan.
    """
    wanted = set(names)
    frames = {n: getattr(model, n).select(*columns) for n, (columns, readers) in STAGED_INPUTS.items()
              if len(wanted & readers) > 1}
    if len(wanted & FACT_MARTS) > 1:
        frames["item_facts"] = item_facts.item_facts(model.clean_order_items, model.clean_products, model.sellers)
    live = publish(frames, folder, max_concurrent_jobs=max_concurrent_jobs)
    spark = model.clean_orders.sparkSession
    return StagedMarketplace(model.raw, read_all_published(spark, folder, list(frames), live), model.p)


def build_and_export(raw: Mapping[str, DataFrame], out_folder: str,
                     params: Params | None = None, names=EXPORTED_MARTS,
                     staging_folder: str | None = None,
                     max_concurrent_jobs: int = 4) -> DataFrame:
    """Build the marts from raw tables, export them, return the manifest.

    With ``staging_folder`` (a shared location), what the marts have in common is
    written there first and the marts are built from it.
    """
    model = Marketplace(raw, params)
    spark = model.clean_orders.sparkSession
    if staging_folder:
        model = stage_shared(model, staging_folder, names, max_concurrent_jobs)
    live = export_marts(model.marts(), out_folder, names, max_concurrent_jobs)
    return export_manifest(spark, out_folder, names, live)
