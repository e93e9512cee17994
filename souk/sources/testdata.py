"""Adapter: the driver's TPC-H-like tables in the nine raw marketplace shapes.

The marketplace CSVs are not part of the test data, so the raw tables are
derived from the given Parquet tables with Spark (joins, grouping,
projections); the work therefore grows with the input. The mapping puts
every semantic corner case of the cleaning layer into the data: NULL and
blank comment text, orders without delivery, untranslated and missing
categories, installments of 0, a placeholder payment type, several payments
and reviews per order, reviews without order, prices below a cent, missing zip
prefixes, and ties in the most frequent spelling of a zip prefix.

Identifiers stay the driver's integer keys (joins on longs are cheaper than
on strings); dates are rendered as text and parsed again by the cleaning
layer, as in the real raw tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.session import session_key

# How the driver's order status letters map to marketplace
# statuses, and which priority plays the placeholder payment type.
STATUS_MAP = (("F", "delivered"), ("O", "shipped"), ("P", "canceled"))
PLACEHOLDER_PAYMENT_TYPE = "4-NOT SPECIFIED"


def _text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of a TIMESTAMP_NTZ (fraction dropped).

    Casting NTZ to string involves no time zone, unlike date_format.
    """
    return F.substring(ts.cast("string"), 1, 19)


# One scan relation per (session, file): resolving a Parquet source lists the
# files and reads a footer on the driver, which is worth doing once. The
# DataFrame holds no data, only the scan, so sharing it is safe.
_SCANS: dict[tuple, DataFrame] = {}


class DriverTables(Mapping):
    """Lazy raw tables derived from ``{sf_dir}/{table}.parquet``.

    Behaves as a read-only mapping ``raw table name -> DataFrame``; a raw
    table (and the driver tables it reads) is only resolved when asked for.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        key = (session_key(self.spark), path)
        if key not in _SCANS:
            _SCANS[key] = self.spark.read.parquet(path)
        return _SCANS[key]

    # -- Mapping protocol ----------------------------------------------------
    def __getitem__(self, name: str) -> DataFrame:
        from souk.schemas import RAW_TABLES
        if name not in RAW_TABLES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self) -> Iterator[str]:
        from souk.schemas import RAW_TABLES
        return iter(RAW_TABLES)

    def __len__(self) -> int:
        from souk.schemas import RAW_TABLES
        return len(RAW_TABLES)

    # -- raw shapes ---------------------------------------------------------

    @cached_property
    def raw_orders(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                        "o_orderdate")
        ships = (self.table("lineitem")
                 .groupBy(F.col("l_orderkey").alias("o_orderkey"))
                 .agg(F.min("l_shipdate").alias("_first_ship"),
                      F.max("l_shipdate").alias("_last_ship")))
        j = o.join(ships, "o_orderkey", "left")
        status = None
        for code, name in STATUS_MAP:
            cond = F.col("o_orderstatus") == F.lit(code)
            status = F.when(cond, F.lit(name)) if status is None else status.when(cond, F.lit(name))
        hours = F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
        delivered = F.when(F.col("o_orderstatus") != F.lit("O"), F.col("_last_ship") + hours)
        return j.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("order_status"),
            _text(F.col("o_orderdate")).alias("order_purchase_timestamp"),
            _text(F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("order_approved_at"),
            _text(F.col("_first_ship")).alias("order_delivered_carrier_date"),
            _text(delivered).alias("order_delivered_customer_date"),
            _text(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
            .alias("order_estimated_delivery_date"),
        )

    @cached_property
    def raw_order_items(self) -> DataFrame:
        li = self.table("lineitem")
        # freight = price x tax rounded half away from zero to cents, in exact
        # integer arithmetic (price in cents x tax in hundredths = 1e-4 units).
        units = (F.rint(F.col("l_extendedprice") * 100).cast("long")
                 * F.rint(F.col("l_tax") * 100).cast("long"))
        freight_cents = F.when(units >= 0, F.floor((units + 50) / 100)).otherwise(
            -F.floor((-units + 50) / 100))
        freight = freight_cents.cast("double") / F.lit(100.0)
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").cast("long").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            _text(F.col("l_shipdate")).alias("shipping_limit_date"),
            # every other line carries half a cent
            (F.col("l_extendedprice") + (F.col("l_linenumber") % 2) * F.lit(0.005)).alias("price"),
            freight.alias("freight_value"),
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        p = self.table("part")
        price = F.col("p_retailprice")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_size") != F.lit(1), F.col("p_name")).alias("product_category_name"),
            F.length("p_name").cast("double").alias("product_name_lenght"),
            F.length("p_type").cast("double").alias("product_description_lenght"),
            (F.col("p_size") % 5).cast("double").alias("product_photos_qty"),
            F.col("p_size").cast("double").alias("product_weight_g"),
            F.floor(price / 100).cast("double").alias("product_length_cm"),
            F.floor(price / 200).cast("double").alias("product_height_cm"),
            F.floor(price / 300).cast("double").alias("product_width_cm"),
        )

    @cached_property
    def raw_category_translation(self) -> DataFrame:
        names = (self.table("part").select("p_name")
                 .where(~F.col("p_name").like("small %")).distinct())
        return names.select(
            F.col("p_name").alias("product_category_name"),
            F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
            .alias("product_category_name_english"))

    @cached_property
    def raw_customers(self) -> DataFrame:
        c = self.table("customer")
        n = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return c.join(n, "c_nationkey", "left").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            F.col("c_nationkey").cast("long").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )

    @cached_property
    def raw_sellers(self) -> DataFrame:
        s = self.table("supplier")
        n = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        return s.join(n, "s_nationkey", "left").select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").cast("long").alias("seller_zip_code_prefix"),
            F.col("s_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )

    @cached_property
    def raw_order_payments(self) -> DataFrame:
        # one to three payments per order, all but the first by voucher
        o = self.table("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.explode(
            F.sequence(F.lit(1).cast("long"), 1 + F.col("o_orderkey") % 3)).alias("_seq"))
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("_seq").alias("payment_sequential"),
            F.when(F.col("_seq") == 1, F.col("o_orderpriority")).otherwise(F.lit("9-VOUCHER"))
            .alias("payment_type"),
            ((F.col("o_orderkey") + F.col("_seq") - 1) % 13).alias("payment_installments"),
            F.col("o_totalprice").alias("payment_value"),
        )

    @cached_property
    def raw_order_reviews(self) -> DataFrame:
        e = self.table("events")
        et = F.col("event_type")
        score = F.lit(1) + F.least(F.lit(4), F.floor(F.col("value") / 5).cast("int"))
        title = (F.when(et == F.lit("view"), F.lit(None).cast("string"))
                 .when(et == F.lit("error"), F.lit("   ")).otherwise(et))
        message = (F.when(et == F.lit("signup"), F.lit(None).cast("string"))
                   .when(et == F.lit("click"), F.lit("")).otherwise(F.col("props")))
        return e.select(
            F.col("event_id").alias("review_id"),
            # up to three reviews per order; some name no order
            F.when(F.col("event_id") % 50 != 0, F.col("event_id") - F.col("event_id") % 3)
            .alias("order_id"),
            score.cast("long").alias("review_score"),
            title.alias("review_comment_title"),
            message.alias("review_comment_message"),
            _text(F.col("ts")).alias("review_creation_date"),
            _text(F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("review_answer_timestamp"),
        )

    @cached_property
    def raw_geolocation(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("geolocation_zip_code_prefix"),
            F.col("value").alias("geolocation_lat"),
            (-F.col("value")).alias("geolocation_lng"),
            F.col("event_type").alias("geolocation_city"),
            F.substring("event_type", 1, 1).alias("geolocation_state"),
        )

    def raw(self) -> Mapping[str, DataFrame]:
        return self


_ADAPTERS: dict[tuple, DriverTables] = {}


def driver_tables(spark: SparkSession, sf_dir: str) -> DriverTables:
    """The adapter for a folder, built once per session.

    Its raw DataFrames are plans only (no data); queries derive fresh
    DataFrames from them, so nothing executed is ever shared.
    """
    key = (session_key(spark), sf_dir.rstrip("/"))
    if key not in _ADAPTERS:
        _ADAPTERS[key] = DriverTables(spark, sf_dir)
    return _ADAPTERS[key]
