"""Cleaning layer: typed, flagged versions of the raw tables.

Each builder takes raw DataFrames and returns a lazy DataFrame; nothing is
computed until a mart or an export asks for it, and Catalyst prunes the
columns and pushes the filters of whichever consumer does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import buckets as B
from souk.functions.exprs import (
    delay_days, duration_days, exact_mean, fixed_mean, fixed_sums, has_text, on_time_flag, parse_ts,
)


def clean_orders(raw_orders: DataFrame) -> DataFrame:
    """Typed timestamps plus delay, duration and on-time flag. All rows kept.

    ``delivery_delay_days`` (truncated days) and ``is_on_time`` (exact
    instants) are independent: an order up to 24 h late has delay 0 and
    is_on_time 0.
    """
    # Parse each text once; the derived columns reuse the parsed values
    # (Catalyst keeps the two projections apart rather than parse twice).
    parsed = raw_orders.select(
        "order_id",
        "customer_id",
        "order_status",
        parse_ts("order_purchase_timestamp").alias("order_purchase_ts"),
        parse_ts("order_approved_at").alias("order_approved_ts"),
        parse_ts("order_delivered_carrier_date").alias("order_delivered_carrier_ts"),
        parse_ts("order_delivered_customer_date").alias("order_delivered_customer_ts"),
        parse_ts("order_estimated_delivery_date").alias("order_estimated_delivery_ts"),
        F.col("order_delivered_customer_date").isNotNull().alias("_has_delivery"),
    )
    d, e, p = ("order_delivered_customer_ts", "order_estimated_delivery_ts", "order_purchase_ts")
    return parsed.select(
        "order_id", "customer_id", "order_status", p, "order_approved_ts",
        "order_delivered_carrier_ts", d, e,
        delay_days("_has_delivery", d, e).alias("delivery_delay_days"),
        duration_days("_has_delivery", d, p).alias("delivery_duration_days"),
        on_time_flag("_has_delivery", d, e).alias("is_on_time"),
    )


def clean_products(raw_products: DataFrame, raw_category_translation: DataFrame) -> DataFrame:
    """Products with English category (fallback: original name, then 'unknown').

    The translation table is a lookup with one row per category; Spark
    broadcasts it when its measured size is under the broadcast threshold
    and falls back to a shuffle join otherwise.
    """
    t = raw_category_translation.select(
        F.col("product_category_name").alias("_t_name"),
        F.col("product_category_name_english").alias("_t_english"))
    p = raw_products
    j = p.join(t, p["product_category_name"] == t["_t_name"], "left")
    return j.select(
        "product_id",
        F.coalesce(F.col("_t_english"), F.col("product_category_name"), F.lit("unknown"))
        .alias("category_english"),
        F.coalesce(F.col("product_category_name"), F.lit("unknown")).alias("category_original"),
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    )


def geo_avg(raw_geolocation: DataFrame) -> DataFrame:
    """Mean latitude and longitude per zip prefix (duplicates included).

    Partial aggregation runs map-side, so a zip prefix holding a large
    share of all rows still ships one partial row per task.
    """
    return (raw_geolocation
            .groupBy(F.col("geolocation_zip_code_prefix").alias("zip_code_prefix"))
            .agg(exact_mean("geolocation_lat").alias("lat"),
                 exact_mean("geolocation_lng").alias("lng")))


def _spelling_counts(raw_geolocation: DataFrame, with_sums: bool = False) -> DataFrame:
    """One row per (zip, city, state): its row count, and optionally the exact
    coordinate sums, so the mean can be finished from these rows too."""
    aggs = [F.count(F.lit(1)).alias("cnt")]
    if with_sums:
        for c, name in (("geolocation_lat", "lat"), ("geolocation_lng", "lng")):
            aggs += [x.alias(f"{part}_{name}") for part, x in zip(("_s", "_x", "_n"), fixed_sums(c))]
    return (raw_geolocation
            .groupBy(F.col("geolocation_zip_code_prefix").alias("zip_code_prefix"),
                     F.col("geolocation_city").alias("city"),
                     F.col("geolocation_state").alias("state"))
            .agg(*aggs))


def _mode_of(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("zip_code_prefix").orderBy(
        F.col("cnt").desc(), F.col("city").asc_nulls_first(), F.col("state").asc_nulls_first())
    return (counts.withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") == 1)
            .select("zip_code_prefix", "city", "state"))


def geo_mode(raw_geolocation: DataFrame) -> DataFrame:
    """C4: most frequent (city, state) spelling per zip prefix.

    Ties on the count go to the smallest (city, state), so the result is
    deterministic. The window runs over the grouped rows (one per distinct
    spelling), and Spark inserts a partial per-zip top-1 limit before the
    shuffle, so a hot zip prefix is never gathered into one task.
    """
    return _mode_of(_spelling_counts(raw_geolocation))


def clean_geolocation(raw_geolocation: DataFrame) -> DataFrame:
    """One representative point and spelling per zip prefix.

    Mean and modal spelling come from one (zip, city, state) aggregate that
    also carries exact coordinate sums, finished by one aggregate per zip:
    the table is scanned once and only grouped rows (one per spelling) reach
    the second shuffle. Adding the per-spelling sums keeps the mean exact.
    Rows without a zip prefix have no representative and give no row.
    """
    counts = _spelling_counts(raw_geolocation, with_sums=True)
    # Modal spelling: the smallest (-count, city, state), i.e. the highest
    # count, ties to the smallest (city, state) -- the rule of geo_mode.
    mode = F.min_by(F.struct("city", "state"),
                    F.struct((-F.col("cnt")).alias("c"), "city", "state"))
    return (counts.where(F.col("zip_code_prefix").isNotNull()).groupBy("zip_code_prefix")
            .agg(*[fixed_mean(*(F.sum(f"{part}_{c}") for part in ("_s", "_x", "_n"))).alias(c)
                   for c in ("lat", "lng")],
                 mode.alias("_mode"))
            .select("zip_code_prefix", "lat", "lng",
                    F.col("_mode.city").alias("city"), F.col("_mode.state").alias("state")))


def clean_order_items(raw_order_items: DataFrame) -> DataFrame:
    """Typed shipping limit and item total (price + freight)."""
    return raw_order_items.select(
        "order_id", "order_item_id", "product_id", "seller_id",
        parse_ts("shipping_limit_date").alias("shipping_limit_ts"),
        "price", "freight_value",
        (F.col("price") + F.col("freight_value")).alias("item_total_value"),
    )


def clean_payments(raw_order_payments: DataFrame,
                   excluded_types: Sequence[str] = B.EXCLUDED_PAYMENT_TYPES) -> DataFrame:
    """Payments without the placeholder type. A NULL type is dropped too
    (``!=`` is unknown for NULL)."""
    return (raw_order_payments
            .where(~F.col("payment_type").isin(*excluded_types))
            .select("order_id", "payment_sequential", "payment_type",
                    "payment_installments", "payment_value"))


def clean_reviews(raw_order_reviews: DataFrame) -> DataFrame:
    """Comment flags and typed dates."""
    return raw_order_reviews.select(
        "review_id", "order_id", "review_score",
        has_text("review_comment_title").alias("has_title"),
        has_text("review_comment_message").alias("has_message"),
        parse_ts("review_creation_date").alias("review_creation_ts"),
        parse_ts("review_answer_timestamp").alias("review_answer_ts"),
    )
