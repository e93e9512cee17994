"""Declared schemas of the nine raw marketplace tables.

Declaring the schema avoids an inference pass over every CSV file and keeps
types stable between files and runs. Identifiers are strings in the source
data; integer-like counts are longs; money, sizes and coordinates doubles.
Dates stay text in the raw layer and are parsed by the cleaning layer.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Table names, source file names and column layouts of the
# marketplace data set (the misspelt "lenght" columns are in the source).
RAW_SCHEMAS: dict[str, T.StructType] = {
    "raw_customers": _st(
        ("customer_id", S), ("customer_unique_id", S),
        ("customer_zip_code_prefix", L), ("customer_city", S), ("customer_state", S)),
    "raw_geolocation": _st(
        ("geolocation_zip_code_prefix", L), ("geolocation_lat", D), ("geolocation_lng", D),
        ("geolocation_city", S), ("geolocation_state", S)),
    "raw_order_items": _st(
        ("order_id", S), ("order_item_id", L), ("product_id", S), ("seller_id", S),
        ("shipping_limit_date", S), ("price", D), ("freight_value", D)),
    "raw_order_payments": _st(
        ("order_id", S), ("payment_sequential", L), ("payment_type", S),
        ("payment_installments", L), ("payment_value", D)),
    "raw_order_reviews": _st(
        ("review_id", S), ("order_id", S), ("review_score", L),
        ("review_comment_title", S), ("review_comment_message", S),
        ("review_creation_date", S), ("review_answer_timestamp", S)),
    "raw_orders": _st(
        ("order_id", S), ("customer_id", S), ("order_status", S),
        ("order_purchase_timestamp", S), ("order_approved_at", S),
        ("order_delivered_carrier_date", S), ("order_delivered_customer_date", S),
        ("order_estimated_delivery_date", S)),
    "raw_products": _st(
        ("product_id", S), ("product_category_name", S),
        ("product_name_lenght", D), ("product_description_lenght", D),
        ("product_photos_qty", D), ("product_weight_g", D), ("product_length_cm", D),
        ("product_height_cm", D), ("product_width_cm", D)),
    "raw_sellers": _st(
        ("seller_id", S), ("seller_zip_code_prefix", L), ("seller_city", S),
        ("seller_state", S)),
    "raw_category_translation": _st(
        ("product_category_name", S), ("product_category_name_english", S)),
}

RAW_FILES: dict[str, str] = {
    "raw_customers": "customers.csv",
    "raw_geolocation": "geolocation.csv",
    "raw_order_items": "order_items.csv",
    "raw_order_payments": "order_payments.csv",
    "raw_order_reviews": "order_reviews.csv",
    "raw_orders": "orders.csv",
    "raw_products": "products.csv",
    "raw_sellers": "sellers.csv",
    "raw_category_translation": "category_translation.csv",
}

# Tables whose quoted text fields may hold line breaks. Only these are read
# with multiLine (which makes a CSV file unsplittable); the rest stay
# splittable so large files are read by many tasks.
MULTILINE_TABLES = frozenset({"raw_order_reviews"})

# The text tokens that the pandas CSV reader turns into a
# missing value by default (empty field included). Spark's CSV reader has a
# single nullValue, so ingestion maps all of these to NULL itself.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Natural row key of each raw table, used for deterministic samples.
RAW_KEYS: dict[str, tuple[str, ...]] = {
    "raw_customers": ("customer_id",),
    "raw_geolocation": ("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
                        "geolocation_city", "geolocation_state"),
    "raw_order_items": ("order_id", "order_item_id", "product_id", "seller_id"),
    "raw_order_payments": ("order_id", "payment_sequential"),
    "raw_order_reviews": ("review_id", "order_id"),
    "raw_orders": ("order_id",),
    "raw_products": ("product_id",),
    "raw_sellers": ("seller_id",),
    "raw_category_translation": ("product_category_name",),
}

RAW_TABLES = tuple(RAW_SCHEMAS)
