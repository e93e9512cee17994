"""Logistics marts (M5-M8).

These marts ignore the order status: M5 and M8 keep orders with a parsed
delivery timestamp, M6 keeps orders with a delay. Mean durations are
computed from exact sums of whole seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions import buckets as B
from souk.functions.exprs import (
    SECONDS_PER_DAY, Bucket, bucket_label, bucket_order, mean_days_from_seconds, money_units, pct,
    rounded_fraction, rounded_mean, seconds_between,
)
from souk.operators.hot import combine_hot


def _delivered(orders: DataFrame) -> DataFrame:
    return (orders.where(F.col("order_delivered_customer_ts").isNotNull())
            .withColumn("_dur_s", seconds_between("order_purchase_ts",
                                                  "order_delivered_customer_ts")))


def logistics_delivery_by_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """M5: delivered orders, mean duration, mean delay and on-time % per state."""
    o = _delivered(orders).select("customer_id", "_dur_s", "delivery_delay_days", "is_on_time")
    c = customers.select("customer_id", "customer_state")
    return (o.join(c, "customer_id")
            .groupBy("customer_state")
            .agg(F.count(F.lit(1)).alias("num_delivered_orders"),
                 F.round(mean_days_from_seconds("_dur_s"), 1).alias("avg_delivery_days"),
                 F.round(F.avg(F.col("delivery_delay_days").cast("double")), 1)
                 .alias("avg_delay_days"),
                 F.round(pct(F.sum("is_on_time"), F.count(F.lit(1))), 1).alias("pct_on_time"))
            .orderBy(F.col("pct_on_time").asc_nulls_first(),
                     F.col("customer_state").asc_nulls_first()))


def logistics_delay_distribution(orders: DataFrame,
                                 buckets: Sequence[Bucket] = B.DELAY_BUCKETS_7) -> DataFrame:
    """M6: orders per delay bucket (delivered orders with a known delay)."""
    o = (orders.where(F.col("delivery_delay_days").isNotNull())
         .select(bucket_order("delivery_delay_days", buckets).alias("sort_order")))
    return (o.groupBy("sort_order").agg(F.count(F.lit(1)).alias("num_orders"))
            .select(bucket_label("sort_order", buckets).alias("delay_bucket"),
                    "sort_order", "num_orders")
            .orderBy("sort_order"))


def logistics_freight_ratio(items: DataFrame, products: DataFrame,
                            min_items: int = B.MIN_ITEMS_FREIGHT) -> DataFrame:
    """M7: freight as % of price per category (ratio of means), all statuses.

    Categories with fewer than ``min_items`` items are dropped; a zero mean
    price gives a NULL ratio.
    """
    j = (items.select("product_id", "price", "freight_value")
         .join(products.select("product_id", "category_english"), "product_id"))
    return freight_ratio(j.groupBy("category_english").agg(
        F.count(F.lit(1)).alias("num_items"),
        F.sum(money_units("price")).alias("_p"), F.count("price").alias("_np"),
        F.sum(money_units("freight_value")).alias("_f"), F.count("freight_value").alias("_nf")), min_items)


def freight_ratio(agg: DataFrame, min_items: int) -> DataFrame:
    """M7 from each category's items, and count and sum of its prices and freights."""
    # (f / nf) / (p / np) as one fraction of whole numbers
    over = F.col("_f") * F.col("_np") * F.lit(100)
    return (agg.where(F.col("num_items") >= min_items)
            .select("category_english", "num_items",
                    rounded_mean(F.col("_p"), F.col("_np")).alias("avg_price"),
                    rounded_mean(F.col("_f"), F.col("_nf")).alias("avg_freight"),
                    rounded_fraction(over, F.col("_p") * F.col("_nf"), 1)
                    .alias("freight_pct_of_price"))
            .orderBy(F.col("freight_pct_of_price").desc_nulls_last(),
                     F.col("category_english").asc_nulls_first()))


def logistics_route_performance(orders: DataFrame, items: DataFrame, sellers: DataFrame,
                                customers: DataFrame,
                                min_orders: int = B.MIN_ORDERS_ROUTE) -> DataFrame:
    """M8: seller-state -> customer-state delivery time and on-time %.

    The grain is the order *item*: ``num_orders`` counts items of delivered
    orders on the route. Routes below ``min_orders`` are dropped.
    """
    # Look up each state at its own grain (customer per order, seller per item);
    # items of hot orders are combined per order and seller state before the join.
    s = sellers.select("seller_id", "seller_state")
    sent = combine_hot(items.select("order_id", "seller_id"), "order_id", ["seller_state"], ["_items"],
                       lambda rows: rows.join(s, "seller_id").withColumn("_items", F.lit(1).cast("long")))
    return route_performance(orders, sent, customers, min_orders)


def route_performance(orders: DataFrame, sent: DataFrame, customers: DataFrame, min_orders: int) -> DataFrame:
    """M8 from weighted rows of order and seller state."""
    o = _delivered(orders).select("order_id", "customer_id", "_dur_s", "is_on_time")
    c = customers.select("customer_id", "customer_state")
    w = F.col("_items")
    timed = F.sum(F.when(F.col("_dur_s").isNotNull(), w))
    agg = (o.join(c, "customer_id").join(sent, "order_id")
           .groupBy("seller_state", "customer_state").agg(
               F.sum(w).alias("num_orders"),
               F.round(F.sum(F.col("_dur_s") * w).cast("double") / F.nullif(timed, F.lit(0))
                       / F.lit(float(SECONDS_PER_DAY)), 1).alias("avg_delivery_days"),
               F.round(pct(F.sum(F.col("is_on_time") * w), F.sum(w)), 1).alias("pct_on_time")))
    return (agg.where(F.col("num_orders") >= min_orders)
            .orderBy(F.col("avg_delivery_days").desc_nulls_last(),
                     F.col("seller_state").asc_nulls_first(),
                     F.col("customer_state").asc_nulls_first()))
