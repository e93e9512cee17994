"""Sales marts (M1-M4).

Revenue is ``price + freight`` per item, summed exactly in millionths.
``num_orders`` is an exact distinct count of order ids.

Plan shape (M1, M3): items are first reduced to one row per order (a
partial aggregation that runs before the shuffle), then joined to the
orders on ``order_id``. The distinct count groups by (key, order_id); that
grouping is already satisfied by the join's hash partitioning on
``order_id``, so it adds no exchange, and only one small per-key partial
aggregate is shuffled at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions import buckets as B
from souk.functions.exprs import from_units, money_sum, money_units, rounded_mean
from souk.operators.hot import combine_hot

# What a row of M2 adds up: items, items with a price, millionths of price and of value.
SOLD_WEIGHTS = ("_items", "_priced", "_price", "_value")


def _placed_orders(orders: DataFrame, excluded_statuses: Sequence[str]) -> DataFrame:
    # NOT IN drops NULL statuses as well (three-valued logic).
    return orders.where(~F.col("order_status").isin(*excluded_statuses))


def _revenue_per_order(items: DataFrame) -> DataFrame:
    return (items.groupBy("order_id")
            .agg(F.sum(money_units("item_total_value")).alias("_rev")))


def revenue_of_facts(facts: DataFrame) -> DataFrame:
    """Revenue per order from the item facts (``souk.operators.facts``)."""
    return facts.groupBy("order_id").agg(F.sum("_value").alias("_rev"))


def _aov_columns(num_orders: str, rev: str) -> list:
    return [
        F.col(num_orders),
        from_units(F.col(rev)).alias("total_revenue"),
        rounded_mean(F.col(rev), F.col(num_orders)).alias("avg_order_value"),
    ]


def sales_monthly_trend(orders: DataFrame, items: DataFrame,
                        excluded_statuses: Sequence[str] = B.EXCLUDED_STATUSES) -> DataFrame:
    """M1: distinct orders, revenue and average order value per purchase month."""
    return monthly_trend(orders, _revenue_per_order(items), excluded_statuses)


def monthly_trend(orders: DataFrame, revenue: DataFrame, excluded_statuses: Sequence[str]) -> DataFrame:
    """M1 from each order's revenue."""
    o = _placed_orders(orders, excluded_statuses).select(
        "order_id",
        # NTZ -> DATE is zone-free; the month of a date cannot move with DST.
        F.date_format(F.to_date("order_purchase_ts"), "yyyy-MM").alias("year_month"))
    j = o.join(revenue, "order_id")
    agg = j.groupBy("year_month").agg(
        F.countDistinct("order_id").alias("num_orders"), F.sum("_rev").alias("_rev"))
    return (agg.select("year_month", *_aov_columns("num_orders", "_rev"))
            .orderBy(F.col("year_month").asc_nulls_first()))


def sales_by_category(orders: DataFrame, items: DataFrame, products: DataFrame,
                      excluded_statuses: Sequence[str] = B.EXCLUDED_STATUSES) -> DataFrame:
    """M2: orders, items sold, revenue and mean item price per category.

    Counts and sums are over (item x qualifying order row) pairs. Items of hot
    orders are combined per order and category before the order join, all others
    go straight to it; its partitioning also serves the grouping by order and
    category, whose rows are the distinct orders. Rows are weighted by the number
    of order rows, so no pair rows are emitted even if an order id repeats.
    """
    i = items.select("order_id", "product_id", "price", "item_total_value")
    p = products.select("product_id", "category_english")
    sold = combine_hot(i, "order_id", ["category_english"], SOLD_WEIGHTS, lambda rows: rows.join(p, "product_id").select(
        "order_id", "category_english", F.lit(1).cast("long").alias("_items"),
        F.col("price").isNotNull().cast("long").alias("_priced"),
        money_units("price").alias("_price"), money_units("item_total_value").alias("_value")))
    return by_category(orders, sold, excluded_statuses)


def by_category(orders: DataFrame, sold: DataFrame, excluded_statuses: Sequence[str]) -> DataFrame:
    """M2 from weighted rows of order and category."""
    o = (_placed_orders(orders, excluded_statuses)
         .groupBy("order_id").agg(F.count(F.lit(1)).alias("_rows")))
    w = F.col("_rows")
    per_order = sold.join(o, "order_id").groupBy("order_id", "category_english").agg(
        *(F.sum(F.col(c) * w).alias(c) for c in SOLD_WEIGHTS))
    return (per_order.groupBy("category_english")
            .agg(F.count(F.lit(1)).alias("num_orders"), F.sum("_items").alias("num_items_sold"),
                 from_units(F.sum("_value")).alias("total_revenue"),
                 rounded_mean(F.sum("_price"), F.sum("_priced")).alias("avg_item_price"))
            .orderBy(F.col("total_revenue").desc_nulls_last(),
                     F.col("category_english").asc_nulls_first()))


def sales_by_state(orders: DataFrame, items: DataFrame, customers: DataFrame,
                   excluded_statuses: Sequence[str] = B.EXCLUDED_STATUSES) -> DataFrame:
    """M3: distinct orders, revenue and average order value per customer state."""
    return by_state(orders, _revenue_per_order(items), customers, excluded_statuses)


def by_state(orders: DataFrame, revenue: DataFrame, customers: DataFrame,
             excluded_statuses: Sequence[str]) -> DataFrame:
    """M3 from each order's revenue."""
    o = _placed_orders(orders, excluded_statuses).select("order_id", "customer_id")
    c = customers.select("customer_id", "customer_state")
    # State lookup first, at order grain; then the per-order revenue joins on
    # order_id, whose partitioning also serves the distinct count.
    j = o.join(c, "customer_id").join(revenue, "order_id")
    agg = j.groupBy("customer_state").agg(
        F.countDistinct("order_id").alias("num_orders"), F.sum("_rev").alias("_rev"))
    return (agg.select("customer_state", *_aov_columns("num_orders", "_rev"))
            .orderBy(F.col("total_revenue").desc_nulls_last(),
                     F.col("customer_state").asc_nulls_first()))


def sales_payment_breakdown(payments: DataFrame) -> DataFrame:
    """M4: orders, total paid and mean installments per payment type.

    Reads the cleaned payments only: no order-status filter applies here.
    """
    return (payments.groupBy("payment_type")
            .agg(F.countDistinct("order_id").alias("num_orders"),
                 money_sum("payment_value").alias("total_paid"),
                 F.round(F.avg(F.col("payment_installments").cast("double")), 2)
                 .alias("avg_installments"))
            .orderBy(F.col("total_paid").desc_nulls_last(),
                     F.col("payment_type").asc_nulls_first()))
