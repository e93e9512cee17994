"""Review marts.

M10-M12 count join rows, not reviews: a review of an order with three items
of one category counts three times in that category, and a review of an
order paid in two parts counts once per payment row.

Those pair counts are computed without emitting the pairs. Reviews are first
reduced to one row per order (reviews, score sum, scored reviews); that
partial aggregate is shuffled by ``order_id``, the key the join needs anyway,
so it costs no extra exchange. Each item or payment row adds its order's totals
times its weight; those of hot orders are combined before the join
(``souk.operators.hot``), all others meet it with one exchange. The result equals
COUNT(*) and AVG over the pair join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import buckets as B
from souk.functions.exprs import Bucket, bucket_label, bucket_order, pct
from souk.operators.hot import combine_hot


def _reviews_per_order(reviews: DataFrame) -> DataFrame:
    """One row per order: its reviews, their score sum and scored reviews."""
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_reviews"),
        F.sum("review_score").alias("_score_sum"),
        F.count("review_score").alias("_scored"))


def _pair_stats(weight: Column | None = None) -> list[Column]:
    """COUNT(*) and AVG(score) over review x row pairs, from per-order totals."""
    w = F.lit(1) if weight is None else weight
    return [
        F.sum(F.col("_reviews") * w).alias("num_reviews"),
        F.round(F.sum(F.col("_score_sum") * w).cast("double")
                / F.nullif(F.sum(F.col("_scored") * w), F.lit(0)), 2).alias("avg_review_score"),
    ]


def reviews_score_distribution(reviews: DataFrame) -> DataFrame:
    """M9: reviews per score and share of all reviews.

    The total is a scalar subquery over the grouped result; Spark reuses the
    grouping's shuffle for it, so the reviews are scanned once and the total
    is a global aggregate of partial sums.
    """
    g = reviews.groupBy("review_score").agg(F.count(F.lit(1)).alias("num_reviews"))
    total = g.select(F.sum("num_reviews")).scalar()
    return (g.select("review_score", "num_reviews",
                     F.round(pct(F.col("num_reviews"), total), 1).alias("pct_of_total"))
            .orderBy(F.col("review_score").asc_nulls_first()))


def reviews_score_by_delay(reviews: DataFrame, orders: DataFrame,
                           buckets: Sequence[Bucket] = B.DELAY_BUCKETS_5) -> DataFrame:
    """Reviews and mean score per delivery-delay bucket."""
    o = (orders.where(F.col("delivery_delay_days").isNotNull())
         .select("order_id", bucket_order("delivery_delay_days", buckets).alias("sort_order")))
    j = o.join(_reviews_per_order(reviews), "order_id")
    return (j.groupBy("sort_order")
            .agg(*_pair_stats())
            .select(bucket_label("sort_order", buckets).alias("delay_bucket"),
                    "sort_order", "num_reviews", "avg_review_score")
            .orderBy("sort_order"))


def reviews_score_by_category(reviews: DataFrame, items: DataFrame, products: DataFrame,
                              min_reviews: int = B.MIN_REVIEWS_CATEGORY) -> DataFrame:
    """(review x item) rows and mean score per category."""
    p = products.select("product_id", "category_english")
    sold = combine_hot(items.select("order_id", "product_id"), "order_id", ["category_english"], ["_items"],
                       lambda rows: rows.join(p, "product_id").withColumn("_items", F.lit(1).cast("long")))
    return score_by_category(reviews, sold, min_reviews)


def score_by_category(reviews: DataFrame, sold: DataFrame, min_reviews: int) -> DataFrame:
    """M11 from weighted rows of order and category."""
    return (sold.join(_reviews_per_order(reviews), "order_id").groupBy("category_english")
            .agg(*_pair_stats(F.col("_items")))
            .where(F.col("num_reviews") >= min_reviews)
            .orderBy(F.col("avg_review_score").asc_nulls_first(),
                     F.col("category_english").asc_nulls_first()))


def reviews_score_by_payment(reviews: DataFrame, payments: DataFrame,
                             min_reviews: int = B.MIN_REVIEWS_PAYMENT,
                             buckets: Sequence[Bucket] = B.INSTALLMENT_BUCKETS) -> DataFrame:
    """(review x payment) rows and mean score per type and installment bucket."""
    p = payments.select(
        "order_id", "payment_type",
        bucket_label(bucket_order("payment_installments", buckets), buckets)
        .alias("installments_bucket"))
    paid = combine_hot(p, "order_id", ["payment_type", "installments_bucket"], ["_payments"],
                       lambda rows: rows.withColumn("_payments", F.lit(1).cast("long")))
    j = paid.join(_reviews_per_order(reviews), "order_id")
    return (j.groupBy("payment_type", "installments_bucket")
            .agg(*_pair_stats(F.col("_payments")))
            .where(F.col("num_reviews") >= min_reviews)
            .orderBy(F.col("payment_type").asc_nulls_first(),
                     F.col("installments_bucket").asc_nulls_first()))
