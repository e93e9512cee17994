"""Headline metrics computed on top of the marts.

These take mart DataFrames (small: one row per month, state, category or
route) and return small DataFrames. Ties in top-k and arg-max/min are broken
by the mart's key so the answer is deterministic; whole-table totals come
from one-row aggregates or scalar subqueries, never from a window over all
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions import buckets as B
from souk.functions.exprs import FIXED_TYPE, exact_mean, pct


def _top(df: DataFrame, metric: str, keys: Sequence[str], k: int, largest: bool,
         skip_null: bool = True) -> DataFrame:
    """Top/bottom-k by ``metric``, ties broken by ``keys`` (planned as a top-k,
    not a full sort). ``skip_null`` drops rows whose metric is NULL, as
    ``nlargest``/``nsmallest``/``idxmax``/``idxmin`` do; ``head`` of a sorted
    table keeps them (sorted last)."""
    if skip_null:
        df = df.where(F.col(metric).isNotNull())
    m = F.col(metric).desc_nulls_last() if largest else F.col(metric).asc_nulls_last()
    return df.orderBy(m, *[F.col(c).asc_nulls_first() for c in keys]).limit(k)


def trend_without_partial_months(trend: DataFrame,
                                 months: Sequence[str] = B.PARTIAL_MONTHS) -> DataFrame:
    """Monthly trend without the listed partial months (NULL month kept)."""
    drop = F.coalesce(F.col("year_month").isin(*months), F.lit(False))
    return trend.where(~drop)


def top_categories(by_category: DataFrame, k: int = 10) -> DataFrame:
    """The k categories with the highest revenue, shown in ascending order."""
    return (_top(by_category, "total_revenue", ["category_english"], k, largest=True,
                 skip_null=False)
            .orderBy(F.col("total_revenue").asc_nulls_first(), F.col("category_english")))


def top_states(by_state: DataFrame, k: int = 10) -> DataFrame:
    """D3: the k states with the highest revenue, shown in ascending order."""
    return (_top(by_state, "total_revenue", ["customer_state"], k, largest=True,
                 skip_null=False)
            .orderBy(F.col("total_revenue").asc_nulls_first(), F.col("customer_state")))


def payment_share(payments: DataFrame) -> DataFrame:
    """Each payment type's percentage of the total paid (exact total,
    as a scalar subquery over the mart)."""
    total = payments.select(
        F.sum(F.col("total_paid").cast(FIXED_TYPE)).cast("double")).scalar()
    return payments.select("payment_type", "total_paid",
                           F.round(pct(F.col("total_paid"), total), 1).alias("share_pct"))


# Display names of the payment table.
PAYMENT_TABLE_NAMES = {
    "payment_type": "Payment Type",
    "num_orders": "Orders",
    "total_paid": "Total Paid (R$)",
    "avg_installments": "Avg Installments",
}


def payment_table(payments: DataFrame) -> DataFrame:
    """The payment mart with presentation column names."""
    return payments.withColumnsRenamed(PAYMENT_TABLE_NAMES)


def best_state(by_state: DataFrame) -> DataFrame:
    """The state with the highest on-time %, first state on ties."""
    return _top(by_state, "pct_on_time", ["customer_state"], 1, largest=True).select(
        "customer_state", "pct_on_time")


def worst_state(by_state: DataFrame) -> DataFrame:
    """The state with the lowest on-time %, first state on ties."""
    return _top(by_state, "pct_on_time", ["customer_state"], 1, largest=False).select(
        "customer_state", "pct_on_time")


def mean_days_of_states(by_state: DataFrame) -> DataFrame:
    """Unweighted mean of the states' mean delivery days."""
    return by_state.agg(exact_mean("avg_delivery_days", FIXED_TYPE).alias("mean_delivery_days"))


def mean_on_time_of_states(by_state: DataFrame) -> DataFrame:
    """Unweighted mean of the states' on-time % (the "national average" line)."""
    return by_state.agg(exact_mean("pct_on_time", FIXED_TYPE).alias("mean_pct_on_time"))


def states_by_on_time(by_state: DataFrame) -> DataFrame:
    """States ordered by on-time %."""
    return by_state.orderBy(F.col("pct_on_time").asc_nulls_last(), F.col("customer_state"))


def top_freight(freight: DataFrame, k: int = 10) -> DataFrame:
    """The k categories with the highest freight share, shown ascending."""
    return (_top(freight, "freight_pct_of_price", ["category_english"], k, largest=True)
            .orderBy(F.col("freight_pct_of_price").asc_nulls_first(), F.col("category_english")))


def slowest_routes(routes: DataFrame, k: int = 15) -> DataFrame:
    """The k routes with the longest mean delivery, labelled "A → B"."""
    label = F.concat_ws(" → ", F.coalesce(F.col("seller_state"), F.lit("None")),
                        F.coalesce(F.col("customer_state"), F.lit("None")))
    top = _top(routes, "avg_delivery_days", ["seller_state", "customer_state"], k, largest=True)
    return (top.withColumn("route", label)
            .orderBy(F.col("avg_delivery_days").asc_nulls_first(), "seller_state",
                     "customer_state"))


def weighted_score(dist: DataFrame) -> DataFrame:
    """Mean review score weighted by the number of reviews per score."""
    return dist.agg(
        (F.sum(F.col("review_score") * F.col("num_reviews")).cast("double")
         / F.nullif(F.sum("num_reviews"), F.lit(0))).alias("avg_review_score"))


def five_star_share(dist: DataFrame) -> DataFrame:
    """Percentage of 5-star reviews."""
    return dist.where(F.col("review_score") == 5).select(F.col("pct_of_total").alias("pct_5star"))


def total_reviews(dist: DataFrame) -> DataFrame:
    """Number of reviews."""
    return dist.agg(F.sum("num_reviews").cast("long").alias("total_reviews"))


def delay_headline(by_delay: DataFrame) -> DataFrame:
    """Mean score of the earliest and of the latest delay bucket."""
    return by_delay.agg(
        F.min_by("avg_review_score", "sort_order").alias("early_score"),
        F.max_by("avg_review_score", "sort_order").alias("late_score"))


def lowest_categories(by_category: DataFrame, k: int = 10) -> DataFrame:
    """The k lowest-rated categories, shown from highest to lowest."""
    return (_top(by_category, "avg_review_score", ["category_english"], k, largest=False)
            .orderBy(F.col("avg_review_score").desc_nulls_last(), F.col("category_english")))


def home_kpis(trend: DataFrame, by_state: DataFrame, dist: DataFrame) -> DataFrame:
    """Headline numbers as (kpi, value) rows.

    Total revenue and total orders sum the monthly trend (an order belongs
    to one month, so nothing is counted twice); the score is D13; states
    covered counts the revenue-by-state rows.
    """
    rows = [
        trend.agg(F.sum(F.col("total_revenue").cast(FIXED_TYPE)).cast("double").alias("value"))
        .select(F.lit("total_revenue").alias("kpi"), "value"),
        trend.agg(F.sum("num_orders").cast("double").alias("value"))
        .select(F.lit("total_orders").alias("kpi"), "value"),
        weighted_score(dist).select(F.lit("avg_review_score").alias("kpi"),
                                    F.col("avg_review_score").alias("value")),
        by_state.agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.lit("states_covered").alias("kpi"), "value"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
