"""Query keys for the headline metrics (D1-D18), each over freshly built marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.operators import metrics as M
from souk.plans.queries import Query, model_for

# Partial months of the sf0.01 driver tables: the first and last month of
# the monthly trend (the reference drops its own first and last month).
TEST_PARTIAL_MONTHS = ("1995-01", "2001-07")


def _q(fn) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(model_for(spark, sf_dir))
    q.__name__ = fn.__name__
    return q


def metric_queries() -> dict[str, Query]:
    return {
        "trend_without_partial_months": _q(
            lambda m: M.trend_without_partial_months(m.sales_monthly_trend, TEST_PARTIAL_MONTHS)),
        "top_categories": _q(lambda m: M.top_categories(m.sales_by_category)),
        "top_states": _q(lambda m: M.top_states(m.sales_by_state)),
        "payment_share": _q(lambda m: M.payment_share(m.sales_payment_breakdown)),
        "payment_table": _q(lambda m: M.payment_table(m.sales_payment_breakdown)),
        "best_state": _q(lambda m: M.best_state(m.logistics_delivery_by_state)),
        "worst_state": _q(lambda m: M.worst_state(m.logistics_delivery_by_state)),
        "mean_days_of_states": _q(lambda m: M.mean_days_of_states(m.logistics_delivery_by_state)),
        "mean_on_time_of_states": _q(
            lambda m: M.mean_on_time_of_states(m.logistics_delivery_by_state)),
        "states_by_on_time": _q(lambda m: M.states_by_on_time(m.logistics_delivery_by_state)),
        "top_freight": _q(lambda m: M.top_freight(m.logistics_freight_ratio)),
        "slowest_routes": _q(lambda m: M.slowest_routes(m.logistics_route_performance)),
        "weighted_score": _q(lambda m: M.weighted_score(m.reviews_score_distribution)),
        "five_star_share": _q(lambda m: M.five_star_share(m.reviews_score_distribution)),
        "total_reviews": _q(lambda m: M.total_reviews(m.reviews_score_distribution)),
        "delay_headline": _q(lambda m: M.delay_headline(m.reviews_score_by_delay)),
        "lowest_categories": _q(lambda m: M.lowest_categories(m.reviews_score_by_category)),
        "home_kpis": _q(lambda m: M.home_kpis(m.sales_monthly_trend, m.sales_by_state,
                                              m.reviews_score_distribution)),
    }
