"""Query key -> DuckDB SQL (see :mod:`souk.testing.oracle_sql`)."""

from __future__ import annotations

from souk.testing import oracle_sql as O

VIEW_KEYS = (
    "clean_orders", "clean_products", "geo_avg", "geo_mode", "clean_geolocation",
    "clean_order_items", "clean_payments", "clean_reviews",
    "sales_monthly_trend", "sales_by_category", "sales_by_state", "sales_payment_breakdown",
    "logistics_delivery_by_state", "logistics_delay_distribution", "logistics_freight_ratio",
    "logistics_route_performance", "reviews_score_distribution", "reviews_score_by_delay",
    "reviews_score_by_category", "reviews_score_by_payment",
)


def view_oracle_sql() -> dict[str, str]:
    out = {}
    for key in VIEW_KEYS:
        cte = "_" + key if key in ("geo_avg", "geo_mode") else key
        out[key] = O.view(cte)
    strict = O._marts(min_freight=890, min_category=591, min_payment=486)
    for key in ("logistics_freight_ratio", "reviews_score_by_category",
                "reviews_score_by_payment"):
        out[key + "_strict"] = O.view(key, strict)
    return out


def all_oracle_sql() -> dict[str, str]:
    from souk.testing.oracle_metrics import metric_oracle_sql
    from souk.testing.oracle_sources import source_oracle_sql
    return {**view_oracle_sql(), **metric_oracle_sql(), **source_oracle_sql()}
