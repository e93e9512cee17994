"""DuckDB SQL twins of the headline metrics (D1-D18), over the mart CTEs."""

from __future__ import annotations

from souk.testing.oracle_sql import coord_mean, pct, rnd, with_ctes

_EXACT_TOTAL = ("CAST(CAST(SUM(CAST(CAST(total_paid AS VARCHAR) AS DECIMAL(38,14))) OVER () "
                "AS VARCHAR) AS DOUBLE)")
_REV_TOTAL = ("CAST(CAST(SUM(CAST(CAST(total_revenue AS VARCHAR) AS DECIMAL(38,14))) "
              "AS VARCHAR) AS DOUBLE)")

_SQL = {
    "trend_without_partial_months": """
SELECT * FROM sales_monthly_trend
WHERE year_month IS NULL OR year_month NOT IN ('1995-01', '2001-07')""",
    "top_categories": """
SELECT * FROM sales_by_category
ORDER BY total_revenue DESC NULLS LAST, category_english ASC NULLS FIRST LIMIT 10""",
    "top_states": """
SELECT * FROM sales_by_state
ORDER BY total_revenue DESC NULLS LAST, customer_state ASC NULLS FIRST LIMIT 10""",
    "payment_share": f"""
SELECT payment_type, total_paid, {rnd(pct('total_paid', _EXACT_TOTAL), 1)} AS share_pct
FROM sales_payment_breakdown""",
    "payment_table": """
SELECT payment_type AS "Payment Type", num_orders AS "Orders",
       total_paid AS "Total Paid (R$)", avg_installments AS "Avg Installments"
FROM sales_payment_breakdown""",
    "best_state": """
SELECT customer_state, pct_on_time FROM logistics_delivery_by_state
WHERE pct_on_time IS NOT NULL
ORDER BY pct_on_time DESC NULLS LAST, customer_state ASC NULLS FIRST LIMIT 1""",
    "worst_state": """
SELECT customer_state, pct_on_time FROM logistics_delivery_by_state
WHERE pct_on_time IS NOT NULL
ORDER BY pct_on_time ASC NULLS LAST, customer_state ASC NULLS FIRST LIMIT 1""",
    "mean_days_of_states": f"""
SELECT {coord_mean('avg_delivery_days')} AS mean_delivery_days
FROM logistics_delivery_by_state""",
    "mean_on_time_of_states": f"""
SELECT {coord_mean('pct_on_time')} AS mean_pct_on_time FROM logistics_delivery_by_state""",
    "states_by_on_time": "SELECT * FROM logistics_delivery_by_state",
    "top_freight": """
SELECT * FROM logistics_freight_ratio WHERE freight_pct_of_price IS NOT NULL
ORDER BY freight_pct_of_price DESC NULLS LAST, category_english ASC NULLS FIRST LIMIT 10""",
    "slowest_routes": """
SELECT *, coalesce(seller_state, 'None') || ' → ' || coalesce(customer_state, 'None') AS route
FROM logistics_route_performance WHERE avg_delivery_days IS NOT NULL
ORDER BY avg_delivery_days DESC NULLS LAST, seller_state ASC NULLS FIRST,
         customer_state ASC NULLS FIRST
LIMIT 15""",
    "weighted_score": """
SELECT CAST(SUM(review_score * num_reviews) AS DOUBLE) / NULLIF(SUM(num_reviews), 0)
         AS avg_review_score
FROM reviews_score_distribution""",
    "five_star_share": """
SELECT pct_of_total AS pct_5star FROM reviews_score_distribution WHERE review_score = 5""",
    "total_reviews": """
SELECT CAST(SUM(num_reviews) AS BIGINT) AS total_reviews FROM reviews_score_distribution""",
    "delay_headline": """
SELECT arg_min(avg_review_score, sort_order) AS early_score,
       arg_max(avg_review_score, sort_order) AS late_score
FROM reviews_score_by_delay""",
    "lowest_categories": """
SELECT * FROM reviews_score_by_category WHERE avg_review_score IS NOT NULL
ORDER BY avg_review_score ASC NULLS LAST, category_english ASC NULLS FIRST LIMIT 10""",
    "home_kpis": f"""
SELECT 'total_revenue' AS kpi, {_REV_TOTAL} AS value FROM sales_monthly_trend
UNION ALL
SELECT 'total_orders', CAST(SUM(num_orders) AS DOUBLE) FROM sales_monthly_trend
UNION ALL
SELECT 'avg_review_score',
       CAST(SUM(review_score * num_reviews) AS DOUBLE) / NULLIF(SUM(num_reviews), 0)
FROM reviews_score_distribution
UNION ALL
SELECT 'states_covered', CAST(COUNT(*) AS DOUBLE) FROM sales_by_state""",
}


def metric_oracle_sql() -> dict[str, str]:
    return {k: with_ctes(v) for k, v in _SQL.items()}
