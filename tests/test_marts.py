"""Mart semantics on hand-written raw rows (grain, filters, thresholds)."""

from __future__ import annotations

import pytest

from souk.plans.registry import Marketplace, Params
from souk.schemas import RAW_SCHEMAS


def _df(spark, table, rows):
    return spark.createDataFrame(rows, RAW_SCHEMAS[table])


EST = "2018-01-10 00:00:00"


@pytest.fixture(scope="module")
def model(spark):
    orders = [
        # id, customer, status, purchase, approved, carrier, delivered, estimate
        ("o1", "c1", "delivered", "2018-01-01 00:00:00", None, None, "2018-01-05 00:00:00", EST),
        ("o2", "c1", "canceled", "2018-01-02 00:00:00", None, None, None, EST),
        ("o3", "c2", None, "2018-02-01 00:00:00", None, None, "2018-02-20 00:00:00", EST),
        ("o4", "c2", "delivered", "2018-02-03 00:00:00", None, None, "bad", EST),
        ("o5", "c2", "delivered", "2018-02-04 00:00:00", None, None, "2018-02-08 00:00:00", None),
        ("o6", "c1", "shipped", "2018-02-05 00:00:00", None, None, None, EST),
    ]
    items = [
        # order, item no., product, seller, limit, price, freight
        ("o1", 1, "p1", "s1", "2018-01-02 00:00:00", 10.0, 1.0),
        ("o1", 2, "p1", "s1", "2018-01-02 00:00:00", 10.0, 1.0),
        ("o1", 3, "p1", "s1", "2018-01-02 00:00:00", 10.0, 1.0),
        ("o2", 1, "p2", "s1", "2018-01-02 00:00:00", 5.0, 0.5),
        ("o3", 1, "p2", "s2", "2018-01-02 00:00:00", 7.0, 0.7),
        ("o6", 1, "p3", "s2", "2018-01-02 00:00:00", 0.0, 2.0),
    ]
    products = [("p1", "cama", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
                ("p2", "mesa", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
                ("p3", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    reviews = [("r1", "o1", 5, None, None, "2018-01-06 00:00:00", "2018-01-07 00:00:00"),
               ("r2", "o5", 1, None, None, "2018-01-06 00:00:00", "2018-01-07 00:00:00"),
               ("r3", "o3", 3, None, None, "2018-01-06 00:00:00", "2018-01-07 00:00:00")]
    payments = [("o1", 1, "credit_card", 0, 20.0), ("o1", 2, "voucher", 1, 13.0),
                ("o3", 1, "not_defined", 1, 7.7)]
    raw = {
        "raw_orders": _df(spark, "raw_orders", orders),
        "raw_order_items": _df(spark, "raw_order_items", items),
        "raw_products": _df(spark, "raw_products", products),
        "raw_category_translation": _df(spark, "raw_category_translation", [("cama", "bed")]),
        "raw_customers": _df(spark, "raw_customers", [("c1", "u1", 1, "x", "SP"),
                                                      ("c2", "u2", 2, "y", "RJ")]),
        "raw_sellers": _df(spark, "raw_sellers", [("s1", 1, "x", "MG"), ("s2", 2, "y", "SP")]),
        "raw_order_reviews": _df(spark, "raw_order_reviews", reviews),
        "raw_order_payments": _df(spark, "raw_order_payments", payments),
        "raw_geolocation": _df(spark, "raw_geolocation", [(1, 1.0, 1.0, "a", "X")]),
    }
    return Marketplace(raw, Params(min_items_freight=1, min_orders_route=1,
                                   min_reviews_category=1, min_reviews_payment=1))


def _rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_status_filter_drops_canceled_and_null(model):
    m = _rows(model.sales_monthly_trend, "year_month")
    # o2 canceled, o3 NULL status: only o1 (Jan) and o6 (Feb, shipped) count.
    assert m["2018-01"]["num_orders"] == 1 and m["2018-01"]["total_revenue"] == 33.0
    assert m["2018-01"]["avg_order_value"] == 33.0
    assert m["2018-02"]["num_orders"] == 1 and m["2018-02"]["total_revenue"] == 2.0


def test_sales_by_category_counts_items_and_distinct_orders(model):
    m = _rows(model.sales_by_category, "category_english")
    assert (m["bed"]["num_orders"], m["bed"]["num_items_sold"]) == (1, 3)
    assert m["bed"]["avg_item_price"] == 10.0
    assert m["unknown"]["num_items_sold"] == 1
    assert "mesa" not in m  # only canceled / NULL-status orders


def test_delivery_marts_ignore_status_and_follow_their_filters(model):
    by_state = _rows(model.logistics_delivery_by_state, "customer_state")
    # RJ: o3 (NULL status, delivered) and o5 (no estimate) have a delivery
    # timestamp; o4's text does not parse.
    assert by_state["RJ"]["num_delivered_orders"] == 2
    assert by_state["RJ"]["pct_on_time"] == 0.0
    assert by_state["SP"]["num_delivered_orders"] == 1
    dist = {r["sort_order"]: r["num_orders"] for r in model.logistics_delay_distribution.collect()}
    # o1: 5 days early -> bucket 3; o3: 41 days late -> bucket 7; o5 has no delay.
    assert dist == {3: 1, 7: 1}


def test_freight_ratio_zero_price_gives_null(model):
    m = _rows(model.logistics_freight_ratio, "category_english")
    assert m["unknown"]["freight_pct_of_price"] is None
    assert m["bed"]["freight_pct_of_price"] == 10.0


def test_route_grain_is_items(model):
    m = {(r["seller_state"], r["customer_state"]): r
         for r in model.logistics_route_performance.collect()}
    assert m[("MG", "SP")]["num_orders"] == 3
    assert m[("MG", "SP")]["pct_on_time"] == 100.0


def test_review_category_counts_review_item_pairs(model):
    m = _rows(model.reviews_score_by_category, "category_english")
    assert m["bed"]["num_reviews"] == 3 and m["bed"]["avg_review_score"] == 5.0


def test_review_payment_pairs_and_buckets(model):
    rows = {(r["payment_type"], r["installments_bucket"]): r["num_reviews"]
            for r in model.reviews_score_by_payment.collect()}
    assert rows == {("credit_card", "9+"): 1, ("voucher", "1 (single payment)"): 1}


def test_score_distribution_shares(model):
    m = _rows(model.reviews_score_distribution, "review_score")
    assert {k: v["pct_of_total"] for k, v in m.items()} == {1: 33.3, 3: 33.3, 5: 33.3}


def test_review_delay_buckets(model):
    m = _rows(model.reviews_score_by_delay, "sort_order")
    assert set(m) == {2, 5}  # o1 5 days early, o3 41 days late; o5 has no delay
    assert m[5]["delay_bucket"] == "Late (8+ days)"


def test_nlargest_style_metrics_skip_null(model):
    from souk.operators import metrics as M
    rows = M.top_freight(model.logistics_freight_ratio).collect()
    assert sorted(r["category_english"] for r in rows) == ["bed", "mesa"]  # unknown is NULL
    best = M.best_state(model.logistics_delivery_by_state).collect()
    assert [r["customer_state"] for r in best] == ["SP"]


def test_registered_views_answer_sql(spark, model):
    from souk.plans.registry import register_views
    names = register_views(model, prefix="t_")
    assert len(names) == 20 and names[0] == "t_clean_orders"
    got = spark.sql("SELECT year_month, num_orders FROM t_sales_monthly_trend "
                    "ORDER BY year_month").collect()
    assert [(r[0], r[1]) for r in got] == [("2018-01", 1), ("2018-02", 1)]
    n = spark.sql("SELECT COUNT(*) FROM t_clean_orders WHERE is_on_time = 1").collect()[0][0]
    assert n == 1


def test_pair_counts_without_emitting_pairs(spark):
    """3 reviews x 4 items of one category -> 12 pairs; 3 reviews x 2 payments -> 6."""
    reviews = [(f"r{i}", "o1", s, None, None, "2018-01-06 00:00:00", "2018-01-07 00:00:00")
               for i, s in enumerate([5, 4, None])]
    items = [("o1", j, "p1", "s1", "2018-01-02 00:00:00", 1.0, 0.1) for j in range(4)]
    raw = {
        "raw_orders": _df(spark, "raw_orders", [("o1", "c1", "delivered", "2018-01-01 00:00:00",
                                                 None, None, None, EST)]),
        "raw_order_items": _df(spark, "raw_order_items", items),
        "raw_products": _df(spark, "raw_products", [("p1", "cama") + (1.0,) * 7]),
        "raw_category_translation": _df(spark, "raw_category_translation", [("cama", "bed")]),
        "raw_order_reviews": _df(spark, "raw_order_reviews", reviews),
        "raw_order_payments": _df(spark, "raw_order_payments",
                                  [("o1", 1, "card", 3, 1.0), ("o1", 2, "card", 4, 1.0)]),
    }
    m = Marketplace(raw, Params(min_reviews_category=1, min_reviews_payment=1))
    cat = m.reviews_score_by_category.collect()
    assert [(r["category_english"], r["num_reviews"], r["avg_review_score"]) for r in cat] == [
        ("bed", 12, 4.5)]
    pay = m.reviews_score_by_payment.collect()
    assert [(r["payment_type"], r["installments_bucket"], r["num_reviews"],
             r["avg_review_score"]) for r in pay] == [("card", "2-4", 6, 4.5)]


def test_duplicated_order_rows_count_as_pairs(spark):
    """An order id listed twice doubles item / review pair counts, as a join would."""
    order = ("o1", "c1", "delivered", "2018-01-01 00:00:00", None, None,
             "2018-01-05 00:00:00", EST)
    raw = {
        "raw_orders": _df(spark, "raw_orders", [order, order]),
        "raw_order_items": _df(spark, "raw_order_items",
                               [("o1", j, "p1", "s1", "2018-01-02 00:00:00", 10.0, 1.0)
                                for j in range(3)]),
        "raw_products": _df(spark, "raw_products", [("p1", "cama") + (1.0,) * 7]),
        "raw_category_translation": _df(spark, "raw_category_translation", [("cama", "bed")]),
        "raw_customers": _df(spark, "raw_customers", [("c1", "u1", 1, "x", "SP")]),
        "raw_order_reviews": _df(spark, "raw_order_reviews",
                                 [("r1", "o1", 4, None, None, "2018-01-06 00:00:00",
                                   "2018-01-07 00:00:00")]),
    }
    m = Marketplace(raw)
    cat = m.sales_by_category.collect()[0]
    assert (cat["num_orders"], cat["num_items_sold"], cat["total_revenue"],
            cat["avg_item_price"]) == (1, 6, 66.0, 10.0)
    month = m.sales_monthly_trend.collect()[0]
    assert (month["num_orders"], month["total_revenue"], month["avg_order_value"]) == (
        1, 66.0, 66.0)
    delay = m.reviews_score_by_delay.collect()[0]
    assert (delay["num_reviews"], delay["avg_review_score"]) == (2, 4.0)


def test_means_on_half_a_cent_round_away_from_zero(spark):
    """Fractions of whole millionths: exactly .005 goes up (down below zero)."""
    from pyspark.sql import functions as F
    from souk.functions.exprs import rounded_fraction, rounded_mean
    rows = [(1691579505000, 33, 51259.99), (10000, 2, 0.01), (-10000, 2, -0.01), (30000, 2, 0.02),
            (29999, 2, 0.01), (1, 3, 0.0), (0, 5, 0.0), (10 ** 26 + 5000, 1, 10.0 ** 20 + 0.01), (7, 0, None)]
    df = spark.createDataFrame([(str(t), n, w) for t, n, w in rows], "t string, n long, want double").select(
        rounded_mean(F.col("t").cast("decimal(38,0)"), F.col("n")).alias("got"), "want")
    for r in df.collect():
        assert r.got == r.want
    got = spark.range(1).select(*(rounded_fraction(F.lit(a), F.lit(b), d).alias(f"x{i}") for i, (a, b, d) in enumerate(
        [(1, 8, 2), (-1, 8, 2), (1, -8, 2), (25, 10, 0), (1, 20, 1), (0, 3, 1)]))).first()
    assert list(got) == [0.13, -0.13, -0.13, 3.0, 0.1, 0.0]
