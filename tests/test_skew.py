"""A hot order (a third of all items) is combined before the order join.

With broadcasts off, the order joins are sort-merge joins. Items must be
grouped by order and by the mart's group, partly before their shuffle, so that
the hot order reaches the join as a few rows per task; the answer must be that
of the rows one by one.
"""

from __future__ import annotations

import re

import pytest

from souk.plans.registry import Marketplace, Params
from souk.schemas import RAW_SCHEMAS

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
MARTS = {"logistics_route_performance": "seller_state", "sales_by_category": "category_english",
         "reviews_score_by_category": "category_english",
         "reviews_score_by_payment": "payment_type"}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in list(SKEW_CONF) + [
        "spark.sql.adaptive.skewJoin.enabled"]}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _model(spark):
    n_orders, n_items = 300, 3000
    orders = [(f"o{i}", f"c{i % 7}", "delivered", "2018-01-01 00:00:00", None, None,
               f"2018-01-{5 + i % 20:02d} 00:00:00", "2018-01-10 00:00:00")
              for i in range(n_orders)]
    items = [("o0" if j < n_items // 3 else f"o{j % n_orders}", j, f"p{j % 11}", f"s{j % 5}",
              "2018-01-02 00:00:00", 10.0 + j % 7, 1.0) for j in range(n_items)]
    reviews = [(f"r{i}", f"o{i}", 1 + i % 5, None, None, "2018-01-06 00:00:00",
                "2018-01-07 00:00:00") for i in range(n_orders)]

    def df(t, rows):
        return spark.createDataFrame(rows, RAW_SCHEMAS[t])
    raw = {
        "raw_orders": df("raw_orders", orders),
        "raw_order_items": df("raw_order_items", items),
        "raw_products": df("raw_products",
                           [(f"p{i}", f"cat{i % 3}") + (1.0,) * 7 for i in range(11)]),
        "raw_category_translation": df("raw_category_translation", [("cat0", "zero")]),
        "raw_customers": df("raw_customers", [(f"c{i}", "u", 1, "x", f"S{i}") for i in range(7)]),
        "raw_sellers": df("raw_sellers", [(f"s{i}", 1, "x", f"T{i}") for i in range(5)]),
        "raw_order_reviews": df("raw_order_reviews", reviews),
        "raw_order_payments": df("raw_order_payments",
                                 [(f"o{i}", 1, "card", 1, 5.0) for i in range(n_orders)]),
        "raw_geolocation": df("raw_geolocation", [(1, 1.0, 1.0, "a", "X")]),
    }
    return Marketplace(raw, Params(min_items_freight=1, min_orders_route=1,
                                   min_reviews_category=1, min_reviews_payment=1))


@pytest.mark.parametrize("name", MARTS)
def test_hot_order_is_combined_before_the_order_join(skew_conf, name):
    spark = skew_conf
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    df = _model(spark).view(name)
    with_split = sorted(map(tuple, df.collect()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    grouped = re.search(rf"Exchange hashpartitioning\(order_id#\d+L?, {MARTS[name]}#\d+L?.*\n(.*)", plan)
    assert grouped and "HashAggregate" in grouped[1] + plan[grouped.end():].split("Exchange")[0]
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    without = sorted(map(tuple, _model(spark).view(name).collect()))
    assert with_split == without


def test_hot_order_counts_are_those_of_single_rows(spark):
    model = _model(spark)
    sold = {r.category_english: (r.num_orders, r.num_items_sold, r.total_revenue)
            for r in model.sales_by_category.collect()}
    want = {}
    for j in range(3000):
        order = "o0" if j < 1000 else f"o{j % 300}"
        category = ("zero", "cat1", "cat2")[j % 11 % 3]
        ids, n, total = want.setdefault(category, (set(), 0, 0.0))
        want[category] = (ids | {order}, n + 1, total + 11.0 + j % 7)
    assert sold == {c: (len(ids), n, total) for c, (ids, n, total) in want.items()}
