"""Hot orders are found by a sketch and combined; all other items meet the order join
with one exchange. The pair marts against the plain joins they stand for."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from souk.operators.hot import HOT_SHARE, combine_hot, hot_values
from tests.test_skew import _model, skew_conf  # noqa: F401


def test_sketch_finds_hot_values(spark):
    rows = spark.range(30_000).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 100 = 1 then 'warm' when id % 7 = 1 then null "
        "else cast(id as string) end as k")
    found = {r.k for r in hot_values(rows.repartition(7), "k").collect()}
    assert {"hot", "warm"} <= found and len(found) < HOT_SHARE
    assert hot_values(rows.where("k is null"), "k").count() == 0
    assert hot_values(rows.limit(0), "k").count() == 0
    assert {r.k for r in hot_values(spark.range(5000).selectExpr("id % 5000 as k"), "k").collect()} == set()


def test_combining_changes_no_sum(spark):
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 1L, if(id % 501 = 0, null, id)) as k", "id % 3 as g", "id as w")
    got = combine_hot(rows, "k", ["g"], ["w"], lambda r: r)
    assert got.count() < 11_000
    want = rows.where("k is not null").groupBy("k", "g").agg(F.sum("w").alias("w"))
    again = got.where("k is not null").groupBy("k", "g").agg(F.sum("w").alias("w"))
    assert again.exceptAll(want).isEmpty() and want.exceptAll(again).isEmpty()


@pytest.mark.parametrize("name", ["sales_by_category", "logistics_route_performance",
                                  "reviews_score_by_category", "reviews_score_by_payment"])
def test_one_item_exchange_by_order(skew_conf, name):  # noqa: F811
    """Ordinary items are dealt by order once: the exchange under the order join carries
    both kinds of rows, and only hot orders pass through another one."""
    plan = _model(skew_conf).view(name)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    anti = next(i for i, x in enumerate(lines) if "LeftAnti" in x)

    def depth(x):
        return len(x) - len(x.lstrip(" :+-*()0123456789|"))

    above, at = [], depth(lines[anti])
    for x in reversed(lines[:anti]):   # the operators between the root and the anti join
        if depth(x) < at:
            at = depth(x)
            above.append(x)
    exchanges = [x for x in above if "Exchange hashpartitioning(order_id" in x]
    assert len(exchanges) == 1 and re.search(r"hashpartitioning\(order_id#\d+L?, \d+\)", exchanges[0])


def test_pair_marts_equal_plain_joins(spark):
    """M8, M11 and M12 count rows of the joins without emitting them."""
    model = _model(spark)
    orders = model.clean_orders.where("order_delivered_customer_ts is not null")
    items, raw = model.clean_order_items, model.raw
    routes = (orders.join(items, "order_id").join(raw["raw_sellers"], "seller_id")
              .join(raw["raw_customers"], "customer_id").groupBy("seller_state", "customer_state")
              .agg(F.count("*").alias("n"), F.round(100.0 * F.avg("is_on_time"), 1).alias("pct")))
    assert {tuple(r) for r in routes.collect()} == {
        (r.seller_state, r.customer_state, r.num_orders, r.pct_on_time)
        for r in model.logistics_route_performance.collect()}
    pairs = model.clean_reviews.join(items, "order_id").join(model.clean_products, "product_id")
    assert {tuple(r) for r in pairs.groupBy("category_english").agg(
        F.count("*"), F.round(F.avg("review_score"), 2)).collect()} == {
        tuple(r) for r in model.reviews_score_by_category.select(
            "category_english", "num_reviews", "avg_review_score").collect()}
    paid = model.clean_reviews.join(model.clean_payments, "order_id").groupBy("payment_type").agg(
        F.count("*").alias("n"), F.round(F.avg("review_score"), 2).alias("s"))
    assert {tuple(r) for r in paid.collect()} == {
        (r.payment_type, r.num_reviews, r.avg_review_score) for r in model.reviews_score_by_payment.collect()}


def test_marts_share_one_pass_over_the_items(spark, tmp_path):
    """Six marts read the item facts: none of their plans scans the items, products or
    sellers, and they equal the marts built from the raw tables."""
    from souk.plans.build import FACT_MARTS, stage_shared
    from souk.plans.registry import Marketplace
    from souk.sources.csv_source import materialize_raw
    plain = _model(spark)
    raw = {n: spark.read.parquet(materialize_raw(df, f"{tmp_path}/raw/{n}")) for n, df in plain.raw.items()}
    model = stage_shared(Marketplace(raw, plain.p), str(tmp_path / "staged"))
    for name in FACT_MARTS:
        mart = model.view(name)
        files = mart.inputFiles()
        assert any("/item_facts.parquet/" in x for x in files)
        assert not any(f"/raw/{t}/" in x for x in files for t in ("raw_order_items", "raw_products", "raw_sellers"))
        assert sorted(map(str, mart.collect())) == sorted(map(str, plain.view(name).collect())), name
    alone = stage_shared(Marketplace(raw, plain.p), str(tmp_path / "one"), names=("sales_payment_breakdown",))
    assert alone.facts is None
    assert sorted(map(str, alone.sales_payment_breakdown.collect())) == sorted(
        map(str, plain.sales_payment_breakdown.collect()))
