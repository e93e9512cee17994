"""Item facts: what six marts need of the items, computed once.

M1, M2, M3, M7, M8 and M11 read the items with the category of their product, the
state of their seller, or neither. One pass over the items looks both up and adds
the items up per order, category and seller state; the marts then start from
those rows. Items whose product or seller is missing stay, marked, as M1 and M3 use
all items and the others only those they can look up. Product and seller ids are
keys of their tables. An order that holds a large share of all items is
combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.exprs import money_units

GROUPS = ("order_id", "_sold", "category_english", "_sent", "seller_state")


def item_facts(items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """One row per order, category and seller state, with counts and millionths."""
    p = products.select("product_id", "category_english", F.lit(True).alias("_sold"))
    s = sellers.select("seller_id", "seller_state", F.lit(True).alias("_sent"))
    return (items.select("order_id", "product_id", "seller_id", "price", "freight_value", "item_total_value")
            .join(p, "product_id", "left").join(s, "seller_id", "left")
            .groupBy(*GROUPS).agg(
                F.count(F.lit(1)).alias("_items"),
                F.count("price").alias("_priced"), F.sum(money_units("price")).alias("_price"),
                F.count("freight_value").alias("_freighted"),
                F.sum(money_units("freight_value")).alias("_freight"),
                F.sum(money_units("item_total_value")).alias("_value")))


def sold(facts: DataFrame) -> DataFrame:
    """Rows whose product is known."""
    return facts.where("_sold")


def sent(facts: DataFrame) -> DataFrame:
    """Rows whose seller is known."""
    return facts.where("_sent")


def freight_sums(facts: DataFrame) -> DataFrame:
    """M7's counts and sums per category."""
    return sold(facts).groupBy("category_english").agg(
        F.sum("_items").alias("num_items"), F.sum("_price").alias("_p"), F.sum("_priced").alias("_np"),
        F.sum("_freight").alias("_f"), F.sum("_freighted").alias("_nf"))
