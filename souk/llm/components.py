"""Connected components of a graph given by its links (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import stored


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of every node that has a link to another; the root is the
    component's least node.

    Links are rehung in turns: onto the least neighbour of each node for its
    larger neighbours, then for its smaller ones, until nothing changes. Each
    turn is written to the shared scratch folder, in files for its number of links
    (``rows``: at most so many are given); one sum per turn reaches the driver.
    """
    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .where("u > v").distinct(), "links", rows=rows)
    state = None
    while True:
        sums = now.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums == state or not sums.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct())
        state = sums
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node without smaller neighbours keeps its hold on its larger ones
        large = large.where("u > v").distinct()
        small = large.join(least(large), "u")
        now = stored(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .union(small.select("u", F.col("m").alias("v"))).distinct(), "links", rows=sums.n)
