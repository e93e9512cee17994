"""Joins on a key of which a few values hold a large share of the rows.

A frequency sketch (mergeable, of bounded size) finds the hot values: those of more
than one in ``HOT_SHARE`` rows, so fewer than ``HOT_SHARE`` of them, which is what
may be broadcast. Rows of hot values are summed per value and group before they
are shuffled, so each reaches the join as a few rows; all other rows meet the join
as they are, with the one exchange by the key that the join needs anyway. Both
kinds carry weights, so what follows need not tell them apart: a value that the
sketch misses costs a larger task, never another result.

The sketches of the tasks are merged in two steps (``MERGERS`` groups, then one).
If nothing is hot, adaptive execution drops the branch of the hot rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000   # more than one in so many rows: a hot value
TRACKED = 10_000   # values that a sketch tracks; its error is far below one in HOT_SHARE
MERGERS = 64


def hot_values(rows: DataFrame, key: str) -> DataFrame:
    """At most ``HOT_SHARE`` values of ``key`` that more than one in so many rows hold."""
    merged = (rows.select(key).where(F.col(key).isNotNull())
              .groupBy((F.spark_partition_id() % MERGERS).alias("_merger"))
              .agg(F.count(F.lit(1)).alias("_n"), F.expr(f"approx_top_k_accumulate({key}, {TRACKED})").alias("_s")))
    # by a key that is always 0: sketches cannot be combined over an empty partition
    found = merged.groupBy((F.col("_merger") % 1).alias("_all")).agg(
        F.sum("_n").alias("_n"), F.expr(f"approx_top_k_combine(_s, {TRACKED})").alias("_s"))
    return (found.select("_n", F.explode(F.expr(f"approx_top_k_estimate(_s, {HOT_SHARE})")).alias("_x"))
            .where(F.col("_x.count") * HOT_SHARE > F.col("_n")).select(F.col("_x.item").alias(key)))


def combine_hot(rows: DataFrame, key: str, groups: Sequence[str], weights: Sequence[str],
                looked_up: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, groups, weights) of ``looked_up(rows)``, hot values summed per group.

    ``looked_up`` adds groups and weights to rows, one output row per input row.
    """
    hot = F.broadcast(hot_values(rows, key))
    columns = [key, *groups, *weights]
    others = looked_up(rows.join(hot, key, "left_anti")).select(*columns)
    combined = (looked_up(rows.join(hot, key, "left_semi")).groupBy(key, *groups)
                .agg(*(F.sum(w).alias(w) for w in weights)))
    return others.unionByName(combined)
