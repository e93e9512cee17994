"""Merkle manifest of a dataset: a tree per group, and one over the groups.

Every row becomes a leaf, the SHA-256 of its columns. Within a group the leaves
ascend by id; every ``fanout`` consecutive nodes become their parent (the last run
may be shorter, even one) until one is left, the group's subroot. The subroots,
ordered by group, give the root in the same way. A row's proof lists the other
nodes of its run on every level, so that its leaf and its proof give the root.

How it runs:

1. Leaves are range-partitioned by group and id, sorted and written. Counts per
   partition and group (few rows) turn places in a partition into places in the
   group, and aligned blocks of ``fanout ** k`` leaves (at most ``BLOCK``) become rows.
2. Each block hashes its own subtree.
3. Butterfly exchange: in round r the blocks form aligned groups whose nodes share
   a parent r levels up. Each block gets the other nodes from one partner under each
   and hashes the parent itself, redundantly, so after every round all blocks know
   their own ancestor and its siblings. The last round leaves the proof above
   the block and the subroot in every block; nothing is passed back down. Where
   the last subtree is short, its blocks serve several partners each. A round is a
   join of one row per block and is written, which cuts the lineage.
4. The tree over the groups is built by the same two steps, its leaves the subroots.
5. Each block gives its leaves the proof inside the block followed by that above.

No task holds more than ``BLOCK`` leaves of a tree; the driver gets only the number
of blocks of the largest group.

Defined cases: a NULL column is ``-`` in the leaf; a NULL group is a group of its own,
before all others; NULL ids come first; rows of one id are ordered by leaf; a
lone leaf is its group's subroot, and a lone subroot the root; an empty table
gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import ship, stored

BLOCK = 4096     # leaves of a block at most
PIECE = 512      # leaves of a batch that leaves a task


def leaf_hash(*columns: Column) -> Column:
    """Hex SHA-256 of the columns: ``-`` for NULL, else byte count, ``:`` and value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def node_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fold(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf gives with its proof."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf,
                       lambda node, x: node_hash(F.concat(x["l"], node, x["r"])))


def proof_text(lefts: Column, rights: Column) -> Column:
    """The siblings of a proof, level by level, from left to right."""
    return F.array_join(F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")),
                                    lambda x: F.concat(x["l"], x["r"])), "")


def _levels(leaves: list[str], fanout: int, depth: int | None) -> list[list[str]]:
    """Levels of a subtree from its leaves up: ``depth`` of them, or to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1 if depth is None else len(levels) <= depth:
        low = levels[-1]
        levels.append([hashlib.sha256("".join(low[i:i + fanout]).encode()).hexdigest()
                       for i in range(0, len(low), fanout)])
    return levels


@dataclass
class Forest:
    """A tree per group: ``blocks`` of leaves, and per block its ancestors' siblings."""

    keys: list[str]     # columns that name a group (none is NULL)
    fanout: int
    depth: int          # levels within a block
    blocks: DataFrame   # keys, block, blocks, members: array<struct<at, leaf, row>>
    upper: DataFrame    # keys, block, node (the subroot), lefts, rights


def _placed(rows: DataFrame, keys: list[str], order: list[Column | str], label: str) -> DataFrame:
    """Adds ``at`` (place in the group, from 0) and ``total`` (rows of the group)."""
    by = [*keys, *order]
    dealt = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                   .withColumn("mark", F.monotonically_increasing_id()), label)
    part = F.shiftright("mark", 33)   # the partition's number; the rest counts its rows
    held = dealt.groupBy(*keys, part.alias("part")).agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*keys, "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("n").over(group).alias("total"))
    return (dealt.withColumn("part", part).join(starts, [*keys, "part"])
            .withColumn("at", F.col("mark") + F.col("shift")).drop("mark", "shift", "part"))


def _subroots(blocks: DataFrame, keys: list[str], fanout: int, depth: int) -> DataFrame:
    """One node per block; a group of a single block is hashed up to its subroot."""
    names = [*keys, "block", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [_levels(leaves, fanout, depth if n > 1 else None)[-1][0]
                     for leaves, n in zip(b.column("leaves").to_pylist(), b.column("blocks").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(nodes, pa.string())],
                                             [*names, "node"])

    read = blocks.select(*names, F.transform("members", lambda x: x["leaf"]).alias("leaves"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.select(*names).schema)
    return read.mapInArrow(run, types + ", node string")


def _butterfly(nodes: DataFrame, keys: list[str], fanout: int, label: str) -> DataFrame:
    """Rounds of exchange between blocks: adds the siblings of each block's ancestors."""
    none = F.array().cast("array<string>")
    state = stored(nodes.withColumn("lefts", none).withColumn("rights", none), label)
    most = state.agg(F.max("blocks")).first()[0] or 1
    span = 1   # blocks under a node of this round
    while span < most:
        block, blocks = F.col("block"), F.col("blocks")
        own = F.floor(block / span) % fanout
        first_node = F.floor(block / (span * fanout)) * fanout
        out, others = state, []
        for j in range(1, fanout):
            place = (own + j) % fanout
            start = (first_node + place) * span
            size = F.least(F.lit(span), blocks - start)
            partner = F.when(size > 0, start + (block % span) % size).cast("long")
            peers = state.select(*(F.col(c).alias(f"peer {c}") for c in keys),
                                 F.col("block").alias("peer block"), F.col("node").alias(f"node {j}"))
            out = (out.withColumn("asked", partner).join(peers, reduce(
                lambda a, b: a & b, (F.col(c) == F.col(f"peer {c}") for c in keys),
                F.col("asked") == F.col("peer block")), "left")
                .drop("asked", "peer block", *(f"peer {c}" for c in keys)))
            others.append(F.struct(place.cast("long").alias("place"), F.col(f"node {j}").alias("node")))
        there = F.array_sort(F.filter(F.array(*others), lambda x: x["node"].isNotNull()))

        def joined(before: bool) -> Column:
            side = F.filter(there, lambda x: x["place"] < own if before else x["place"] > own)
            return F.array_join(F.transform(side, lambda x: x["node"]), "")

        climbs = blocks > span   # this group still has more than one node
        out = (out.withColumn("left", joined(True)).withColumn("right", joined(False))
               .select(*keys, "block", "blocks",
                       F.when(climbs, node_hash(F.concat("left", "node", "right"))).otherwise(F.col("node")).alias("node"),
                       F.when(climbs, F.array_append("lefts", F.col("left"))).otherwise(F.col("lefts")).alias("lefts"),
                       F.when(climbs, F.array_append("rights", F.col("right"))).otherwise(F.col("rights")).alias("rights")))
        span *= fanout
        state = stored(out, label)
    return state


def forest(rows: DataFrame, keys: list[str], order: list[Column | str], fanout: int,
           block: int = BLOCK, label: str = "merkle") -> Forest:
    """Trees of ``rows`` (columns: the keys, leaf, row: a struct to carry)."""
    depth = 0
    while fanout ** (depth + 1) <= block:
        depth += 1
    size = fanout ** depth
    ship(rows.sparkSession)
    placed = _placed(rows, keys, order, label + "-leaves")
    blocks = stored(
        placed.withColumn("block", F.floor(F.col("at") / size))
        .withColumn("blocks", F.ceil(F.col("total") / size))
        .groupBy(*keys, "block", "blocks")
        .agg(F.array_sort(F.collect_list(F.struct("at", "leaf", "row"))).alias("members")), label + "-blocks")
    nodes = _subroots(blocks, keys, fanout, depth)
    return Forest(keys, fanout, depth, blocks, _butterfly(nodes, keys, fanout, label + "-nodes"))


def leaf_proofs(trees: Forest, above: DataFrame | None = None) -> DataFrame:
    """Per leaf: leaf, row, subroot, root, lefts, rights.

    ``above`` (keys, lefts, rights, root) continues each group's proof beyond its subroot.
    """
    keys, fanout, depth = trees.keys, trees.fanout, trees.depth
    upper = trees.upper.drop("blocks").withColumnRenamed("node", "subroot")
    if above is None:
        upper = upper.withColumn("root", F.col("subroot"))
    else:
        more = above.select(*keys, F.col("lefts").alias("more_lefts"), F.col("rights").alias("more_rights"), "root")
        upper = (upper.join(more, keys).withColumn("lefts", F.concat("lefts", "more_lefts"))
                 .withColumn("rights", F.concat("rights", "more_rights")).drop("more_lefts", "more_rights"))
    met = (trees.blocks.join(upper, [*keys, "block"])
           .select("blocks", "members", "subroot", "root", "lefts", "rights"))
    row_type = trees.blocks.schema["members"].dataType.elementType["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                members = b.column("members").slice(i, 1).flatten()
                n = b.column("blocks")[i].as_py()
                subroot, root, lefts, rights = (b.column(c)[i].as_py() for c in ("subroot", "root", "lefts", "rights"))
                leaves = members.field("leaf").to_pylist()
                levels = _levels(leaves, fanout, depth if n > 1 else None)[:-1]
                for at in range(0, len(leaves), PIECE):
                    size = min(PIECE, len(leaves) - at)
                    left, right = [], []
                    for leaf in range(at, at + size):
                        before, after, place = [], [], leaf
                        for level in levels:
                            run_at = place - place % fanout
                            before.append("".join(level[run_at:place]))
                            after.append("".join(level[place + 1:run_at + fanout]))
                            place //= fanout
                        left.append(before + lefts)
                        right.append(after + rights)
                    part = members.slice(at, size)
                    same = np.zeros(size, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pc.struct_field(part, "leaf"), pc.struct_field(part, "row"),
                         pa.array([subroot], pa.string()).take(same), pa.array([root], pa.string()).take(same),
                         pa.array(left, pa.list_(pa.string())), pa.array(right, pa.list_(pa.string()))],
                        ["leaf", "row", "subroot", "root", "lefts", "rights"])

    return met.mapInArrow(run, f"leaf string, row {row_type}, subroot string, root string, "
                               "lefts array<string>, rights array<string>")


def manifest(docs: DataFrame, columns: list[str], group_col: str = "lang", id_col: str = "doc_id",
             fanout: int = 2, carry: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """Leaf, subroot, root and proof (lefts, rights) of every row, with its id and
    the ``carry`` columns (name -> expression over ``docs``) in the struct ``row``."""
    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    row = F.struct(col(id_col).alias("id"), *(c.alias(n) for n, c in (carry or {}).items()))
    rows = docs.select(col(group_col).isNotNull().cast("int").alias("has_group"),
                       F.coalesce(col(group_col).cast("string"), F.lit("")).alias("group"),
                       leaf_hash(*map(col, columns)).alias("leaf"), row.alias("row"))
    keys = ["has_group", "group"]
    trees = forest(rows, keys, ["row.id", "leaf"], fanout, block)
    tops = trees.upper.where("block = 0").select(F.lit(0).alias("all"), F.col("node").alias("leaf"),
                                                 F.struct(*keys).alias("row"))
    top = leaf_proofs(forest(tops, ["all"], ["row.has_group", "row.group"], fanout, block, "merkle-top"))
    return leaf_proofs(trees, top.select("row.*", "root", "lefts", "rights"))
