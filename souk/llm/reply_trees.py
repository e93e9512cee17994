"""Chat formatting of reply trees.

A message names its parent; the root-to-leaf paths of a tree are its possible
conversations. ``jump_tables`` joins the messages with themselves, again and
again: after round k a message knows its 2^k-th ancestor, the sum of the scores
on the way and how many there are, so a path of n messages takes log2(n)
rounds. Leaves are ranked by the mean score of their path; ``path_messages``
walks the tables down again for the chosen leaves, doubling what it has of each
path, so no row is made that is not in a chosen path. ``format_paths`` writes
each path as one text.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Control strings in
a role or text are escaped: a run of backslashes between ``<`` and ``|`` grows
by one, so ``<|`` never stands in escaped text and any text comes back as it
was. In roles, backslashes and line ends are escaped first. The loss mask has
the code points of each assistant text.

Every round is written to the shared scratch folder and read back. Texts are
joined only once, to the chosen paths. A conversation is one row of the
result, so its text is put together in one task; nothing larger is.

Defined cases: a NULL text is empty, a NULL role is an empty role; a parent
that is missing, or does not come before its message, makes the message a
root, so there are no cycles; equal scores are ranked by message number; NULL
conversation ids are one conversation; of repeated (conversation, message)
rows each is a message of the path; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import ship, stored

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the (start, end) code points under the loss mask."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]


def number_turns(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of linear conversations as trees: each turn replies to the one before."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    read = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                           F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    numbered = read.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.struct("conv").alias("tree"), "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(0.0).alias("score"), "role", "text")


def jump_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The ancestor tables by power of two, and per node its depth and score sum."""
    known = nodes.select("tree", F.col("node").alias("parent"))
    rooted = (nodes.where(F.col("parent") < F.col("node")).join(known, ["tree", "parent"], "semi")
              .select("tree", "node", F.col("parent").alias("up")).distinct())
    base = (nodes.groupBy("tree", "node").agg(F.max("score").alias("total"))
            .join(rooted.groupBy("tree", "node").agg(F.max("up").alias("up")),
                  ["tree", "node"], "left"))
    now = stored(base.withColumn("depth", F.lit(1).cast("long")), "tree-jump")
    tables = []
    while not (going := now.where(F.col("up").isNotNull())).isEmpty():
        tables.append(going.select("tree", "node", "up"))
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"),
                           F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        # nodes that have reached their root are done and joined no more
        further = going.join(above, ["tree", "up"]).select(
            "tree", "node", (F.col("total") + F.col("total2")).alias("total"),
            F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"))
        now = stored(now.where(F.col("up").isNull()).unionByName(further), "tree-jump")
    return tables, now


def ranked_leaves(tables: list[DataFrame], summed: DataFrame, branches: int) -> DataFrame:
    """The ``branches`` best leaves of each tree: (tree, leaf, rank)."""
    leaves = summed
    if tables:  # the first table holds the replies
        leaves = summed.join(tables[0].select("tree", F.col("up").alias("node")),
                             ["tree", "node"], "anti")
    best = Window.partitionBy("tree").orderBy(
        (F.col("total") / F.col("depth")).desc(), F.col("node"))
    return (leaves.withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "rank"))


def path_messages(tables: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(tree, rank, node) of every message on the path to each chosen leaf."""
    path = leaves.select("tree", "rank", F.col("leaf").alias("node"))
    for table in tables:
        up = path.join(table, ["tree", "node"]).select("tree", "rank", F.col("up").alias("node"))
        path = stored(path.union(up), "tree-path")
    return path


def format_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """One row per chosen path: tree, rank, formatted text and loss mask."""
    ship(nodes.sparkSession)
    nodes = stored(nodes, "tree-nodes")
    tables, summed = jump_tables(nodes.drop("role", "text"))
    path = path_messages(tables, ranked_leaves(tables, summed, branches))
    turns = (path.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
             .groupBy("tree", "rank")
             .agg(F.sort_array(F.collect_list(F.struct("node", "role", "text"))).alias("turns")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                turns = b.column(2)[at].as_py()
                text, mask = format_turns([(t["role"] or "", t["text"] or "") for t in turns])
                mask = [{"start": a, "end": e} for a, e in mask]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 1), b.column(1).slice(at, 1), pa.array([text]),
                     pa.array([mask], pa.list_(pa.struct([("start", pa.int32()),
                                                          ("end", pa.int32())])))],
                    ["tree", "rank", "formatted", "loss_mask"])

    kind = turns.schema["tree"].dataType.simpleString()
    return turns.mapInArrow(run, f"tree {kind}, rank int, formatted string, "
                                 "loss_mask array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What a trainer reads from ``format_paths``: turns and the text under the mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            turns, losses = [], []
            for text, mask in zip(cols["formatted"], cols["loss_mask"]):
                turns.append([{"role": r, "text": t} for r, t in parse_turns(text)])
                losses.append("".join(unescape(text[m["start"]:m["end"]]) for m in mask))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(turns, kind), pa.array(losses, pa.string()),
                 pa.array([len(x) for x in cols["formatted"]], pa.int64())],
                ["tree", "rank", "turns", "loss_text", "formatted_chars"])

    kind = formatted.schema["tree"].dataType.simpleString()
    read = formatted.select("tree", "rank", "formatted", "loss_mask")
    return read.mapInArrow(run, f"tree {kind}, rank int, turns array<struct<role:string,"
                                "text:string>>, loss_text string, formatted_chars long")
