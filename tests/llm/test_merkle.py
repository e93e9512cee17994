"""op12 against a plain tree: fanouts, blocks of few leaves, edge rows, changed rows."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from souk.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(leaves: list[str], fanout: int):
    """Root and, per leaf, its (left, right) siblings level by level."""
    paths, level, places = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(places):
            run = p - p % fanout
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1:run + fanout])))
        level = [h("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
        places = [p // fanout for p in places]
    return level[0], paths


def want(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0] or 0, leaf(r)), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = plain([x[0][2] for x in groups[g]], fanout)
    root, tops = plain([trees[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops):
        for ((_, _, own), doc_id), path in zip(groups[g], trees[g][1]):
            out.append((doc_id, own, trees[g][0], root, tuple(path + top)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.row.id, r.leaf, r.subroot, r.root, tuple(zip(r.lefts, r.rights)))
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("fanout,block", [(2, 4), (2, 4096), (3, 9), (4, 1)])
def test_equals_a_plain_tree(spark, fanout, block):
    """Groups of 1, 2, 9, 33 and 60 leaves: several rounds of exchange, short last runs."""
    sizes = {"de": 9, "en": 60, None: 33, "": 2, "é": 1}
    rows = [(7 * i + k, f"s{i}", lang, None if i % 4 == 0 else i, "x" * i)
            for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(df.repartition(3), COLUMNS, fanout=fanout, block=block)
    assert got(found) == want(rows, fanout)
    folded = found.select("root", merkle.fold(F.col("leaf"), F.col("lefts"), F.col("rights")).alias("folded"))
    assert all(r.root == r.folded for r in folded.collect())


def test_edge_rows(spark, edge, none):
    rows = [tuple(r[c] for c in COLUMNS) for r in edge.collect()]
    assert got(merkle.manifest(edge, COLUMNS, block=2)) == want(rows, 2)
    assert merkle.manifest(none, COLUMNS).count() == 0
    one = edge.where("doc_id = 2")
    r = merkle.manifest(one, COLUMNS).first()
    assert r.leaf == r.subroot == r.root and r.lefts == r.rights == []
    long = spark.createDataFrame([(1, "ab" * 2_000_000)], "id long, text string").withColumn("leaf", F.lit("x"))
    r = merkle.manifest(long, ["id", "text"], "leaf", "id").first()
    assert r.root == leaf((1, "ab" * 2_000_000))


def test_a_changed_row_is_found(spark):
    """Every change of a leaf gives another root, and only that leaf is refused."""
    df = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"))
    shown = F.when(F.col("doc_id") == 17, merkle.leaf_hash(F.lit(18), F.col("lang")))
    made = merkle.manifest(df, ["doc_id", "lang"], carry={"shown": shown}, block=4)
    refused = made.where(merkle.fold(F.coalesce("row.shown", "leaf"), F.col("lefts"), F.col("rights")) != F.col("root"))
    assert [r.row.id for r in refused.collect()] == [17]


def test_rounds_swap_redundantly(spark):
    """After the rounds every block has the subroot, and no other rows were made."""
    rows = spark.range(37).select(F.lit(0).alias("all"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"),
                                  F.struct("id").alias("row"))
    trees = merkle.forest(rows, ["all"], ["row.id"], 2, block=2)
    upper = trees.upper.collect()
    assert len(upper) == 19 and len({r.node for r in upper}) == 1
    assert {len(r.lefts) for r in upper} == {5}
