"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles
is at least ``PERCENT``. Documents of equal sets are one class; classes are
joined, never copies.

Order. A set's tokens are ordered rare first: tokens found often while the
texts are read (the ``HOT_TOKENS`` most frequent of those that came up at least
three times in one stretch of a partition) come last, by frequency; all others
by hash. Any common order gives the same links; this one keeps frequent tokens
out of the prefixes.

Prefixes. With n tokens, at least t = ceil(0.9 n) of which any partner shares,
two partners have at least l tokens in common in their first n - t + l tokens.
A document whose tokens lead to many others (the estimated candidate cost, the
partners in its tokens' lists) takes a longer prefix and asks for more matches, up
to ``LEVELS`` and never more than t; a pair uses the smaller of its two levels. Pairs that their
sizes or the places of a common token rule out are not made.

Lists. A token has a list for each band of sizes: the documents of that band and of
the next smaller one, as partners' sizes are no further apart; two documents meet in
the larger one's band only. A list of up to ``SMALL_LIST`` documents gives pairs, which are
counted. Longer lists (groups of near copies, and in a large table unlike texts
that share a token) give no pairs: all of a list's documents go to
the cell of the list's least document, cells are cut into blocks of ``MARKED``, and
two blocks are compared at once. Every pair that shares a prefix token meets in a
list or cell, so no link between different texts is lost.

Marks. What meets is first compared by marks: the parity of a set's tokens in
each of about n places (``parities``). Two marks differ in no more places than the
sets have tokens that only one of them has, so marks that differ in more than a
link allows rule a pair out, and only what is left is compared by its whole
texts: marks are a small part of a text, and unlike texts never travel.

Two turns. First the texts of pairs that look alike by their marks are compared, one
pair a document at most from the lists, and from the cells enough pairs to join what
looks alike. Then only pairs that their marks allow and that are not in one
component yet are left: those of lists one by one, those of cells in blocks of
``BLOCK`` whole texts, of which a task compares two at once. So a group of near
copies costs texts in proportion to its size; only documents whose likeness to
others is close below the limit cost texts times the number of their blocks.

Broadcast are at most ``HOT_TOKENS`` numbers and ``FILTER_ROWS`` id pairs. Links and components stay
distributed; each step that is used twice is written to the shared scratch
folder.

Defined cases: a NULL text, or one without words, has no shingles, links with
nothing and is its own component; with fewer words than a shingle has, the
whole sequence is one; a row without id is in no component (component_id NULL)
and links nothing; repeated rows and rows of one id are documents of their own,
in the component of their text; an empty table gives no rows; other columns of
the input are ignored. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import digest128, ship, stored
from souk.llm.components import components
from souk.llm.syncmers import _mixed

WORDS = 3              # words of a shingle
PERCENT = 90           # least similarity
LEVELS = 6             # most matches asked for
COSTS = (0, 2, 8, 32, 128)  # one match more is asked for above each estimated cost
HOT_TOKENS = 200_000   # frequent tokens that are put last (1.6 MB to broadcast)
STRETCH = 3_000_000    # tokens counted at once while reading
SMALL_LIST = 64        # documents of a list that are paired one by one
MARKED = 4_096         # documents of a cell's block that are compared by their marks
MARK_BITS = 32_768     # places of a mark at most
FEW = 64               # documents whose marks are compared all at once
BLOCK = 512            # documents of a cell's block that are compared by their texts
PREFIX_ROWS = 50       # tokens of a prefix, about: what a class counts in the number of files
FILTER_ROWS = 1_000_000  # (class, document) rows that may be broadcast: 16 MB


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    x = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    x = np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint8)
    inside = ~((x == 32) | (x >= 9) & (x <= 13))
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(x) else x[:0]
    if not len(starts):
        return np.zeros(0, np.int64)
    last = np.zeros(len(x), np.int64)
    last[starts] = starts
    place = np.arange(len(x)) - np.maximum.accumulate(last)
    mixed = np.where(inside, _mixed((x + 256 * place + 1).astype(np.uint64)), np.uint64(0))
    word = _mixed(np.add.reduceat(mixed, starts))
    size = min(words, len(word))
    out = np.full(len(word) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + word[k:len(word) - size + 1 + k])
    return np.unique(out.view(np.int64))


def set_id(tokens: np.ndarray) -> int | None:
    """The class of a set: a hash of its tokens (None: empty)."""
    if not len(tokens):
        return None
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def _rows(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for at in range(0, b.num_rows, 500):  # strings of a whole batch would be many
            yield from zip(*(c.to_pylist() for c in b.slice(at, 500).columns))


def sets_and_counts(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, row_a, row_b, id, n) per document and (token, seen) per frequent
    token (stored); ``docs`` has doc_id, text and the row's digest row_a, row_b."""
    names = ["doc_id", "row_a", "row_b", "id", "n", "token", "seen"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, out = [], 0, []

        def due(force: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if out and (force or len(out) >= 2_000):
                none = pa.nulls(len(out), pa.int64())
                made = [pa.array(c, pa.int64()) for c in zip(*out)]
                out.clear()
                yield pa.RecordBatch.from_arrays([*made, none, none], schema=schema)
            if held and (force or size >= STRETCH):
                tokens = np.concatenate(held)
                held, size = [], 0
                tokens, seen = np.unique(tokens, return_counts=True)
                often = seen >= 3
                tokens, seen = tokens[often], seen[often].astype(np.int64)
                none = pa.nulls(len(tokens), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, none, pa.array(tokens), pa.array(seen)], schema=schema)

        for doc, text, a, b in _rows(batches):
            tokens = shingles(text, words)
            out.append((doc, a, b, set_id(tokens), len(tokens)))
            held.append(tokens)
            size += len(tokens)
            yield from due(False)
        yield from due(True)

    return stored(docs.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "shingle-sets")


def parities(tokens: np.ndarray) -> bytes:
    """The mark of a set: for each place whether an odd number of tokens falls on it. Places
    are a power of two, so the halves of a longer mark make a shorter one."""
    places = max(64, min(MARK_BITS, 1 << (len(tokens) - 1).bit_length()))
    odd = np.bincount(tokens & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(mark: bytes, size: int) -> bytes:
    while len(mark) > size:
        both = np.frombuffer(mark, np.uint8).reshape(2, -1)
        mark = (both[0] ^ both[1]).tobytes()
    return mark


def prefixes(docs: DataFrame, hot: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, id, n, mark, tokens): the first tokens of each set in the common order."""
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, cols = b.slice(at, 500), ([], [], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tokens = shingles(text, words)
                    n = len(tokens)
                    if not n or doc is None:
                        continue
                    key, mark = set_id(tokens), parities(tokens)
                    if len(hot):
                        place = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                        often = hot[place] == tokens
                        last = tokens[often][np.argsort(rank[place[often]])]
                        tokens = np.concatenate([tokens[~often], last])
                    least = (percent * n + 99) // 100
                    for col, v in zip(cols, (doc, key, n, mark, tokens[:n - least + LEVELS])):
                        col.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in cols[:3]),
                         pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.int64()))],
                        ["doc_id", "id", "n", "mark", "tokens"])

    return docs.mapInArrow(run, "doc_id long, id long, n long, mark binary, tokens array<long>")


def whole_texts(docs: DataFrame, needed: DataFrame, repeated: bool) -> DataFrame:
    """(id, text) of the classes in ``needed`` (id, doc_id) (stored).

    Up to ``FILTER_ROWS`` needed rows are broadcast to the scan; more are joined
    by a shuffle. Texts are kept rather than sets: they compress, hashes do not.
    """
    if needed.count() <= FILTER_ROWS:
        needed = F.broadcast(needed)
    found = docs.join(needed, "doc_id").select("id", "text")
    return stored(found.dropDuplicates(["id", "text"]) if repeated else found, "join-texts")


def _lists(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (id, n, at, token) with (band, upper, list, partners) for each list that they are
    in with a partner: upper, if the band is that of the document's own size. The rows are dealt by token."""
    token, band = Window.partitionBy("token"), Window.partitionBy("token", "band")
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    met = (rows.withColumn("found", F.count(F.lit(1)).over(token)).where("found > 1").drop("found")
           .withColumn("own", own).withColumn("band", F.explode(F.array(own, own + 1)))
           .withColumn("upper", F.col("band") == F.col("own")).drop("own"))
    listed = met.withColumn("list", F.count(F.lit(1)).over(band)).withColumn(
        "uppers", F.sum(F.col("upper").cast("int")).over(band))
    partners = F.when(F.col("upper"), F.col("list") - 1).otherwise(F.col("uppers"))
    return listed.withColumn("partners", partners).where("partners > 0").drop("uppers")


def _pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (u, v) from the small lists, after the multi-match count."""
    names = ("id", "n", "at", "level", "asked", "upper")
    a = shared.select("token", "band", *(F.col(c).alias(f"{c}_a") for c in names))
    b = shared.select("token", "band", *(F.col(c).alias(f"{c}_b") for c in names))
    both, asked = F.col("n_a") + F.col("n_b"), F.least("asked_a", "asked_b")
    # of the first ``asked`` common tokens, up to asked - 1 stand before this one
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    possible = ((F.col("id_a") < F.col("id_b")) & (F.col("upper_a") | F.col("upper_b"))
                & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
                & ((100 + percent) * (rest + asked - 1) >= percent * both)
                & (F.greatest("level_a", "level_b") <= asked))
    return (a.join(b, ["token", "band"]).where(possible)
            .groupBy(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
            .agg(F.count(F.lit(1)).alias("matches"), F.first(asked).alias("asked"))
            .where("matches >= asked").select("u", "v"))


def _like(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(u, v, near): the pairs that their marks allow; near: they look alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for u, v, n, x, y in _rows([b]):
                size = min(len(x), len(y))
                differ = (int.from_bytes(_folded(x, size)) ^ int.from_bytes(_folded(y, size))).bit_count()
                if (100 + percent) * differ <= (100 - percent) * n:
                    kept.append((u, v, bool(differ <= _expected(n, 8 * size, percent))))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kept)], ["u", "v", "near"])

    both = pairs
    for c in ("u", "v"):
        both = both.join(marks.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"),
                                      F.col("mark").alias(f"mark_{c}")), c)
    return both.select("u", "v", (F.col("n_u") + F.col("n_v")).cast("long"), "mark_u", "mark_v").mapInArrow(
        run, "u long, v long, near boolean")


def _expected(both, places: int, percent: int):
    """Places in which marks differ on the average at the least similarity; ``both``: the
    sizes of the two sets together."""
    return places / 2 * -np.expm1(-2 / places * (100 - percent) / (100 + percent) * both)


def _members(shared: DataFrame) -> DataFrame:
    """(cell, band, id, upper): the documents of long lists by cell."""
    rows = shared.select("token", "band", "id", "upper")
    least = rows.groupBy("token", "band").agg(F.min("id").alias("cell"))
    return rows.join(least, ["token", "band"]).select("cell", "band", "id", "upper").distinct()


def _blocks(member: DataFrame, most: int) -> DataFrame:
    """``member`` (cell, band, id, ...) with (first, second, own), once for each two blocks of its
    cell that a document is in one of; cells of one document are left out."""
    sizes = (member.groupBy("cell", "band").agg(F.count(F.lit(1)).alias("size"))
             .where("size > 1").withColumn("blocks", F.ceil(F.col("size") / most).cast("int")))
    own = member.join(sizes, ["cell", "band"]).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (own.withColumn("other", other).withColumn("first", F.least("own", "other"))
            .withColumn("second", F.greatest("own", "other")).drop("size", "blocks", "other"))


def _look_alike(n, upper, side, root, marks: list[bytes], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of the documents of two blocks (of one, if all have the same ``side``): pairs, enough to join
    what looks alike, and which documents have another that their marks allow. Documents of one
    ``root``, or neither of them ``upper``, are not compared."""
    size = min(map(len, marks))
    bits = np.frombuffer(b"".join(_folded(m, size) for m in marks), np.uint64).reshape(len(marks), -1)
    group, pairs, allowed = np.arange(len(n)), [], np.zeros(len(n), bool)

    def meet(x: int, others: np.ndarray, told: bool) -> None:
        others = others[(root[others] != root[x]) & (upper[others] | upper[x])]
        if not told:
            others = others[group[others] != group[x]]
        differ = np.bitwise_count(bits[others] ^ bits[x]).sum(axis=1, dtype=np.int64)
        both = n[others] + n[x]
        if told:
            ok = (100 + percent) * differ <= (100 - percent) * both
            others, differ, both = others[ok], differ[ok], both[ok]
            allowed[others] = True
            allowed[x] |= len(others) > 0
        for y in others[differ <= _expected(both, 8 * size, percent)].tolist():
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                if told:
                    pairs.append((x, y))

    every = np.arange(len(n))
    if side[0] != side[-1]:  # what looks alike within a block is paired where it is compared with itself
        blocks = [every[side == side[0]], every[side != side[0]]]
        for some in blocks:
            for k, x in enumerate(some.tolist()):
                meet(x, some[k + 1:], False)
        for x in blocks[0].tolist():
            meet(x, blocks[1], True)
    elif len(n) > FEW:
        for x in range(len(n) - 1):
            meet(x, every[x + 1:], True)
    else:
        differ = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
        ok = ((100 + percent) * differ <= (100 - percent) * (n[:, None] + n[None])) & (root[:, None] != root[None])
        for x in np.flatnonzero(ok.any(axis=1)).tolist():
            meet(x, x + 1 + np.flatnonzero(ok[x, x + 1:]), True)
    return pairs, allowed


def _compared(blocks: DataFrame, percent: int) -> DataFrame:
    """Of ``blocks`` (cell, band, first, second, own, id, n, upper, root, mark): rows (u, v) of pairs that
    look alike, and rows (cell, band, id) of documents that their marks allow to be like another."""
    keys = ["cell", "band", "first", "second"]
    columns = [*keys, "own", "id", "n", "upper", "root", "mark"]
    schema = pa.schema([(c, pa.int64()) for c in ("u", "v", "cell", "band", "id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            held.append(b)
            yield from found(held, False)
        yield from found(held, True)

    def found(held: list, ended: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        col = {c: rows.column(c).to_numpy() for c in columns[:-1]}
        new = np.zeros(max(0, rows.num_rows - 1), bool)
        for c in keys:
            new |= col[c][1:] != col[c][:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()][:rows.num_rows]
        if not ended and cuts:  # the last ones may go on in the next batch
            held.extend(rows.slice(cuts[-1]).to_batches())
        elif cuts:
            cuts.append(rows.num_rows)
        marks, pairs, docs = rows.column("mark").to_pylist(), [], []
        for at, to in zip(cuts, cuts[1:]):
            if to - at < 2:
                continue
            n, upper, side, root, ids = (col[c][at:to] for c in ("n", "upper", "own", "root", "id"))
            linked, allowed = _look_alike(n, upper, side, root, marks[at:to], percent)
            pairs += [(ids[x], ids[y]) for x, y in linked]
            docs += [(col["cell"][at], col["band"][at], i) for i in ids[allowed]]
        none = [None] * 3
        out = [(min(p), max(p), *none) for p in pairs] + [(None, None, *d) for d in docs]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return (blocks.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "own")
            .mapInArrow(run, "u long, v long, cell long, band long, id long"))


def _own_sets(ids, texts, words: int) -> tuple[list[int], list[np.ndarray]]:
    """The sets of the texts that have the class they came under."""
    made = ((i, shingles(t, words)) for i, t in zip(ids, texts))
    kept = {i: s for i, s in made if set_id(s) == i}
    return list(kept), list(kept.values())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _block_links(pdf: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Enough verified links to join what two blocks hold together."""
    ids, sets = _own_sets(pdf["id"], pdf["text"], words)
    if len(sets) < 2:
        return pd.DataFrame([], columns=["u", "v"], dtype="int64")
    sizes = np.array([len(t) for t in sets], np.int64)
    kinds, which, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    twice = seen[which] > 1  # others are common to no two
    column = (np.cumsum(seen > 1) - 1)[which[twice]]
    owner, width = owner[twice], int((seen > 1).sum())
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, width, 8_192):
        some = (column >= at) & (column < at + 8_192)
        held = np.zeros((len(sets), min(8_192, width - at)), np.float32)
        held[owner[some], column[some] - at] = 1
        common += held @ held.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    left, links = set(range(len(sets))), []
    while left:
        front = [left.pop()]
        while front:
            x = front.pop()
            for y in np.flatnonzero(linked[x]).tolist():
                if y in left:
                    left.remove(y)
                    front.append(y)
                    links.append((ids[x], ids[y]))
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[int, np.ndarray] = {}  # pairs come sorted, so sets repeat
            kept = []
            for u, v, *both in _rows([b]):
                if len(held) > 1_000:
                    held.clear()
                for i, text in zip((u, v), both):
                    if not len(held.get(i, ())):  # an id's other text gave nothing
                        tokens = shingles(text, words)
                        held[i] = tokens if set_id(tokens) == i else tokens[:0]
                if len(held[u]) and len(held[v]) and _linked(held[u], held[v], percent):
                    kept.append((u, v))
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*kept)], ["u", "v"])

    return (pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
            .join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
            .select("u", "v", "text_u", "text_v").mapInArrow(verify, "u long, v long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("id")).union(pairs.select("v"))


def joined(docs: DataFrame, classes: DataFrame, hot: np.ndarray, words: int,
           percent: int, repeated: bool) -> DataFrame:
    """(node, root) of the classes that are linked to another; ``repeated``: some ids come twice."""
    width = PREFIX_ROWS * classes.count()
    first = classes.select("id", F.col("doc_id").alias("first"))
    heads = stored(prefixes(docs, hot, words, percent).join(first, "id")
                   .where("doc_id = first").dropDuplicates(["id", "doc_id"])  # the join's keys: no other shuffle
                   .select("id", F.col("n").cast("int").alias("n"), "mark", "tokens"), "join-prefixes", rows=width)
    marks = heads.select("id", "n", "mark")
    # dealt by token once, for the counts too
    rows = heads.select("id", "n", F.posexplode("tokens").alias("at", "token"))
    level = F.greatest(F.lit(1), F.col("at") - F.floor((100 - percent) * F.col("n") / 100) + 1)
    shared = stored(_lists(rows, percent).withColumn("level", level.cast("int")), "join-shared", rows=width)
    cost = shared.where("level = 1").groupBy("id").agg(F.sum("partners").alias("cost"))
    asked = F.lit(1)
    for c in COSTS:
        asked = asked + (F.coalesce("cost", F.lit(0)) > c).cast("int")
    least = F.col("n") - F.floor((100 - percent) * F.col("n") / 100)  # any partner shares so many
    shared_cost = shared.join(cost, "id", "left").withColumn(
        "asked", F.least(asked, least.cast("int")))
    pairs = stored(_pairs(shared_cost.where(F.col("list") <= SMALL_LIST), percent), "join-pairs", rows=width)
    pairs = stored(_like(pairs, marks, percent), "join-like", rows=width)
    cells = stored(_members(shared.where(F.col("list") > SMALL_LIST)), "join-cells", rows=width)

    def compared(member: DataFrame) -> DataFrame:
        return stored(_compared(_blocks(member, MARKED).join(marks, "id"), percent), "join-compared", rows=width)

    def texts(ids: DataFrame) -> DataFrame:
        return whole_texts(docs, classes.join(ids.distinct(), "id", "semi").select("id", "doc_id"), repeated)

    alike = compared(cells.withColumn("root", F.col("id")))
    tried = stored(pairs.where("near").groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
                   .union(alike.where("u is not null").select("u", "v")).distinct(), "join-tried", rows=width)
    found = components(_verified(tried, texts(_ends(tried)), words, percent), tried.count())

    root = {c: found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("u", "v", "id")}
    apart = F.coalesce("root_u", "u") != F.coalesce("root_v", "v")
    rest = stored(pairs.join(tried, ["u", "v"], "anti").join(root["u"], "u", "left").join(root["v"], "v", "left")
                  .where(apart).select("u", "v"), "join-rest", rows=width)
    member = (alike.where("id is not null").select("cell", "band", "id").distinct()
              .join(root["id"], "id", "left").withColumn("root", F.coalesce("root_id", "id")).drop("root_id"))
    several = member.groupBy("cell", "band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    member = member.join(several.where("low < high").select("cell", "band"), ["cell", "band"])
    still = compared(member.join(cells, ["cell", "band", "id"]))
    blocks = stored(_blocks(still.where("id is not null").select("cell", "band", "id").distinct(), BLOCK),
                    "join-blocks", rows=width)
    n_rest, n_blocks = rest.count(), blocks.count()
    if not n_rest + n_blocks:
        return found
    held = texts(_ends(rest).union(blocks.select("id")))
    in_cells = (blocks.join(held, "id").groupBy("cell", "band", "first", "second")
                .applyInPandas(lambda pdf: _block_links(pdf, words, percent), "u long, v long"))
    return components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))
                      .union(_verified(rest, held, words, percent)).union(in_cells),
                      found.count() + n_rest + n_blocks)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = WORDS, percent: int = PERCENT,
                       row: list[Column] | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, set_id (its class), component_id, component_set
    (the least class of its component) and row_a, row_b, a digest of ``row`` (columns of
    ``docs`` that tell rows apart; otherwise of id and text)."""
    ship(docs.sparkSession)
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    digested = docs.select(doc_id.alias("doc_id"), text.alias("text"), *digest128("row", *(row or [doc_id, text])))
    read = digested.select("doc_id", "text")
    seen = sets_and_counts(digested, words)
    each = seen.where("n is not null")
    classes = stored(each.where("id is not null and doc_id is not null").groupBy("id")
                     .agg(F.min("doc_id").alias("doc_id")), "shingle-classes", rows=each.count())
    # at most HOT_TOKENS numbers come to the driver
    often = (seen.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
             .orderBy(F.col("seen").desc(), "token").limit(HOT_TOKENS).toPandas())
    hot = often.sort_values(["seen", "token"])["token"].to_numpy(np.int64)  # rarest first
    repeated = not each.groupBy("doc_id").count().where("count > 1").isEmpty()
    found = joined(read, classes, hot, words, percent, repeated)
    named = (found.join(classes, found["node"] == classes["id"])
             .groupBy("root").agg(F.min("doc_id").alias("component")))
    rooted = (classes.join(found, classes["id"] == found["node"], "left").join(named, "root", "left")
              .select("id", F.coalesce("component", "doc_id").alias("component"),
                      F.coalesce("root", "id").alias("component_set")))
    return (each.join(rooted, "id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("id").alias("set_id"), "component_set", "row_a", "row_b",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))
