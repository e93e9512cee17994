"""Each operator against a brute-force version on small input."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from souk.llm import adapt_join, bpe_automaton, hd_language, line_quality, mil_quality
from souk.llm import packing, queries, reply_trees, secret_scan, syncmers, training_order
from tests.conftest import SF_SMALL

GAP = re.compile("[ \t-\r]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()


def test_op1_equals_the_library(spark, edge, none):
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    got = bpe_automaton.decode(bpe_automaton.encode(edge, queries.BYTE_BPE), queries.BYTE_BPE)
    want = Counter()
    for r in edge.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got.collect()) == want
    assert bpe_automaton.encode(none, queries.BYTE_BPE).count() == 0
    for r in queries.op1_bpe_automaton(spark, SF_SMALL).collect():
        assert r.n_tokens > 0 and len(r.ids_sha256) == 64


def test_op1_whole_table_equals_the_library(spark):
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    tok.encode_special_tokens = False
    want = {}
    for r in documents(spark):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in queries.op1_bpe_automaton(spark, SF_SMALL).collect()}
    assert got == want


def test_op1_random_merges_with_equal_labels():
    """Any list of merges, also two that give the same label, encodes as merging by
    rank does: the lowest pair first, from left to right."""
    import random
    rng, refused = random.Random(5), 0
    for _ in range(80):
        names, merges = ["a", "b", "c"], []
        for _ in range(rng.randrange(2, 14)):
            pair = rng.choice(names), rng.choice(names)
            if pair not in merges and len(pair[0] + pair[1]) <= 8:
                merges.append(pair)
                if pair[0] + pair[1] not in names:
                    names.append(pair[0] + pair[1])
        if rng.random() < 0.5:   # the same label from other parts
            merges += [m for m in (("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")) if m not in merges]
            names += [x for x in ("ab", "bc", "abc") if x not in names]
        ids, rank = {x: i for i, x in enumerate(names)}, {m: i for i, m in enumerate(merges)}
        try:
            auto = bpe_automaton.Automaton({i: x.encode() for x, i in ids.items()},
                                           [(ids[u], ids[v], ids[u + v]) for u, v in merges], {})
        except ValueError:
            refused += 1
            continue
        enc = bpe_automaton.Encoder(auto)
        for _ in range(150):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            parts = list(word)
            while True:
                pairs = [rank.get(p, len(rank)) for p in zip(parts, parts[1:])]
                if not pairs or min(pairs) == len(rank):
                    break
                u, v = merges[min(pairs)]
                i = 0
                while i + 1 < len(parts):
                    if (parts[i], parts[i + 1]) == (u, v):
                        parts[i:i + 2] = [u + v]
                    i += 1
            assert enc.encode_word(word.encode()) == [ids[p] for p in parts], (merges, word)
    assert refused < 20


def test_op1_arcs_are_those_of_merging():
    """Small automaton: the accepted split is what merging by rank gives."""
    merges = [("a", "b"), ("ab", "a"), ("b", "b"), ("a", "a"), ("aba", "bb"), ("aa", "aa")]
    names = ["a", "b"]
    for u, v in merges:
        names.append(u + v)
    ids = {x: i for i, x in enumerate(names)}
    auto = bpe_automaton.Automaton({i: x.encode() for x, i in ids.items()},
                                   [(ids[u], ids[v], ids[u + v]) for u, v in merges], {})
    enc = bpe_automaton.Encoder(auto)
    for n in range(1, 2 ** 10):
        word = bin(n)[2:].replace("0", "a").replace("1", "b")
        parts = list(word)
        for u, v in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i:i + 2] = [u + v]
                i += 1
        assert enc.encode_word(word.encode()) == [ids[p] for p in parts], word


def test_op2_every_slot_once_and_resumable(spark, edge, none, tmp_path):
    for count in (1, 2, 7, 1000):
        slots = training_order.feistel_slots(np.arange(count), count, 5)
        assert sorted(slots.tolist()) == list(range(count))
    rows = training_order.write_shards(edge, queries.WORD_BPE, str(tmp_path / "s"), length=64,
                                       shard_records=16).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    read = list(training_order.read_records(spark, str(tmp_path / "s"), 3, len(rows), 64))
    assert len(read) == len(rows) - 3
    by_slot = {r.slot: r for r in rows}
    for i, record in enumerate(read):
        assert zlib.crc32(record.astype("<u2").tobytes()) == by_slot[i + 3].ids_crc32
    tok = Tokenizer.from_file(queries.WORD_BPE)
    total = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
                for r in edge.collect())
    assert sum(r.n_tokens for r in rows) == total
    assert training_order.write_shards(none, queries.WORD_BPE, str(tmp_path / "e")).count() == 0


def test_op2_written_once_and_alike_again(spark, edge, tmp_path):
    """The shards are there on return, a second action writes nothing, and another
    run of the same tasks leaves the same bytes."""
    def shards(folder):
        return {p: p.stat().st_mtime_ns for p in folder.glob("shard-*")}

    made = training_order.write_shards(edge, queries.WORD_BPE, str(tmp_path / "a"), length=64, shard_records=16)
    files = shards(tmp_path / "a")
    named = {tmp_path / "a" / r.file for r in made.collect()}
    assert named == set(files) and made.limit(1).count() == 1
    assert shards(tmp_path / "a") == files
    again = training_order.write_shards(edge, queries.WORD_BPE, str(tmp_path / "b"), length=64, shard_records=16)

    def by_shard(rows, folder):
        return {r.shard: (folder / r.file).read_bytes() for r in rows.collect()}

    assert by_shard(made, tmp_path / "a") == by_shard(again, tmp_path / "b")
    with pytest.raises(Exception, match="exist"):
        training_order.write_shards(edge, queries.WORD_BPE, str(tmp_path / "a"))


def test_op2_wide_ids_and_schemes(spark, edge, tmp_path):
    """Ids beyond 16 bits are written in 32, and folders of other schemes are refused."""
    spec = bpe_automaton.read_spec(queries.WORD_BPE)
    assert training_order.id_code(spec, 2) == "H" and training_order.id_code(spec, 1 << 16) == "I"
    rows = training_order.write_shards(edge, queries.WORD_BPE, f"file:{tmp_path}/w", length=32, end_id=70_000).collect()
    read = list(training_order.read_records(spark, f"file:{tmp_path}/w", 0, len(rows), 32, "I"))
    assert sum((r == 70_000).sum() for r in read) == edge.count()
    assert {r.byte_offset % (32 * 4) for r in rows} == {0}
    with pytest.raises(Exception):
        training_order.write_shards(edge, queries.WORD_BPE, "nosuch://bucket/x")


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(text: str) -> list:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_op3_spans(spark, edge, none):
    want = {r.doc_id: base_spans(r.text or "") for r in documents(spark)}
    for r in queries.op3_secret_scan(spark, SF_SMALL).collect():
        names = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want[r.doc_id])
        assert r.base_sha256 == sha(names) and set(names.split(",")) <= {*r.spans.split(","), ""}
    got = secret_scan.scan(edge)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in edge.collect())
    assert [len(r.spans) for r in got.where("doc_id = 9").collect()] == [1, 1]
    assert secret_scan.scan(none).count() == 0


def test_op3_copied_values_are_told_from_live_ones(spark):
    token = "Ab3" + "xY9k" * 6
    rows = [(i, f"use {token} now", f"s{i}") for i in range(3)] + [(9, f"own Q{token}7 key", "s9")]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    spans = {r.doc_id: [(x.kind, x.copied) for x in r.spans] for r in got.collect()}
    assert spans == {0: [], 1: [], 2: [], 9: [(3, False)]}
    out = spark.range(1).select(secret_scan.redact(F.lit("ab cd ef"), F.expr(
        "array(named_struct('start', 3, 'end', 5), named_struct('start', 4, 'end', 6))")).alias("t"))
    assert out.first().t == "ab [SECRET]ef"


def test_op4_held_out_accuracy(spark, edge, none):
    rows = queries.op4_hd_language(spark, SF_SMALL).collect()
    langs = {r.doc_id: r.lang for r in documents(spark)}
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    learned = hd_language.learn(edge)
    got = hd_language.predict(edge, learned).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in edge.collect())
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2))
    assert all(r.lang_pred == "und" for r in hd_language.predict(edge, hd_language.learn(none)).collect())


def test_op5_likeness_and_edits(spark, edge, none):
    rows = sorted(documents(spark), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in queries.op5_closed_syncmers(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for r, after in zip(rows, rows[1:] + rows[:1]):
        n = len(r.text) // 2
        edited = r.text[:len(r.text) - n] + after.text[:n]
        assert got[r.doc_id].edited_sha256 == sha(edited)
        assert got[r.doc_id].fingerprint == syncmers.fingerprint_text(syncmers.anchors(r.text))
        assert got[r.doc_id].n_chars == len(r.text)
    assert Counter(r.doc_id for r in syncmers.fingerprints(edge).collect()) == Counter(
        r.doc_id for r in edge.collect())
    assert syncmers.fingerprints(none).count() == 0
    rng = np.random.default_rng(1)
    for _ in range(200):  # the longest common run, by the plain table
        a, b = rng.integers(0, 6, 9).astype("u4"), rng.integers(0, 6, 7).astype("u4")
        t = np.zeros((10, 8), int)
        for i in range(9):
            for j in range(7):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert syncmers.likeness(a, b) == pytest.approx(2 * t[9, 7] / 16)


def components_by_force(rows, percent=90):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = [x for x in GAP.split((r.text or "").translate(table)) if x]
        sets.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    named = [i for i in range(len(rows)) if rows[i].doc_id is not None and sets[i]]
    for i in named:
        for j in named:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i in named:
        least[find(i)] = min(least[find(i)], rows[i].doc_id)
    return Counter((r.doc_id, len(s), least[find(i)] if i in set(named) else r.doc_id)
                   for i, (r, s) in enumerate(zip(rows, sets)))


def test_op6_equals_all_pairs(spark, edge, none, monkeypatch):
    words = " ".join(f"w{i}" for i in range(120)).split()
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(60):  # a group of near copies, more than a list holds
        w = list(words)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            w[at] = f"x{rng.integers(0, 999)}"
        texts.append(" ".join(w))
    group = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(adapt_join, "BLOCK", 16)
    monkeypatch.setattr(adapt_join, "SMALL_LIST", 8)
    for docs in (edge.select("doc_id", "text"), group, edge.select("doc_id", "text").union(group)):
        got = adapt_join.similar_components(docs).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_force(
            docs.collect())
    assert adapt_join.similar_components(none).count() == 0


def test_op6_texts_joined_by_a_shuffle(spark, edge, monkeypatch):
    """More needed texts than may be broadcast, in pairs and in cells."""
    monkeypatch.setattr(adapt_join, "FILTER_ROWS", 0)
    monkeypatch.setattr(adapt_join, "SMALL_LIST", 3)
    docs = edge.select("doc_id", "text").union(spark.range(50, 80).selectExpr(
        "id", "concat('a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ', id div 3)"))
    got = adapt_join.similar_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_force(docs.collect())


def test_op4_equal_cosines_take_the_first_language(spark, edge):
    learned = hd_language.learn(spark.createDataFrame(
        [(i, "some plain words here", x) for i, x in enumerate(["zz", "aa", "mm"])],
        "doc_id long, text string, lang string"))
    assert learned["aa"] == learned["zz"]
    found = {r.doc_id: r for r in hd_language.predict(edge, learned).collect()}
    assert found[3].lang_pred == "aa" and found[1].lang_pred == "und"


def test_op4_learns_the_same_documents_in_salts(spark):
    """The k least by hash of each language, whatever the salts."""
    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = hd_language.learn(docs, per_language=7)
    least = docs.select("*", F.xxhash64("doc_id").alias("h")).collect()
    chosen = [r.doc_id for x in "ab" for r in sorted((r for r in least if r.lang == x), key=lambda r: r.h)[:7]]
    assert few == hd_language.learn(docs.where(F.col("doc_id").isin(chosen)))


def test_op7_defined_cases(spark, edge, monkeypatch):
    """Text ids, labels that repeat (their mean counts, 0.5 as 1), and bags of bounded size."""
    monkeypatch.setattr(mil_quality, "FIT_PASSAGES", 4)
    good, bad = "plain words make a sentence. " * 200, "#### $$$ |||| 1234 " * 200
    docs = spark.createDataFrame([(f"g{i}", good + str(i)) for i in range(12)] + [(f"b{i}", bad + str(i)) for i in range(12)],
                                 "doc_id string, text string")
    labels = spark.createDataFrame(
        [(f"g{i}", x) for i in range(12) for x in (1, 0)] + [(f"b{i}", 0) for i in range(12)], "doc_id string, quality int")
    model = mil_quality.learn(docs, labels)
    found = {r.doc_id: r.score for r in mil_quality.score(docs, model).collect()}
    assert min(found[f"g{i}"] for i in range(12)) > max(found[f"b{i}"] for i in range(12))
    scores = mil_quality.score(edge, model).collect()
    assert len(scores) == edge.count() and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if r.doc_id in (0, 1)}) == 1


def test_op7_held_out(spark, edge, none):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    rows = [r for r in queries.op7_mil_quality(spark, SF_SMALL).collect()]
    right = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert sum(right) >= 0.9 * len(right)
    assert mil_quality.learn(none, none.selectExpr("doc_id", "1 as quality")) is None
    got = mil_quality.score(edge, None).collect()
    assert len(got) == edge.count() and all(r.score == 0.5 for r in got)


def test_op8_round_trip_and_branches(spark):
    for text in ("", "<|im_end|>", "<\\|x", "a<\\\\|im_start|>b", "<<||"):
        formatted, mask = reply_trees.format_turns([("us\ner\\n", text), ("assistant", text)])
        assert reply_trees.parse_turns(formatted) == [("us\ner\\n", text), ("assistant", text)]
        assert [reply_trees.unescape(formatted[a:b]) for a, b in mask] == [text]
    got = {r.conv_id: r for r in queries.op8_reply_trees(spark, SF_SMALL).collect()}
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-1] = [(0, "user", queries.ESCAPE_PROBE), (1, "assistant", queries.ESCAPE_PROBE)]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert got[c].loss_sha256 == sha(loss)
    # 1 -> 2 -> 4 and 1 -> 3; parent 9 is missing, parent 6 is not earlier
    nodes = spark.createDataFrame(
        [("t", 1, None, 0.0, "user", "a"), ("t", 2, 1, 1.0, "assistant", "b"),
         ("t", 3, 1, 5.0, "assistant", "c"), ("t", 4, 2, 0.0, None, None),
         ("u", 5, 9, 1.0, "user", "x"), ("u", 6, 6, 2.0, "user", "y")],
        "tree string, node long, parent long, score double, role string, text string")
    paths = {(r.tree, r["rank"]): [x.text for x in r.turns] for r in
             reply_trees.read_back(reply_trees.format_paths(nodes, branches=2)).collect()}
    assert paths == {("t", 1): ["a", "c"], ("t", 2): ["a", "b", ""], ("u", 1): ["y"], ("u", 2): ["x"]}


def test_op8_defined_cases(spark):
    """NULL conversations and roles, repeated turns, clashing columns, an empty table."""
    rows = [(None, 0, "user", "n"), (None, 1, "assistant", None), (7, 0, "user", "a"), (7, 0, "user", "a"),
            (7, 1, None, "b"), (7, 1, "assistant", "c" * 200_000), (8, None, "user", "d")]
    messages = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                     "conv_id long, turn long, role string, text string, tree string, node int")
    got = reply_trees.read_back(reply_trees.format_paths(reply_trees.number_turns(
        messages.select("conv_id", "turn", "role", "text")))).collect()
    texts = {r.tree.conv: sorted(x.text for x in r.turns) for r in got}
    assert texts == {None: ["", "n"], 7: sorted(["a", "a", "b", "c" * 200_000]), 8: ["d"]}
    empty = messages.select("conv_id", "turn", "role", "text").limit(0)
    assert reply_trees.format_paths(reply_trees.number_turns(empty)).count() == 0


def base_rules(text: str) -> tuple:
    w = [x for x in GAP.split(text) if x]
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if GAP.sub("", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside),
            len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_op9_base_rules_and_lines(spark, edge, none):
    for docs in (edge, spark.read.parquet(f"{SF_SMALL}/documents.parquet")):
        want = Counter((r.doc_id, *base_rules(r.text or "")) for r in docs.collect())
        got = line_quality.line_quality(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                        r.n_repeat_words, r.base_failed) for r in got) == want
    assert line_quality.line_quality(none).count() == 0
    body = [" ".join(f"d{d}w{i}" for i in range(60)) for d in range(12)]
    rows = [(d, f"Shared  Head\n{t}", "h") for d, t in enumerate(body)] + [
        (50 + d, "\n".join(["shared head"] * 40) + "\n" + " ".join(f"z{d}q{i}" for i in range(30)), "h")
        for d in range(2)]
    got = {r.doc_id: r for r in line_quality.line_quality(spark.createDataFrame(
        rows, "doc_id long, text string, source string")).collect()}
    assert all(got[d].kept and got[d].drop_lines == [0] for d in range(12))
    assert not got[50].kept and got[50].removed_words == 80


def test_op10_pieces(spark, edge, none):
    tok = Tokenizer.from_file(queries.WORD_BPE)
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
           for r in docs.collect()}
    rows = packing.pack(docs, queries.WORD_BPE).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert bytes(r.ids) == ids[r.doc_id][r.start:r.start + r.length].tobytes()
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for groups, whole in ((parts, True), (sequences, False)):
        for name, pieces in groups.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at
                at += length
            assert at == len(ids[name]) if whole else at <= 4096
    assert packing.pack(none, queries.WORD_BPE).count() == 0
    assert packing.pack(edge, queries.WORD_BPE).select("doc_id").distinct().count() == 13


def test_pipeline_stages(spark, edge, none):
    import corpus_pipeline as p
    for docs in (edge, none):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, SF_SMALL)
            assert tuple(out.columns) == p.COLUMNS and out.count() <= docs.count(), name
    kept = {r.doc_id for r in p.duplicate_stage(spark, edge, SF_SMALL).collect()}
    assert {3, 6, 0, 1, 2, None} <= kept and not {4, 5, 7} & kept
    clean = p.secret_stage(spark, edge, SF_SMALL).where("doc_id = 9").first()
    assert clean.text == "[SECRET]' x" and clean.n_chars == len(clean.text)
    assert p.run(spark, SF_SMALL).count() > 0
