"""Byte-pair encoding and decoding with a merge-gadget automaton.

The automaton reads token labels. Its state after a label t is the set of
labels that may follow t in a finished encoding. It starts with one state and
a loop for every byte; the merges are then applied in their order, each as one
gadget. The gadget of merge (u, v) -> w at time r

* cuts the arc v out of the state after u (the pair would have merged),
* adds the arc w wherever there is an arc u (w's column is u's, as of r),
* makes the state after w the state after v (w's row is v's, as of r).

What a gadget leaves behind are three numbers for w (left part, right part,
time) and one cut. An arc (a, b) of the finished automaton is found by walking
the gadgets of a and b back in time to bytes; the arcs met are kept in a
transition table, so the walk is made once per pair. All 50,000 x 50,000 arcs
are never laid out.

The automaton accepts exactly one split of a word into labels, the encoding, and
also one of each of the word's prefixes. ``encode_word`` reads the word byte by
byte and keeps each prefix's last label, the automaton's state there. The labels
that end at a byte are found by one transition of a table over the labels' bytes
(the longest of them) and a chain from each label to the next shorter one that it
ends with; the first whose arc leaves the state before it is the next state. No
state is ever taken back: a word costs its bytes times the short chains. The last
labels, followed from the end, are the encoding. Decoding emits the labels of the
arcs taken.

A label's bytes have one derivation, so of two merges that give the same label
only the first one whose parts meet makes it. A list in which a label is made only
after a merge that uses it has no order of gadgets and raises.

Words repeat, and so do their beginnings: each Python worker keeps what it has encoded,
and the states of words' first bytes, in tables of bounded size: memory does not grow
with the corpus. Decoding reads the labels alone, no automaton.

Defined cases: a NULL text is encoded as an empty one (no ids); NULL ids decode
to an empty text; NULL document ids are kept; repeated rows each give a row; an
empty table gives no rows; other columns of the input are ignored. Bytes that
are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import ship, worker_tables

# White space as the tokenizer's pattern means it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
# The pre-splitting pattern of byte-level BPE.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+"
          r"|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+")
TABLE_LIMIT = 100_000   # entries of a worker's tables before they become the older ones
KEPT_CHARS = 40         # longer chunks are encoded each time
BEGUN = 7               # bytes of a word whose states are kept
ROWS = 200              # rows of an output batch


def byte_symbols() -> dict[str, int]:
    """Symbol of the vocabulary file -> byte: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_labels(spec: dict) -> tuple[dict[int, bytes], dict[str, int]]:
    """Bytes of the labels by id, and ids of the special tokens, of a vocabulary file."""
    symbols = byte_symbols()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    return {i: bytes(symbols[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in special}, special


class Automaton:
    """States, arcs and labels compiled from a vocabulary file's merges."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]],
                 special: dict[str, int]):
        self.labels, self.special = labels, special
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.gadgets, self.early = 0, set()
        for u, v, w in merges:
            self.add_gadget(u, v, w)
        # where a label's parts never meet, no encoding holds it
        self.ids = {label: t for t, label in labels.items() if self.is_made(t)}
        self._lay_out()

    def _lay_out(self) -> None:
        """Flat tables over the labels' bytes. A node is a prefix of labels: ``child``
        leads from (node, byte) to a node, ``back`` to the longest other node that a
        node ends with, ``ends`` to the longest label that it ends with (-1: none), and
        ``shorter`` from a label to the next shorter one that it ends with."""
        child: dict[int, int] = {}
        back, ends = [0], [-1]
        top = max(self.ids.values(), default=-1) + 1
        self.size, self.shorter = [0] * top, [-1] * top
        at = dict.fromkeys(self.ids, 0)   # node of each label's first bytes
        depth = 0
        while at:   # all nodes of one depth, then the next
            for label in at:
                key = at[label] << 8 | label[depth]
                if key not in child:
                    child[key] = len(ends)
                    shorter, before = key >> 8, 0
                    while shorter and not before:
                        shorter = back[shorter]
                        before = child.get(shorter << 8 | label[depth], 0)
                    back.append(before)
                    ends.append(ends[before])
                at[label] = child[key]
            depth += 1
            for label in [x for x in at if len(x) == depth]:
                node, t = at.pop(label), self.ids[label]
                self.size[t], self.shorter[t], ends[node] = depth, ends[back[node]], t
        self.child, self.back, self.ends = child, back, ends

    @classmethod
    def from_spec(cls, text: str) -> Automaton:
        """Compile the JSON text of a vocabulary file."""
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        labels, special = read_labels(spec)
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)

    def add_gadget(self, u: int, v: int, w: int) -> None:
        unmade = {x for x in (u, v) if not self.is_made(x)}
        self.early |= unmade
        if not unmade and w not in self.parts and self.has_arc(u, v):
            if w in self.early:
                raise ValueError(f"label {w} is made only after a merge that uses it")
            self.parts[w] = (u, v, self.gadgets)
            self.cut[u, v] = self.gadgets
        self.gadgets += 1

    def is_made(self, t: int) -> bool:
        """Whether a gadget so far (or a single byte) makes label t."""
        return t in self.parts or len(self.labels[t]) == 1

    def has_arc(self, a: int, b: int) -> bool:
        """Whether label b may follow label a in a finished encoding."""
        before = self.gadgets  # gadgets from this time on do not count
        byte = (-1, -1, -1)
        while True:
            if self.cut.get((a, b), before) < before:
                return False
            (_, a_right, a_time), (b_left, _, b_time) = (
                self.parts.get(a, byte), self.parts.get(b, byte))
            if a_time == b_time == -1:
                return True
            if b_time >= a_time:  # b's column came from its left part, after that cut
                b, before = b_left, b_time + 1
            else:                 # a's row came from its right part, before that cut
                a, before = a_right, a_time


class Encoder:
    """Table-driven encoding in one Python worker."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.arcs = _Table(self._arc)
        self.step = _Table(self._step)
        self.split = regex.compile(PIECES).findall
        self.begun = _Table(self._follow)
        self.words = _Table(lambda w: self.after_space[w[1:]] if w[0] == " " and w[1:].isalpha()
                            else _packed(self.encode_word(w.encode())))
        self.after_space = _Table(self._after_space)
        marks = sorted(map(re.escape, automaton.special), key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(marks) + ")") if marks else None
        self.inner_space = re.compile("(?<=[^" + SPACE + "]) ").split
        self.odd_space = re.compile("[" + SPACE + "] ").search

    def encode_word(self, word: bytes) -> list[int]:
        """The accepted path over ``word``, by one state per byte."""
        size = self.a.size
        begun = self.begun[word[:BEGUN]] if len(word) > BEGUN else (0, (-1,))
        states = self._follow(word, *begun)[1]
        at, path = len(word), []
        while at:
            label = states[at]
            path.append(label)
            at -= size[label]
        path.reverse()
        return path

    def _follow(self, word: bytes, node: int = 0, begun: Sequence[int] = (-1,)) -> tuple[int, list[int]]:
        """The node and all states after ``word``, whose first bytes led to ``node`` and ``begun``."""
        step, ends, size, shorter, arcs = self.step, self.a.ends, self.a.size, self.a.shorter, self.arcs
        states = [*begun]   # last label of each prefix's encoding; -1 before the word
        at = len(states) - 1
        for byte in word[at:]:
            at += 1
            node = step[node << 8 | byte]
            label = ends[node]
            while True:
                if label < 0:
                    raise ValueError(f"no label for byte {byte}")
                state = states[at - size[label]]
                if state < 0 or arcs[state << 32 | label]:
                    break
                label = shorter[label]
            states.append(label)
        return node, states

    def _step(self, key: int) -> int:
        """The longest node that the bytes so far, with the next one, end with."""
        child, back = self.a.child, self.a.back
        node, byte = key >> 8, key & 255
        while node and node << 8 | byte not in child:
            node = back[node]
        return child.get(node << 8 | byte, 0)

    def _arc(self, arc: int) -> bool:
        return self.a.has_arc(arc >> 32, arc & 0xFFFFFFFF)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def _after_space(self, part: str) -> bytes:
        """The ids of a space and ``part``, before another space or the end."""
        if part.isalpha():
            return _packed(self.encode_word((" " + part).encode()))
        if part[-1:] in {".", ","} and part[:-1].isalpha():   # always two pieces
            return self.after_space[part[:-1]] + self.words[part[-1]]
        return self._pieces(" " + part)

    def _plain(self, text: str) -> bytes:
        """A space after a non-space always begins a piece, so the text is cut
        there and equal cuts are looked up."""
        if not text:
            return b""
        odd = "  " in text or "\n " in text or (
            not text.isascii() or "\t " in text or "\r " in text
            or "\x0b " in text or "\x0c " in text) and self.odd_space(text)
        first, *parts = self.inner_space(text) if odd else text.split(" ")
        return self._pieces(first) + b"".join(map(self.after_space.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.marks is None or not any(m in text for m in self.a.special):
            return self._plain(text)
        return b"".join(
            _packed([self.a.special[x]]) if x in self.a.special
            else self._plain(x) for x in self.marks.split(text))


class Decoder:
    """The labels' bytes in one Python worker."""

    def __init__(self, labels: dict[int, bytes], special: dict[str, int]):
        symbols = {**labels, **{i: s.encode() for s, i in special.items()}}
        top = max(symbols, default=0) + 1
        self.sizes = np.array([len(symbols.get(i, b"")) for i in range(top)])
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(symbols.get(i, b"") for i in range(top)), "u1")

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ``ids`` cut at ``ends``: the labels' bytes, side by side."""
        sizes = self.sizes[ids]
        after = np.cumsum(sizes)
        from_ = np.repeat(self.begin[ids] - (after - sizes), sizes)
        out = self.flat[from_ + np.arange(len(from_))].tobytes()
        cuts = np.concatenate([[0], after])[ends]
        return [out[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class _Table(dict):
    """Remembers what ``make`` gives for a key; long texts are not kept. When full, the
    table becomes the older one, of which only what is asked for again is kept."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
            if isinstance(key, str) and len(key) > KEPT_CHARS:
                return made
        if len(self) >= TABLE_LIMIT:
            self.older = dict(self)
            self.clear()
        self[key] = made
        return made


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _kept(shared: Broadcast, name: str, make: Callable):
    """What ``make`` gives for the vocabulary file: made once by a worker, kept for later tasks."""
    key = name, hashlib.sha256(shared.value.encode()).digest()
    kept = worker_tables("automata")
    if key not in kept:
        kept[key] = make(shared.value)
    return kept[key]


def worker_encoder(shared: Broadcast) -> Encoder:
    """The worker's encoder, with its tables."""
    return _kept(shared, "bpe", lambda text: Encoder(Automaton.from_spec(text)))


def worker_decoder(shared: Broadcast) -> Decoder:
    return _kept(shared, "labels", lambda text: Decoder(*read_labels(json.loads(text))))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables hold millions of objects and no cycles
        try:
            encoder = worker_encoder(shared)
            for b in _sliced(batches):
                done = [encoder.encode(t) for t in b.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in done)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(done), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    ["doc_id", "ids"])
        finally:
            gc.enable()

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """``tokens`` (doc_id, ids) with the decoded ``text``."""
    ship(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_decoder(shared)
        for b in _sliced(batches):
            ids = b.column(1).fill_null(pa.scalar([], pa.list_(pa.int32())))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
            texts = decoder.decode(ids.flatten().to_numpy(), ends)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    read = tokens.select("doc_id", "ids")
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
