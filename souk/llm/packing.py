"""Bounded-space online packing of token sequences.

Each partition keeps at most ``open_windows`` windows of ``size`` tokens. A
document is cut into full windows and a rest; the rest goes to the open window
where it fits best. When it fits nowhere, the fullest window is emitted; if
more than ``slack`` of its tokens would stay empty, the head of the incoming
piece fills it first. At the end of the partition the open windows are merged:
laid end to end, cut into full windows, and the last tokens cut into
sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled. A partition's state is its open windows. A sequence's id
is the partition's number times 2^33 plus its number there, so a task that is
run again writes the same rows.

Defined cases: a NULL or empty text is one end token; NULL ids are kept;
repeated rows are packed each for itself; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.bpe_automaton import byte_symbols, read_spec
from souk.llm.common import ship, worker_tables

SIZE = 4096
OPEN_WINDOWS = 64
SLACK = 16              # tokens of a window that may stay empty
TABLE_LIMIT = 800_000   # remembered words of a worker, about 200 bytes each
KEPT_CHARS = 40
ROWS = 500
ODD_SPACE = "\x1c\x1d\x1e\x1f"  # str.split() cuts here, the tokenizer does not
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
TRUE_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


class WordIds(dict):
    """Ids of a text under a tokenizer that drops white space.

    White space separates, so the ids of a text are those of its words, side
    by side. Equal words are looked up here; a text of Latin-1 characters is
    lowered first, as the tokenizer does, so that a word has one entry in
    capitals or not. A new word of Latin letters and closing ASCII marks goes
    straight to the tokenizer's model, in lower case and byte symbols, which is
    all that its other steps do to such a word; any other word goes through the
    whole tokenizer.
    """

    def __init__(self, spec: str, code: str = "I"):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer, self.code = Tokenizer.from_str(spec), code
        self.model, self.plain = self.tokenizer.model, PLAIN_WORD.fullmatch
        self.symbols = str.maketrans({b: s for s, b in byte_symbols().items()})
        # special tokens are found before lowering: a text that may hold one stays as it is
        self.special = os.path.commonprefix([x["content"] for x in json.loads(spec).get("added_tokens", [])])

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            made = self._of_model(word)
        elif plain := self.plain(word):
            letters, marks = plain.groups()
            low = letters.lower()
            if marks or low != letters:
                made = self[low] + self[marks] if marks else self[low]
            else:
                made = self._of_model(low.encode().decode("latin-1").translate(self.symbols))
        else:
            made = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= KEPT_CHARS:
            if len(self) >= TABLE_LIMIT:
                self.clear()
            self[word] = made
        return made

    def _of_model(self, symbols: str) -> bytes:
        return self._packed([t.id for t in self.model.tokenize(symbols)])

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _lowered(self, text: str) -> str:
        """``text`` in lower case if that changes no id: NFC leaves Latin-1 as it is, and
        each of its letters is lowered by itself."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        low = text.lower()
        return text if self.special in low else low

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        text = self._lowered(text)
        words = TRUE_SPACE.split(text) if any(c in text for c in ODD_SPACE) else text.split()
        return b"".join(map(self.__getitem__, words))


def worker_words(spec: Broadcast, code: str = "I") -> WordIds:
    """The worker's table of words, kept for later tasks."""
    name = "words", code, hashlib.sha256(spec.value.encode()).digest()
    kept = worker_tables("word ids")
    if name not in kept:
        kept[name] = WordIds(spec.value, code)
    return kept[name]


class Windows:
    """The open windows of one partition; full ones leave through ``done``."""

    def __init__(self, size: int, open_windows: int, slack: int, first_id: int):
        self.size, self.limit, self.slack, self.next_id = size, open_windows, slack, first_id
        self.order: list[tuple[int, int]] = []   # (free tokens, key), ascending
        self.held: dict[int, list[tuple]] = {}   # key -> pieces (doc, start, ids, doc_tokens)
        self.keys = 0
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, ids, total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self.emit([(doc, at, ids[4 * at:4 * (at + self.size)], total)])
            at += self.size
        while at < total:
            k = bisect_left(self.order, (total - at, -1))
            if k == len(self.order) and len(self.order) >= self.limit:
                free, key = self.order.pop(0)  # the fullest
                pieces = self.held.pop(key)
                if free > self.slack:
                    pieces.append((doc, at, ids[4 * at:4 * (at + free)], total))
                    at += free
                self.emit(pieces)
                continue
            if k == len(self.order):
                free, key = self.size, self.keys
                self.keys += 1
                self.held[key] = []
            else:
                free, key = self.order.pop(k)
            self.held[key].append((doc, at, ids[4 * at:], total))
            free -= total - at
            if free:
                insort(self.order, (free, key))
            else:
                self.emit(self.held.pop(key))
            return

    def merge_rest(self) -> None:
        rest = [p for key in sorted(self.held) for p in self.held[key]]
        self.held, self.order = {}, []
        left = sum(len(p[2]) // 4 for p in rest)
        pieces: list[tuple] = []
        room = self._room(left)
        for doc, start, ids, total in rest:
            at, n = 0, len(ids) // 4
            while at < n:
                take = min(room, n - at)
                pieces.append((doc, start + at, ids[4 * at:4 * (at + take)], total))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self.emit(pieces)
                    pieces, room = [], self._room(left)

    def _room(self, left: int) -> int:
        """A full window, or the largest power of two in what is left."""
        return self.size if left >= self.size else 1 << left.bit_length() - 1 if left else 0


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = SIZE,
         open_windows: int = OPEN_WINDOWS, slack: int = SLACK, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables hold many objects and no cycles
        words = worker_words(spec)
        windows = Windows(size, open_windows, slack, TaskContext.get().partitionId() << 33)
        doc_type = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*windows.done)) or [()] * 7
            windows.done = []
            types = [doc_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        try:
            for batch in batches:
                doc_type = batch.column(0).type
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        windows.add(doc, words.encode(text) + end)
                    if windows.done:
                        yield flush()
            windows.merge_rest()
            if windows.done:
                yield flush()
        finally:
            gc.enable()

    return read.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, "
                                "doc_tokens long, sequence_id long, offset long")
