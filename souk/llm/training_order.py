"""Training-order materialisation with a keyed Feistel permutation.

Token sequences of one length get dense numbers, partition by partition. A
keyed Feistel network over the smallest even number of bits that holds the
count permutes them; a value beyond the count is permuted again until it is
inside (cycle walking), so every sequence has one slot and every slot one
sequence, and any slot can be computed without the others. Slots are cut into
shards of equal numbers of records; sequences are shuffled once, by shard, and
each shard is a file of records of one size, in slot order. A reader seeks to
``slot`` by arithmetic and resumes after any number of records.

Sequences are the documents' ids, each document closed by an end id, laid end
to end within a partition and cut; only a partition's last sequence is padded.
They are written to the shared scratch folder once (packed), with partition and
number, so that texts are tokenized once and a number stays with its sequence.

``write_shards`` writes the shards before it returns. Each attempt of a task writes
files of its own names, with the same bytes, and Spark commits the rows of one
attempt to the manifest in the same folder; a file counts only if the manifest names
it, so nothing is renamed, deleted or written again by a later action. Ids take 16
bits, or 32 if the vocabulary has more than 65,536.

Folders may be local or of a scheme that pyarrow opens (``file``, ``hdfs``, ``s3``,
``gs``; ``s3a`` and ``s3n`` are read as ``s3``); any other scheme raises before
anything is written.

Defined cases: a NULL or empty text is its end id alone; NULL ids are kept;
repeated rows are sequences each for itself; an empty table gives no shards;
other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.bpe_automaton import read_spec
from souk.llm.common import ship, stored
from souk.llm.packing import worker_words

LENGTH = 2048            # ids of a sequence
SHARD_RECORDS = 2048     # records of a shard: 8 MB of 16-bit ids
ROUNDS = 4
ROWS = 500


def feistel_slots(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slot of every number below ``count`` under ``key``."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    width = np.uint64(half)

    def permuted(x: np.ndarray) -> np.ndarray:
        left, right = x >> width, x & mask
        for r in range(ROUNDS):
            mixed = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % 2 ** 64)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return left << width | right

    out = permuted(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(count)).any():
        out[outside] = permuted(out[outside])
    return out.astype(np.int64)


class Sequences:
    """Cuts a partition's stream of documents into sequences of one length."""

    def __init__(self, record_bytes: int):
        self.bytes, self.held, self.size, self.docs = record_bytes, [], 0, []
        self.local = 0

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, list, bytes]]:
        at = 0
        while at < len(ids):
            part = ids[at:at + self.bytes - self.size]
            self.held.append(part)
            self.docs.append(doc)
            self.size += len(part)
            at += len(part)
            if self.size == self.bytes:
                yield self.taken()

    def taken(self) -> tuple[int, list, bytes]:
        out = (self.local, self.docs, b"".join(self.held))
        self.held, self.size, self.docs, self.local = [], 0, [], self.local + 1
        return out


def id_code(spec: str, end_id: int) -> str:
    """``H`` (16 bits) if every id of the vocabulary fits, else ``I`` (32 bits)."""
    read = json.loads(spec)
    ids = [end_id, *read["model"]["vocab"].values(), *(x["id"] for x in read.get("added_tokens", []))]
    return "H" if max(ids) < 1 << 16 else "I"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    scheme, _, rest = folder.partition("://")
    if scheme in ("s3a", "s3n"):
        folder = "s3://" + rest
    if "://" not in folder:   # a path, or file:/path
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def _sequences(docs: DataFrame, spec: Broadcast, code: str, end_id: int, length: int,
               id_col: str, text_col: str) -> DataFrame:
    """part, local, doc_ids, n_tokens, packed: the sequences of every partition, in order."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    width = struct.calcsize(code)
    names = ["part", "local", "doc_ids", "n_tokens", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = worker_words(spec, code), struct.pack("<" + code, end_id)
        part, sequences = TaskContext.get().partitionId(), Sequences(width * length)
        out: list[tuple[int, list, bytes]] = []

        def made(kind: pa.DataType) -> pa.RecordBatch:
            cols = [pa.array([part] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                    pa.array([[*dict.fromkeys(x[1])] for x in out], pa.list_(kind)),
                    pa.array([len(x[2]) // width for x in out], pa.int32()),
                    pa.array([pa.compress(x[2], "zstd", asbytes=True) for x in out], pa.binary())]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        kind = None
        gc.disable()  # the tables hold many objects and no cycles
        try:
            for b in batches:
                kind = b.column(0).type
                for at in range(0, b.num_rows, ROWS):
                    some = b.slice(at, ROWS)
                    for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                        out.extend(sequences.add(doc, words.encode(text) + end))
                    if len(out) >= ROWS:
                        yield made(kind)
            if sequences.size:
                out.append(sequences.taken())
            if out:
                yield made(kind)
        finally:
            gc.enable()

    return read.mapInArrow(run, f"part long, local long, doc_ids array<{read.schema[0].dataType.simpleString()}>, "
                                "n_tokens int, packed binary")


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, key: int = 1,
                 end_id: int = 2, length: int = LENGTH, shard_records: int = SHARD_RECORDS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and their manifest to ``folder``; returns the manifest.

    One row per sequence: slot, shard, file, byte_offset, n_tokens (without padding),
    doc_ids, ids_crc32 (of the record's bytes as written).
    """
    spark = docs.sparkSession
    open_folder(folder)
    ship(spark)
    text = read_spec(tokenizer_path)
    spec, code = spark.sparkContext.broadcast(text), id_code(text, end_id)
    width = struct.calcsize(code)
    stride = width * length
    held = stored(_sequences(docs, spec, code, end_id, length, id_col, text_col), "sequences", codec="none")
    counts = {r.part: r.n for r in held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(counts):  # one number per partition of the input
        starts[part] = total
        total += counts[part]
    shared = spark.sparkContext.broadcast((starts, total))

    @F.pandas_udf("long")
    def slot_of(part: pd.Series, local: pd.Series) -> pd.Series:
        starts, total = shared.value
        numbers = part.map(starts).to_numpy(np.int64) + local.to_numpy(np.int64)
        return pd.Series(feistel_slots(numbers, total, key))

    shards = -(-total // shard_records) or 1
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = (held.select(slot_of("part", "local").alias("slot"), "doc_ids", "n_tokens", "packed")
              .select(F.floor(F.col("slot") / shard_records).alias("shard"), "slot", "doc_ids", "n_tokens", "packed")
              .repartitionById(tasks, (F.col("shard") * tasks / shards).cast("int"))
              .sortWithinPartitions("slot"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        open_shard, sink, name = None, None, ""
        try:
            for b in batches:
                crcs, offsets, files = [], [], []
                for shard, slot, n, packed in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", "n_tokens", "packed"))):
                    if shard != open_shard:
                        if sink is not None:
                            sink.close()
                        open_shard, name = shard, f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                        sink = system.open_output_stream(f"{base}/{name}")
                    record = pa.decompress(packed, n * width, "zstd", asbytes=True).ljust(stride, b"\0")
                    sink.write(record)
                    crcs.append(zlib.crc32(record))
                    offsets.append(slot % shard_records * stride)
                    files.append(name)
                yield pa.RecordBatch.from_arrays(
                    [b.column("slot"), b.column("shard"), pa.array(files, pa.string()),
                     pa.array(offsets, pa.int64()), b.column("n_tokens"), b.column("doc_ids"),
                     pa.array(crcs, pa.int64())],
                    ["slot", "shard", "file", "byte_offset", "n_tokens", "doc_ids", "ids_crc32"])
        finally:
            if sink is not None:
                sink.close()

    kind = held.schema["doc_ids"].dataType.simpleString()
    manifest = placed.mapInArrow(written, "slot long, shard long, file string, byte_offset long, "
                                          f"n_tokens int, doc_ids {kind}, ids_crc32 long")
    manifest.write.mode("error").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str, slot: int, count: int, length: int = LENGTH,
                 code: str = "H") -> Iterator[np.ndarray]:
    """Resume at ``slot``: up to ``count`` records, shard after shard.

    The manifest gives the files of the shards and where ``slot`` lies in the first;
    the records of a file follow each other.
    """
    system, base = open_folder(folder)
    stride = struct.calcsize(code) * length
    files = (spark.read.parquet(f"{folder}/manifest").where(F.col("slot").between(slot, slot + count - 1))
             .groupBy("shard", "file").agg(F.min("byte_offset").alias("start"), F.count("*").alias("records"))
             .orderBy("shard").collect())
    for r in files:
        with system.open_input_file(f"{base}/{r.file}") as f:
            f.seek(r.start)
            yield from np.frombuffer(f.read(r.records * stride), "<" + code).reshape(-1, length)
