"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` characters. Each passage is
encoded by a learned layer over its shape (letter cases, digits, marks, word
lengths, repeated words, hashed letter pairs). Gated attention (a tanh branch
times a sigmoid branch, then a softmax over the document's passages) weighs the
passages, and a logistic unit scores the weighted sum. Only documents have
labels; the weights of passages are learned from them.

The model is fitted with Adam on the driver, from the passages of at most
``SAMPLE`` labelled documents (those with the smallest id hashes); it is a few
thousand numbers and is broadcast. Every passage of every document is scored
where the text is read; no row is shuffled.

Defined cases: a NULL or empty text is one passage without characters and gets
the score that the model gives it; labels that are NULL are not learned from,
of several labels of one id the mean decides; without labels of both kinds all
scores are 0.5; NULL ids are kept; repeated rows each give a row; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import ship

PASSAGE = 600       # code points of a passage
SAMPLE = 4_000      # labelled documents learned from
FIT_PASSAGES = 512   # passages of a labelled document that the fit looks at, at most
PAIRS = 64          # buckets of letter pairs
HIDDEN, GATES = 32, 16
EPOCHS, BATCH, RATE, DECAY = 25, 64, 0.01, 1e-4
MARKS = ".,!?|#*$%&<>:;-'\"()/"
BLOCK_CHARS = 400_000


def passage_features(text: str) -> np.ndarray:
    """One row of shape features per passage of the whole text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = max(1, -(-len(codes) // PASSAGE))
    owner = np.arange(len(codes)) // PASSAGE
    size = np.maximum(1, np.bincount(owner, minlength=n)).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n) / size

    space = (codes == 32) | (codes >= 9) & (codes <= 13)
    upper = (codes >= 65) & (codes <= 90) | (codes >= 192) & (codes <= 222) & (codes != 215)
    lower = (codes >= 97) & (codes <= 122) | (codes >= 223) & (codes <= 255) & (codes != 247)
    digit = (codes >= 48) & (codes <= 57)
    columns = [share(space), share(codes == 10), share(upper), share(lower), share(digit),
               share(codes > 127), *(share(codes == ord(m)) for m in MARKS)]
    words = _word_features(codes, space, owner, n)
    pairs = np.zeros((n, PAIRS))
    if len(codes) > 1:
        inner = owner[:-1]
        bucket = (codes[:-1] * 31 + codes[1:]) * 2654435761 % 2 ** 32 * PAIRS >> 32
        pairs = np.bincount(inner * PAIRS + bucket, minlength=n * PAIRS).reshape(n, PAIRS)
        pairs = np.sqrt(pairs / size[:, None])
    return np.column_stack([*columns, *words, np.log1p(size), pairs]).astype(np.float32)


def _word_features(codes, space, owner, n) -> list[np.ndarray]:
    """Words per character, mean length, share equal to the word before, share
    of different words, share that begin with a capital."""
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]])) if len(codes) else []
    if not len(starts):
        return [np.zeros(n)] * 5
    ends = np.flatnonzero(inside & np.concatenate([space[1:], [True]])) + 1
    lengths = ends - starts
    place = _places(len(codes), starts)
    mixed = np.where(inside, (codes * 2654435761 + 97) * (place * 40503 + 1) % 1_000_003, 0)
    total = np.concatenate([[0], np.cumsum(mixed)])
    hashes = (total[ends] - total[starts]) * 64 + lengths % 64
    own = owner[starts]
    count = np.maximum(1, np.bincount(own, minlength=n)).astype(np.float64)
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])])
    kinds = np.unique(np.stack([own, hashes]), axis=1)[0]
    first = codes[starts]
    capital = (first >= 65) & (first <= 90) | (first >= 192) & (first <= 222)
    chars = np.maximum(1, np.bincount(owner, minlength=n))
    return [np.bincount(own, minlength=n) / chars * 6,
            np.bincount(own, weights=lengths, minlength=n) / count / 8,
            np.bincount(own[same], minlength=n) / count,
            np.bincount(kinds, minlength=n) / count,
            np.bincount(own[capital], minlength=n) / count]


def _places(size: int, starts: np.ndarray) -> np.ndarray:
    """Position of each character behind the last word start before it."""
    last = np.zeros(size, np.int64)
    last[starts] = starts
    return np.arange(size) - np.maximum.accumulate(last)


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Score of each bag; bag i starts at row begins[i] of ``x``."""
        return _forward(self.weights, (x - self.mean) / self.std, begins)[-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, begins: np.ndarray):
    sizes = np.diff(np.append(begins, len(x)))
    bag = np.repeat(np.arange(len(begins)), sizes)
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    t, s = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
    e = (t * s) @ w["attend"]
    a = np.exp(e - np.maximum.reduceat(e, begins)[bag])
    a = a / np.add.reduceat(a, begins)[bag]
    z = np.add.reduceat(a[:, None] * h, begins, axis=0)
    return bag, h, t, s, a, z, _sigmoid(z @ w["score"] + w["score_b"])


def _gradients(w, x, begins, y):
    bag, h, t, s, a, z, p = _forward(w, x, begins)
    d = (p - y) / len(y)
    g = {"score": z.T @ d, "score_b": d.sum(keepdims=True)}
    dz = d[:, None] * w["score"]
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, begins)[bag])
    g["attend"] = (t * s).T @ de
    dt, ds = de[:, None] * w["attend"] * s * (1 - t * t), de[:, None] * w["attend"] * t * s * (1 - s)
    g["tanh"], g["gate"] = h.T @ dt, h.T @ ds
    dh = (a[:, None] * dz[bag] + dt @ w["tanh"].T + ds @ w["gate"].T) * (1 - h * h)
    g["encode"], g["encode_b"] = x.T @ dh, dh.sum(axis=0)
    return g


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags).astype(np.float64)
    mean, std = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    width = rows.shape[1]
    w = {"encode": rng.normal(0, width ** -0.5, (width, HIDDEN)), "encode_b": np.zeros(HIDDEN),
         "tanh": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATES)),
         "gate": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATES)),
         "attend": rng.normal(0, GATES ** -0.5, GATES),
         "score": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "score_b": np.zeros(1)}
    first, second, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            sizes = [len(bags[i]) for i in some]
            x = (np.concatenate([bags[i] for i in some]) - mean) / std
            g = _gradients(w, x, np.cumsum([0, *sizes[:-1]]), labels[some])
            step += 1
            for k in w:
                grad = g[k] + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, std, w)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Fit the model to at most ``sample`` labelled documents; None without both labels."""
    ship(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
              .where("doc_id is not null and label is not null").groupBy("doc_id")
              .agg(F.avg("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for id_, label, text in zip(*(c.to_pylist() for c in b.columns)):
                x = passage_features(text or "")
                if len(x) > FIT_PASSAGES:  # evenly spread over the text
                    x = x[np.linspace(0, len(x) - 1, FIT_PASSAGES).astype(int)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([id_], b.column(0).type), pa.array([label], pa.float64()),
                     pa.array([x.tobytes()], pa.binary())], ["doc_id", "label", "x"])

    # at most ``sample`` rows of (id, label) are broadcast and as many bags collected,
    # of at most FIT_PASSAGES passages each
    kind = read.schema["doc_id"].dataType.simpleString()
    rows = sorted((read.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
                   .mapInArrow(run, f"doc_id {kind}, label double, x binary")).collect())
    y = np.array([float(r.label >= 0.5) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    width = passage_features("").shape[1]
    return train([np.frombuffer(r.x, np.float32).reshape(-1, width) for r in rows], y)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from all passages of its text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts, scores, held, size = b.column(1).to_pylist(), [], [], 0
            for i, text in enumerate(texts):
                held.append(passage_features(text or ""))
                size += len(text or "")
                if size >= BLOCK_CHARS or i == len(texts) - 1:
                    begins = np.cumsum([0, *(len(x) for x in held[:-1])])
                    scores += ([0.5] * len(held) if model is None else
                               np.round(model.scores(np.concatenate(held), begins), 6).tolist())
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())],
                                             ["doc_id", "score"])

    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, score double")
