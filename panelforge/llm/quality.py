"""Operator 8: document quality from random-indexing word vectors and a small network.

Each token has a sparse random index vector, drawn from its hash. Its context vector sums the index vectors of its
neighbours over the labelled sample; index and context vector together are the token's vector, so a token the sample
lacks still has one. A document is the mean of its tokens' vectors. Two layers score it, and a temperature fitted on rows
kept back from training calibrates the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, text_bytes
from .labelled import labelled
from .words import mix, powers

DIM, BUCKETS, HIDDEN, NONZERO, REACH = 64, 1 << 16, 32, 6, 2
#: Most labelled rows that the model is fitted on, and tokens whose vectors are held at once.
SAMPLE, PIECE = 8_000, 50_000
#: Score from which a document counts as good.
LEAST = 0.3

#: Classes of bytes: 0 white space, 1 letters, 2 digits, 3 all other.
_CLASS = np.array([0 if b in b" \t\n\r\x0b\x0c" else 1 if chr(b).isalpha() or b > 127 else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_VALUE = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Buckets of what is seen besides the tokens: capitals throughout, a capital first, the token before once more.
_CAPITALS, _CAPITAL, _AGAIN = 0, 1, 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each token (a run of letters, of digits or of other signs), each row's first token (n + 1), and masks of marks and their rows."""
    flat, at = text_bytes(column)
    kind = _CLASS[flat]
    new = np.ones(len(flat), bool)
    new[1:] = kind[1:] != kind[:-1]
    cut = at[:-1]
    new[cut[cut < len(flat)]] = True
    edges = np.append(np.flatnonzero(new), len(flat))
    start, end = edges[:-1], edges[1:]
    some = kind[start] != 0 if len(start) else np.zeros(0, bool)
    start, end = start[some], end[some]
    prefix = np.zeros(len(flat) + 1, np.uint64)
    power, inverse = powers(len(flat) + 1)
    np.cumsum(_VALUE[_LOWER[flat]] * power[: len(flat)], out=prefix[1:])
    hashed = mix((prefix[end] - prefix[start]) * inverse[start])
    bucket = (8 + hashed % np.uint64(BUCKETS - 8)).astype(np.int32)
    first = np.searchsorted(start, at)
    upper = (flat >= 65) & (flat <= 90)
    capital = upper[start] if len(start) else np.zeros(0, bool)
    second = np.minimum(start + 1, end - 1)
    capitals = capital & (end - start > 1) & upper[second] if len(start) else capital
    again = np.zeros(len(start), bool)
    again[1:] = bucket[1:] == bucket[:-1]
    again[first[:-1][first[:-1] < len(start)]] = False
    return bucket, first, np.stack([capitals, capital & ~capitals, again]), start


def index_vectors(seed: int = 3) -> np.ndarray:
    """The sparse random index vector of each bucket: ``NONZERO`` places of +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    place = rng.integers(0, DIM, (BUCKETS, NONZERO))
    sign = rng.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1
    np.add.at(out, (np.arange(BUCKETS)[:, None], place), sign)
    return out / np.sqrt(NONZERO)


def word_vectors(columns: list[pa.Array]) -> np.ndarray:
    """Index plus unit context vectors, the contexts being those in ``columns``."""
    index = index_vectors()
    context = np.zeros_like(index)
    for column in columns:
        bucket, first, _, _ = tokens(column)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for low in range(0, len(bucket), PIECE):
            at = np.arange(low, min(len(bucket), low + PIECE))
            near = np.zeros((len(at), DIM), np.float32)
            for step in (*range(-REACH, 0), *range(1, REACH + 1)):
                to = np.clip(at + step, 0, len(bucket) - 1)
                near += index[bucket[to]] * ((row[to] == row[at]) & (to != at))[:, None]
            order = np.argsort(bucket[at], kind="stable")
            seen, begin = np.unique(bucket[at][order], return_index=True)
            context[seen] += np.add.reduceat(near[order], begin, axis=0)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    return index + context / np.maximum(size, 1e-6)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per row: the mean of its tokens' vectors, the shares of the marks, and the logarithm of its length; zeros for a row without tokens."""
    bucket, first, marks, _ = tokens(column)
    n = np.diff(first)
    out = np.zeros((len(n), DIM + len(marks) + 1), np.float32)
    full = np.flatnonzero(n)
    low = 0
    while low < len(full):
        # rows without tokens between these add nothing
        high = max(low + 1, int(np.searchsorted(first[full], first[full[low]] + PIECE)))
        rows, low = full[low:high], high
        a, b = first[rows[0]], first[rows[-1] + 1]
        out[rows, :DIM] = np.add.reduceat(vectors[bucket[a:b]], first[rows] - a, axis=0)
        for k in range(len(marks)):
            out[rows, DIM + k] = np.add.reduceat(marks[k, a:b], first[rows] - a, dtype=np.int64)
    out[full, :-1] /= n[full][:, None]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``score`` is the calibrated probability of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def gradients(net: Network, z: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> list[np.ndarray]:
    """Of the mean logistic loss of standardised features with half the decay times the squared weights, by w1, b1, w2 and b2."""
    h = np.tanh(z @ net.w1 + net.b1)
    d = (1 / (1 + np.exp(-(h @ net.w2 + net.b2))) - y) / len(y)
    dh = np.outer(d, net.w2) * (1 - h * h)
    return [z.T @ dh + decay * net.w1, dh.sum(axis=0), h.T @ d + decay * net.w2, d.sum()]


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the logistic loss with weight decay over four fifths of the rows; the rest chooses the temperature. With fewer than two classes every score is the same."""
    x = x.astype(np.float64)
    features = x.shape[1]
    rng = np.random.default_rng(seed)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(features), np.ones(features), np.zeros((features, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    net = Network(mean, scale, rng.standard_normal((features, HIDDEN)) / np.sqrt(features), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), 0.0)
    order = rng.permutation(len(y))
    kept, train = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - mean) / scale
    state = [[np.zeros_like(np.asarray(p, float)) for p in (net.w1, net.b1, net.w2, net.b2)] for _ in range(2)]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for low in range(0, len(train), 128):
            rows = train[low : low + 128]
            grads = gradients(net, z[rows], y[rows])
            step += 1
            new = []
            for i, (p, g) in enumerate(zip((net.w1, net.b1, net.w2, net.b2), grads)):
                m, v = state[0][i], state[1][i]
                m = state[0][i] = 0.9 * m + 0.1 * g
                v = state[1][i] = 0.999 * v + 0.001 * g * g
                new.append(p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = new[0], new[1], new[2], float(new[3])
        train = rng.permutation(train)
    logit, label = (net.logit(x[kept]), y[kept]) if len(kept) >= 10 else (net.logit(x), y)
    tried = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, np.where(label == 1, -1, 1) * logit / t)) for t in tried]
    net.temperature = float(tried[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def score(self, column: pa.Array) -> np.ndarray:
        return self.network.score(pooled(column, self.vectors))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model fitted on at most ``most`` labelled rows whose crc32 of the id as text isn't divisible by 5; ids only choose rows."""
    rows = labelled(docs, labels, label_col, most, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, id_col, text_col).orderBy("doc_id").select("label", "text").toArrow()
    columns = [b.column(1) for b in sliced(rows.to_batches(), "text")]
    vectors = word_vectors(columns)
    x = np.concatenate([pooled(c, vectors) for c in columns]) if columns else np.zeros((0, DIM + 4), np.float32)
    return Model(vectors, fit(x, rows.column("label").to_numpy().astype(np.int64)))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    A null text counts as empty, which has a score like any other; a null id stays null and is not held out; repeated rows
    get one row each. Nothing but the text enters the score. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)).astype(np.float64))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all their columns, with a score of at least ``least``; no row moves.

    Null and empty texts have the score of a text without words, like any other text with none, and go or stay by it. Rows with
    a null id and repeated rows are scored each for itself. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield batch.filter(pa.array(shared.value.score(batch.column(batch.schema.get_field_index(text_col))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, by a model fitted on ``labels.quality``."""
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
