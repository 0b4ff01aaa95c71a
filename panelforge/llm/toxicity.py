"""Operator 7: toxicity grades by cumulative-link ordinal regression.

A document has the grade y in 0..K-1 with P(y > k) = sigmoid(w.x - c_k): one weight vector for all thresholds, which are
kept in order. x marks the words (and the first bytes of words, which inflected forms share) that a text holds. Only
features that go with toxic texts beyond chance get a weight, and proximal steps with an L1 penalty set many of those to
zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table
from .labelled import labelled
from .words import words

BITS = 20
#: Lengths in bytes of the word beginnings that count as features, besides whole words.
HEADS = (5, 6, 7)
#: Most labelled rows that the model is fitted on, and documents of them that a feature is in at least.
SAMPLE, LEAST_DOCS = 10_000, 4
#: Standard deviations by which a feature's toxic documents must exceed their expected number.
LEAST_Z = 5.0
GRADES = 4
#: Words that mark toxic texts, occurrences of which make the grades from 2 on.
OFTEN = 2


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row, and where each row's begin (n + 1)."""
    w = words(column)
    n = len(w.first) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(w.first)) << np.uint64(BITS)
    shift = np.uint64(64 - BITS)
    parts = [row | (w.hash >> shift)]
    parts += [row | ((w.heads(h) * np.uint64(2 * h + 1)) >> shift) for h in HEADS]
    every = np.unique(np.concatenate(parts))
    return (every & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(every, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


@dataclass
class Ordinal:
    """Weights by feature and the ordered thresholds."""

    weights: np.ndarray
    cuts: np.ndarray

    def logits(self, column: pa.Array) -> np.ndarray:
        found, first = features(column)
        return sums(self.weights[found], first)

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(y > k) for every k: one column a threshold."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -60, 60)))


def marks(found: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each feature whether more of its documents are ``toxic`` than chance explains."""
    n = len(toxic)
    row = np.repeat(np.arange(n), np.diff(first))
    docs, bad = (np.bincount(x, minlength=1 << BITS) for x in (found, found[toxic[row]]))
    rate = np.mean(toxic) if n else 0.0
    return (docs >= LEAST_DOCS) & (bad - docs * rate >= LEAST_Z * np.sqrt(docs * rate * (1 - rate)))


def marked_words(column: pa.Array, some: np.ndarray) -> np.ndarray:
    """How many of each row's words, repeats included, have a feature in ``some``."""
    w = words(column)
    shift = np.uint64(64 - BITS)
    marked = some[w.hash >> shift]
    for h in HEADS:
        marked |= some[(w.heads(h) * np.uint64(2 * h + 1)) >> shift]
    return sums(marked.astype(np.int64), w.first).astype(np.int64)


def grades_of(toxic: np.ndarray, marked: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for texts that aren't toxic; 1 for toxic ones, and one grade more each time the number of marked words doubles from ``OFTEN`` on."""
    steps = (marked[:, None] >= OFTEN * 2 ** np.arange(grades - 2)[None, :]).sum(axis=1)
    return np.where(toxic, 1 + steps, 0)


def loss(z: np.ndarray, cuts: np.ndarray, grade: np.ndarray) -> float:
    """Mean negative log-likelihood of the grades for the logits ``z``."""
    below = 1 / (1 + np.exp(-np.clip(np.concatenate([[-60], cuts, [60]])[None, :] - z[:, None], -60, 60)))
    below[:, 0], below[:, -1] = 0, 1
    i = np.arange(len(grade))
    return float(-np.log(np.maximum(below[i, grade + 1] - below[i, grade], 1e-9)).mean())


def fit(found: np.ndarray, first: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 400, l1: float = 5e-5) -> Ordinal:
    """Proximal AdaGrad on the mean negative log-likelihood of the cumulative-link model."""
    n = len(grade)
    weights = np.zeros(1 << BITS)
    row = np.repeat(np.arange(n), np.diff(first))
    keep = marks(found, first, grade > 0)[found]
    first = np.concatenate([[0], np.cumsum(keep)])[first]
    names, at = np.unique(found[keep], return_inverse=True)
    row = row[keep]
    share = np.array([(np.sum(grade > k) + 0.5) / (n + 1) for k in range(grades - 1)])
    cuts = -np.log(share / (1 - share))
    w, gw, gc = np.zeros(len(names)), np.full(len(names), 1e-8), np.full(grades - 1, 1e-8)
    if n:
        for _ in range(rounds):
            z = sums(w[at], first)
            below = 1 / (1 + np.exp(-np.clip(np.concatenate([[-60], cuts, [60]])[None, :] - z[:, None], -60, 60)))
            below[:, 0], below[:, -1] = 0, 1
            slope = below * (1 - below)
            i = np.arange(n)
            high, low = slope[i, grade + 1], slope[i, grade]
            p = np.maximum(below[i, grade + 1] - below[i, grade], 1e-9)
            dz = (high - low) / p / n
            dc = np.zeros(grades + 1)
            np.add.at(dc, grade + 1, -high / p / n)
            np.add.at(dc, grade, low / p / n)
            g = np.bincount(at, dz[row], minlength=len(names))
            gw += g * g
            rate = 0.5 / np.sqrt(gw)
            w = w - rate * g
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
            gc += dc[1:-1] ** 2
            cuts = np.maximum.accumulate(cuts - 0.3 / np.sqrt(gc) * dc[1:-1] + np.arange(grades - 1) * 1e-6)
    weights[names] = w
    return Ordinal(weights, cuts)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, grades: int = GRADES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    """A model fitted on at most ``most`` labelled rows.

    The labels say only whether a text is toxic. How severe it is, is taken from how often it uses words that mark toxic
    texts (by the labels' statistics, see ``grades_of``); the model itself sees only which words a text holds.
    """
    rows = labelled(docs, labels, label_col, most, None, id_col, text_col).orderBy("doc_id").select("label", "text").toArrow()
    parts = [features(b.column(1)) for b in sliced(rows.to_batches(), "text")]
    label = rows.column("label").to_numpy().astype(np.int64)
    if not len(label) or not label.any():
        return Ordinal(np.zeros(1 << BITS), np.full(grades - 1, 20.0))
    found = np.concatenate([p[0] for p in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    some = marks(found, first, label > 0)
    marked = np.concatenate([marked_words(b.column(1), some) for b in sliced(rows.to_batches(), "text")])
    return fit(found, first, grades_of(label > 0, marked, grades), grades)


def severity(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (the expected grade), p_toxic (that the grade is over 0), toxic (p_toxic of a half or more), one row for each row of ``docs``.

    Null and empty texts have no feature and so the base rate; a null id stays null; repeated rows get a row each; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            above = shared.value.above(shared.value.logits(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], ["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, by a model fitted on ``labels.toxic``."""
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))
