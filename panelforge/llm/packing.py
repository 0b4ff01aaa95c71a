"""Operator 6: order-preserving packing by dynamic programming.

A task lays its documents end to end and chooses window cuts among document ends (free), sentence ends (a small penalty)
and every 32nd id (a larger one). Over cut places p with penalty q the least cost is

    best(j) = min over i with p_j - p_i <= size of best(i) + (size - (p_j - p_i)) + q_j
            = size - p_j + q_j + min(best(i) + p_i),

so the minimum of best + p over a sliding range is wanted. It never falls as the range moves on, since each new best + p is
greater than it by size + q; hence of the places with one penalty the first in the range is the least, and with three
penalties each place looks at three others. The documents of a segment (about a million ids) are cut together; what is
left at its end is cut at powers of two, which need no padding. No row is shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
SENTENCE, ANYWHERE, STEP = 2, 12, 32
#: Distinct words whose ids a worker keeps.
WORDS = 500_000


def cuts(places: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Window ends (the last place included) of least padding plus penalty; neighbouring places are at most ``size`` apart and the first is 0.

    The last window isn't padded: it is cut at powers of two, each cut costing as much as one anywhere.
    """
    n, first = len(places), np.searchsorted(places, places - size)
    # of the places with one penalty the first in reach is the best, so there is one to look at for each penalty
    reach = []
    for q in np.unique(penalty):
        at = np.flatnonzero(penalty == q)
        nearest = np.append(at, n)[np.searchsorted(at, first)]
        reach.append(np.where(nearest < np.arange(n), nearest, first))
    looked_at, step = np.stack(reach), penalty.astype(np.int64) + size
    # places up to ``until[j]`` look at places before ``j`` only, so they are done at once; there are a few such runs a window
    until = np.searchsorted(looked_at[:, 1:].max(axis=0), np.arange(n)) + 1
    total = np.zeros(n, np.int64)  # best + p
    j, end = 1, n - 1
    while j < n:
        high = int(until[j])
        total[j:high] = total[looked_at[:, j:high]].min(axis=0) + step[j:high]
        j = high
    out = []
    if end:
        out.append(int(places[end]))
        near = range(int(first[end]), end)
        j = min(near, key=lambda i: int(total[i]) - int(places[i]) + ANYWHERE * ((out[0] - int(places[i])).bit_count() - 1))
        while j:
            out.append(int(places[j]))
            # the last of equally good places
            j -= 1 + int(total[first[j] : j][::-1].argmin())
    return out[::-1]


def windows(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows over ``total`` ids, and ``total``; every window but those of a power of two at the end is the choice of ``cuts``."""
    penalty = np.full(total + 1, -1, np.int32)
    penalty[::STEP] = ANYWHERE
    penalty[sentence_ends] = SENTENCE
    penalty[doc_ends] = 0
    penalty[[0, total]] = 0
    places = np.flatnonzero(penalty >= 0)
    ends = cuts(places, penalty[places], size)
    at = ends[-2] if len(ends) > 1 else 0
    left = ends.pop() - at
    while left:
        at += (step := 1 << (left.bit_length() - 1))
        left -= step
        ends.append(at)
    return np.array([0, *ends])


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment: int = 1_000_000) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``size`` ids (a power of two).

    Null or empty text: the end id alone, so every row gives a piece. Repeated rows and rows with one id are packed each
    for itself; a null id stays null. An empty table gives no rows. Other columns are not read.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sequence = encoder(tokenizer, WORDS), TaskContext.get().partitionId() << 32
        with open(tokenizer, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        stops = np.zeros(1 + max(vocabulary.values()), bool)
        stops[[i for w, i in vocabulary.items() if w.removesuffix("</w>").endswith((".", "!", "?"))]] = True
        names: list[pa.Array] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            doc, ids, n = pa.concat_arrays(names), np.concatenate(parts), np.concatenate(sizes)
            ends = np.cumsum(n)
            w = windows(len(ids), ends, np.flatnonzero(stops[np.minimum(ids, len(stops) - 1)]) + 1, size)
            at = np.union1d(w[:-1], ends - n)
            length = np.diff(np.append(at, len(ids)))
            of = np.searchsorted(ends, at, side="right")
            window = np.searchsorted(w, at, side="right") - 1
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
            out = [doc.take(pa.array(of)), at - (ends - n)[of], length, pa.array(crc, pa.int64()), n[of], sequence + window, at - w[window], np.diff(w)[window]]
            sequence += len(w) - 1
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in out], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in sliced(batches, "text"):
            ids, at = coder.encode(batch.column(1).to_pylist())
            count = np.diff(at) + 1
            out = np.full(int(count.sum()), end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count - 1)] = ids
            names.append(batch.column(0))
            parts.append(out)
            sizes.append(count)
            held += len(out)
            if held >= segment:
                yield flush()
                names, parts, sizes, held = [], [], [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 ids of the 49k word-level file, end id 1."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
