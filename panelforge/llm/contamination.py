"""Operator 9: benchmark passages in documents, by spaced seeds.

A seed is a fixed mask over neighbouring words; the hash of the words it selects is blind to those it skips, so it still
matches where a skipped word was replaced. Hashes of all benchmark positions are joined with those of all document
positions; around each hit the words on its diagonal are compared and the stretch with the most equal words is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table
from .words import Words, mix, words

#: Fixed masks; the last is for items shorter than the others.
MASKS = ("110110011011", "101011101101", "111001110011", "1101011")
#: A stretch counts from so many equal words (or this share of a shorter item) with at least this share of its words equal.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
#: Bytes of benchmark texts that are sent to the tasks at once; a larger benchmark is taken in blocks, one pass each.
BLOCK_BYTES = 8 << 20
#: Hits that are looked at in one piece.
HITS = 1 << 20
_ODD = np.random.default_rng(9).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(hashes: np.ndarray, first: np.ndarray, mask: str, salt: int, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the mask at every position where it lies within one text, those positions, and the hash a word earlier (``none`` at a text's first word)."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, _ODD[-1 - salt], np.uint64)
    for k, i in enumerate(x for x, c in enumerate(mask) if c == "1"):
        total += hashes[i : i + n] * _ODD[k]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    total = mix(total)
    before = np.where(row[at] == row[at - 1], total[at - 1], np.uint64(none))
    before[at == 0] = none
    return total[at], at, before


@dataclass
class Block:
    """Words of one block of benchmark items, and for each mask its seeds (in order), their places and the seeds a word earlier."""

    items: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    filter: np.ndarray

    @staticmethod
    def of(items: list[int], texts: list[str]) -> Block:
        w = words(pa.array(texts, pa.string()))
        bits, found = np.zeros(1 << 22, bool), []
        for i, m in enumerate(MASKS):
            seed, place, before = seeds(w.hash, w.first, m, i, 1 << 40)
            order = np.lexsort((before >> np.uint64(24), seed))
            seed, place, before = seed[order], place[order], before[order]
            bits[seed >> np.uint64(42)] = True
            # seeds by number and the first 40 bits of the seeds before them as one sorted key
            number = np.cumsum(np.append(0, seed[1:] != seed[:-1])[: len(seed)]).astype(np.uint64)
            found.append((seed, place, number << np.uint64(40) | before >> np.uint64(24)))
        return Block(np.array(items, np.int64), w.hash, w.first, found, bits)

    def diagonals(self, w: Words) -> np.ndarray:
        """Row, item and shift of each diagonal with a hit, as rows.

        A hit whose neighbours a word earlier hit too lies on a diagonal that an earlier hit has shown, so only the first
        of such runs are looked at: texts and items that repeat one word, or a few, don't multiply. The rest is taken in
        pieces, so memory stays bounded.
        """
        wide = int(max(np.diff(w.first).max(initial=0), np.diff(self.first).max(initial=0))) + 1
        known = np.zeros(0, np.int64)
        for i, m in enumerate(MASKS):
            own, places, keys = self.seeds[i]
            seed, at, before = seeds(w.hash, w.first, m, i, 1 << 41)
            some = np.flatnonzero(self.filter[seed >> np.uint64(42)])
            seed, at, before = seed[some], at[some], before[some]
            low, high = np.searchsorted(own, seed), np.searchsorted(own, seed, side="right")
            hit = np.flatnonzero(high > low)
            low, high, at, before = low[hit], high[hit], at[hit], before[hit]
            key = (keys[low] >> np.uint64(40)) << np.uint64(40) | before >> np.uint64(24)
            skip, over = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            low, high, at = np.concatenate([low, over]), np.concatenate([skip, high]), np.concatenate([at, at])
            n = high - low
            ends = np.cumsum(n)
            begin = 0
            while begin < len(n):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS, side="right")))
                k = n[begin:end]
                of = np.repeat(low[begin:end] - np.cumsum(k) + k, k) + np.arange(k.sum())
                a, p = np.repeat(at[begin:end], k), places[of]
                row, item = np.searchsorted(w.first, a, side="right") - 1, np.searchsorted(self.first, p, side="right") - 1
                shift = (a - w.first[row]) - (p - self.first[item])
                known = np.union1d(known, (row * len(self.items) + item) * (2 * wide) + shift + wide)
                begin = end
        pair, shift = np.divmod(known, 2 * wide)
        return np.stack([pair // len(self.items), pair % len(self.items), shift - wide], axis=1)

    def overlaps(self, w: Words) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item) -> equal words, first word and end of the best stretch in the row."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, shift in self.diagonals(w).tolist():
            a, b = self.hashes[self.first[item] : self.first[item + 1]], w.hash[w.first[row] : w.first[row + 1]]
            low, high = max(0, -shift), min(len(a), len(b) - shift)
            equal, start, end = stretch(a[low:high] == b[low + shift : high + shift])
            if equal >= min(LEAST_WORDS, LEAST_SHARE * len(a)) and equal > best.get((row, item), (0,))[0]:
                best[row, item] = equal, start + low + shift, end + low + shift
        return best


def stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Equal words, start and end of the stretch with the most equal words among those of which ``LEAST_SHARE`` or more are equal.

    With 1 for an equal word and -4 for another (whole numbers, so that exactly the share counts) those are the stretches
    whose sum isn't negative; the longest that ends at a place begins where the running sum first is as low as there.
    """
    equal = np.concatenate([[0], np.cumsum(same)])
    unequal = round(LEAST_SHARE / (1 - LEAST_SHARE))
    score = (1 + unequal) * equal - unequal * np.arange(len(equal))
    start = np.searchsorted(-np.minimum.accumulate(score), -score)
    end = int(np.argmax(equal - equal[start]))
    inside = np.flatnonzero(same[start[end] : end])
    if not len(inside):
        return 0, 0, 0
    return len(inside), int(start[end] + inside[0]), int(start[end] + inside[-1] + 1)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Block]:
    """The benchmark's items with a text, in blocks of bounded bytes. The share of an item with over ``BLOCK_BYTES`` is a block of its own."""
    b = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(1, n)))
    found = []
    for i in range(n):
        rows = b.where(part == i).orderBy("item_id", "text").collect() if n > 1 else b.orderBy("item_id", "text").collect()
        if rows:
            found.append(Block.of([r[0] for r in rows], [r[1] for r in rows]))
    return found


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, equal_words, first_word, end_word, item_words: one row for each document row and item it holds a passage of.

    Words are runs of letters and digits in lower case; only whole texts are searched. Null and empty texts hold nothing,
    items with a null id or text or with fewer words than the shortest mask match nothing; repeated documents give a row
    each, repeated items count once, a null doc_id stays null. An empty table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, equal_words long, first_word long, end_word long, item_words long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(block: Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                found = block.overlaps(words(batch.column(1)))
                by_id: dict[tuple[int, int], tuple] = {}
                for (row, item), best in found.items():
                    key = row, int(block.items[item])
                    by_id[key] = max(by_id.get(key, (0, 0, 0, 0)), (*best, int(block.first[item + 1] - block.first[item])))
                of = pa.array([row for row, _ in by_id], pa.int64())
                rest = list(zip(*by_id.values())) if by_id else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array([i for _, i in by_id], pa.int64()), *(pa.array(c, pa.int64()) for c in rest)], [x.split()[0] for x in schema.split(", ")])

        return rows.mapInArrow(run, schema)

    out = None
    for block in blocks(benchmark):
        out = search(block) if out is None else out.unionByName(search(block))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no passage of the benchmark; no row moves.

    Null and empty texts hold none and stay, as do all rows if the benchmark is empty or its texts are null or too short.
    Rows with a null id and repeated rows are judged each for itself. An empty table gives no rows.
    """
    for block in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in block.overlaps(words(batch.column(batch.schema.get_field_index(text_col))))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
