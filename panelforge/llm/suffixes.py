"""Operator 4: long repeated strings by two-stage suffix sorting, counted in bytes or in words.

Which strings of 400 bytes (or 51 words) start more than once? One suffix array over all texts has no size bound, so texts
are first cut along anchors that equal strings choose alike, and each piece's suffixes are sorted where all its equals
are. A symbol is a byte, or a word by its 64-bit hash:

1. Of the grams of half the length in a window the one with the least hash is the window's anchor. Equal windows have
   equal anchors at equal places, so only windows at anchors that occur twice can repeat.
2. Sixteen neighbouring windows of an anchor share all but 15 symbols, their core. A block of them is written as the 15
   symbols before the core, the core as a single symbol (its 128-bit hash), and the 15 symbols after it: each window is
   then a suffix of that string, and what tells it from others is the suffix's first 16 symbols.
3. Blocks with one core are sent to one task (equal blocks are added up before they move), which sorts the suffixes of
   its blocks in two stages and compares neighbours. Cores with very many different blocks are dealt out window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sliced, table, temporary, text_bytes
from .groups import key_runs
from .words import mix, powers, spaced

#: Starts in a block, and blocks of one core beyond which its windows are dealt out one by one.
BLOCK, HOT = 16, 4096
#: Such cores that are broadcast at most; more are joined by a shuffle. Blocks that a task adds up at once, cores that it
#: sorts at once, bytes of text that it looks at at once.
FEW, PIECE, CORES, SLICE = 100_000, 100_000, 5_000, 450_000
#: Bytes of a string, and words of a passage, that may start only once.
BYTES, WORDS = 400, 51
_EDGE = BLOCK - 1
_SALT = np.random.default_rng(51).integers(1, 2**63, 2, dtype=np.uint64)
_BYTE = np.random.default_rng(4).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Anchors:
    """Anchors of the windows of ``length`` symbols in each of some texts, with the starts of the windows that chose them. A symbol is a byte."""

    #: Bytes of a symbol where it is written, and the fewest bytes of a text that has so many symbols.
    width, least_bytes = 1, staticmethod(lambda length: length)

    def __init__(self, column: pa.Array, length: int):
        self.load(column)
        n, gram = self.prefix.shape[1] - 1, length // 2
        sizes = np.diff(self.at)
        self.place = self.low = self.high = self.row = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if not (sizes >= length).any():
            return
        starts = np.arange(n - gram + 1)
        hashed = self.hashes(0, starts, starts + gram)
        # the position in the low bits makes equal grams choose the first of them
        bits = np.uint64(max(22, int(n).bit_length()))
        least = (hashed >> bits << bits) | starts.astype(np.uint64)
        wide, span = 1, length - gram + 1
        while 2 * wide <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if span > wide:
            least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
        of = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
        first = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
        window = np.arange(len(of)) - first[of] + self.at[of]
        chosen = (least[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(of), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])
        begin = np.flatnonzero(new)
        self.place, self.row, self.low = chosen[begin], of[begin], window[begin]
        self.high = window[np.append(begin[1:], len(of)) - 1]
        self.hash = hashed[self.place]

    def load(self, column: pa.Array) -> None:
        self.symbols, self.at = text_bytes(column)
        n = len(self.symbols)
        power, self.inverse = powers(n + 1)
        self.prefix = np.zeros((2, n + 1), np.uint64)
        for i in range(2):
            np.cumsum(_BYTE[i][self.symbols] * power[:n], out=self.prefix[i, 1:])

    def hashes(self, i: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[i][end] - self.prefix[i][start]) * self.inverse[start])

    def places(self, row: int, found: np.ndarray) -> np.ndarray:
        """Bytes of the row's text at which its symbols with the numbers ``found`` begin."""
        return found


class WordAnchors(Anchors):
    """A symbol is a word: bytes between ASCII white space, ASCII letters in lower case."""

    width, least_bytes = 8, staticmethod(lambda length: 2 * length - 1)

    def load(self, column: pa.Array) -> None:
        _, self.bytes_at = text_bytes(column)
        w = spaced(column)
        self.symbols, self.start, self.at = w.hash, w.start, w.first
        power, self.inverse = powers(len(w.hash) + 1)
        n = len(self.symbols)
        self.prefix = np.zeros((2, n + 1), np.uint64)
        for i in range(2):
            np.cumsum(mix(self.symbols ^ _SALT[i]) * power[:n], out=self.prefix[i, 1:])

    def places(self, row: int, found: np.ndarray) -> np.ndarray:
        begin = self.start[self.at[row] : self.at[row + 1]] - self.bytes_at[row]
        return np.append(begin, self.bytes_at[row + 1] - self.bytes_at[row])[found]


UNITS: dict[str, type[Anchors]] = {"bytes": Anchors, "words": WordAnchors}

def two_stage(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of the rows of ``symbols`` (unsigned; every row ends with 0, the least symbol): positions in the flattened matrix.

    Suffixes smaller than their successors are sorted directly. All others are induced: scanning the array from its
    least suffix on, the one that begins a place earlier and is larger goes to the next free place of its first
    symbol's bucket, ahead of the directly sorted ones there. Order beyond a row's end is arbitrary.
    """
    n, width = symbols.shape
    smaller = np.zeros((n, width), bool)
    for c in range(width - 2, -1, -1):
        smaller[:, c] = (symbols[:, c] < symbols[:, c + 1]) | ((symbols[:, c] == symbols[:, c + 1]) & smaller[:, c + 1])
    flat, direct = symbols.ravel(), smaller.ravel()
    at = np.flatnonzero(direct)
    padded = np.zeros((n, 2 * width), symbols.dtype.newbyteorder(">"))
    padded[:, :width] = symbols
    suffixes = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[at // width, at % width]
    at = at[np.argsort(np.ascontiguousarray(suffixes).view(f"S{symbols.itemsize * width}").ravel(), kind="stable")]
    buckets = np.unique(flat)
    bounds = np.searchsorted(flat[at], buckets), np.searchsorted(flat[at], buckets, side="right")
    waiting: dict[int, list[np.ndarray]] = {0: [np.arange(n) * width + width - 1]}
    out: list[np.ndarray] = []

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned % width > 0] - 1
        before = before[~direct[before]]
        first = flat[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cut) if len(before) else []:
            waiting.setdefault(int(flat[part[0]]), []).append(part)

    for bucket, low, high in zip(buckets.tolist(), *(b.tolist() for b in bounds)):
        i = 0
        while i < len(waiting.get(bucket, [])):
            out.append(waiting[bucket][i])
            induce(waiting[bucket][i])
            i += 1
        waiting.pop(bucket, None)
        if high > low:
            out.append(at[low:high])
            induce(at[low:high])
    return np.concatenate(out)


def repeated(core: np.ndarray, edges: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each block (its core's number, its edges as bytes, how often it occurs) the windows that occur again, as bits."""
    n = len(core)
    outside = edges[:, -2:].astype(np.int64)
    values = edges[:, :-2]
    if values.shape[1] == 2 * _EDGE:
        symbols = np.zeros((n, 2 * _EDGE + 2), np.uint16)
        values, most = values.astype(np.uint16), 256
    else:
        symbols = np.zeros((n, 2 * _EDGE + 2), np.uint32)
        names, at = np.unique(np.ascontiguousarray(values).view(np.uint64), return_inverse=True)
        values, most = at.reshape(n, 2 * _EDGE), len(names)
    symbols[:, :_EDGE] = values[:, :_EDGE] + 1
    symbols[:, _EDGE] = most + 1 + core
    symbols[:, _EDGE + 1 : -1] = values[:, _EDGE:] + 1
    width = symbols.shape[1]
    order = two_stage(symbols)
    row, column = order // width, order % width
    # windows that run over an end of their text are none
    real = (column >= outside[row, 0]) & (column <= _EDGE - outside[row, 1])
    row, column = row[real], column[real]
    prefix = np.lib.stride_tricks.sliding_window_view(symbols, BLOCK, axis=1)[row, column]
    differs = prefix[1:] != prefix[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), BLOCK)
    run = np.concatenate([[0], np.cumsum(common < BLOCK)])
    again = np.bincount(run, times[row])[run] >= 2
    return np.bincount(row, again * 2.0**column, minlength=n).astype(np.int64)


def _again(core: np.ndarray, edges: np.ndarray, times: np.ndarray) -> np.ndarray:
    """As ``repeated``; where a core has one block only there is nothing to sort: its windows occur as often as it does."""
    low, high = edges[:, -2].astype(np.int64), BLOCK - edges[:, -1].astype(np.int64)
    out = np.where((times > 1) & (high > low), (np.int64(1) << high) - (np.int64(1) << low), 0)
    several = np.bincount(core)[core] > 1
    if several.any():
        out[several] = repeated(np.unique(core[several], return_inverse=True)[1], edges[several], times[several])
    return out


def _anchor_rows(texts: DataFrame, length: int, kind: type[Anchors]) -> DataFrame:
    """Anchor hash, the text's key and the number of the anchor's places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            a = kind(batch.column(2), length)
            order = np.lexsort((a.hash, a.row))
            row, value = a.row[order], a.hash[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            first = np.flatnonzero(new)
            of = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([pa.array(value[first].view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(np.diff(np.append(first, len(row))))], ["g", "k1", "k2", "places"])

    return texts.mapInArrow(run, "g long, k1 long, k2 long, places long")


def _block_rows(texts: DataFrame, length: int, kind: type[Anchors]) -> DataFrame:
    """Blocks at the anchors in ``again``: core hash, edges (30 symbols, and how many of them on either side lie outside the text), the windows they stand for, and where they begin in which text."""
    bytes_of = 2 * _EDGE * kind.width + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            a = kind(batch.column(1), length)
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            wanted = lists.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]]
            of = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(offsets))
            keep = np.isin(mix(a.hash + a.row.astype(np.uint64)), mix(wanted + of))
            place, row, low, high = a.place[keep], a.row[keep], a.low[keep], a.high[keep]
            least, most = (place - high) // BLOCK, (place - low) // BLOCK
            n = most - least + 1
            which = np.repeat(np.arange(len(place)), n)
            b = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + least[which]
            base = place[which] - BLOCK * b - _EDGE
            starts = base[:, None] + np.arange(BLOCK)
            valid = (((starts >= low[which][:, None]) & (starts <= high[which][:, None])) << np.arange(BLOCK)).sum(axis=1)
            row = row[which]
            # two anchors of a text whose grids agree share the block in which one follows the other: it is one block
            order = np.lexsort((base, row))
            row, base, valid = row[order], base[order], valid[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (base[1:] != base[:-1]))) if len(base) else order
            valid = np.bitwise_or.reduceat(valid, first) if len(base) else valid
            row, base = row[first], base[first]
            core = base + _EDGE
            end = core + length - _EDGE
            c1, c2 = (a.hashes(i, core, end).view(np.int64) for i in range(2))
            around = np.concatenate([base[:, None] + np.arange(_EDGE), end[:, None] + np.arange(_EDGE)], axis=1)
            inside = (around >= a.at[row][:, None]) & (around < a.at[row + 1][:, None])
            edges = np.zeros((len(around), bytes_of), np.uint8)
            if len(around):
                edges[:, :-2] = np.where(inside, a.symbols[np.clip(around, 0, len(a.symbols) - 1)], a.symbols.dtype.type(0)).view(np.uint8)
                edges[:, -2], edges[:, -1] = (~inside[:, :_EDGE]).sum(axis=1), (~inside[:, _EDGE:]).sum(axis=1)
            binary = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer((np.arange(len(edges) + 1) * bytes_of).astype(np.int32)), pa.py_buffer(edges)])
            to = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), binary, pa.array(valid.astype(np.int32)), batch.column(2).take(to), batch.column(0).take(to), pa.array(base - a.at[row])], ["c1", "c2", "edges", "valid", "copies", "tid", "base"])

    return texts.select("tid", "text", "copies", "again").mapInArrow(run, "c1 long, c2 long, edges binary, valid int, copies long, tid long, base long")


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal blocks of a task as one row with their number, before anything is sent."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held).group_by(["c1", "c2", "edges"]).aggregate([("copies", "sum")])
            yield from t.select(["c1", "c2", "edges", "copies_sum"]).rename_columns(["c1", "c2", "edges", "times"]).to_batches()
            held.clear()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PIECE:
            yield from flush()
    yield from flush()


def _repeated_windows(blocks: DataFrame, width: int) -> DataFrame:
    """c1, e (a hash of the rest of a block), again: the windows of each distinct block that occur more than once."""
    hot = materialize(blocks.groupBy("c1").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("c1"), "hot-cores")
    kinds = blocks.select("c1", "c2", "edges", "copies").mapInArrow(_added_up, "c1 long, c2 long, edges binary, times long")
    many = hot.count()
    few = F.broadcast(hot) if many <= FEW else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in key_runs(batches, 2):
            for low in range(0, len(at) - 1, CORES):
                high = min(len(at) - 1, low + CORES)
                part = batch.slice(int(at[low]), int(at[high] - at[low]))
                core = np.repeat(np.arange(high - low), np.diff(at[low : high + 1]))
                edges = text_bytes(part.column(2))[0].reshape(part.num_rows, -1)
                # the same block from several tasks comes in neighbouring rows
                new = np.append(True, (core[1:] != core[:-1]) | (edges[1:] != edges[:-1]).any(axis=1))
                first = np.flatnonzero(new)
                again = _again(core[first], edges[first], np.add.reduceat(part.column(3).to_numpy(), first))
                part = part.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(again)], ["c1", "c2", "edges", "again"]).filter(pa.array(again > 0))

    cold = kinds.join(few, "c1", "left_anti") if many else kinds
    found = cold.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "edges").mapInArrow(run, "c1 long, c2 long, edges binary, again long")
    rest = F.xxhash64("c2", "edges").alias("e")
    found = found.select("c1", rest, "again")
    if not many:
        return found
    single = kinds.join(few, "c1").select("c1", "c2", "edges", "times", F.explode(F.sequence(F.lit(0), F.lit(_EDGE))).alias("j"))
    # as in repeated(): only windows within their text
    out = [F.conv(F.hex(F.expr(f"substring(edges, {2 * _EDGE * width + k}, 1)")), 16, 10).cast("int") for k in (1, 2)]
    single = single.where((F.col("j") >= out[0]) & (F.col("j") <= F.lit(_EDGE) - out[1])).withColumn("w", F.expr(f"substring(edges, j * {width} + 1, {_EDGE * width})"))
    # written, so that both sides of the join are plain shuffles, which Spark splits where one window is very frequent
    twice = materialize(single.groupBy("c1", "c2", "j", "w").agg(F.sum("times").alias("n")).where("n > 1").select("c1", "c2", "j", "w"), "hot-windows")
    spread = single.join(twice, ["c1", "c2", "j", "w"]).select("c1", rest, "j").distinct().groupBy("c1", "e").agg(F.sum(F.expr("shiftleft(1L, j)")).alias("again"))
    return found.unionByName(spread)


def spans(windows: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of symbols that repeated windows (rows of a block's first window and its bits) cover, as (start, end) rows."""
    base, bits = windows.reshape(-1, 2).T
    i, j = np.nonzero((bits[:, None] >> np.arange(BLOCK)) & 1)
    starts = np.unique(base[i] + j)
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return np.stack([starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + length], axis=1)


def text_keys(text: F.Column) -> list[F.Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]


def repeated_spans(docs: DataFrame, length: int = BYTES, unit: str = "bytes", text_col: str = "text") -> DataFrame:
    """k1, k2 (a text's 128-bit key), n_removed (symbols), n_spans, kept (the bytes that stay), kept_sha256: one row for each distinct text that loses something.

    Equal texts have equal results, so each is searched once, with its number of rows; a text of ``length`` symbols or
    more with two rows loses all. The rows lie in the shared folder, the tables on the way to them are deleted.
    """
    kind = UNITS[unit]
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            out, a = [], kind(batch.column(2), length)
            for row, (raw, w) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                found = spans(np.stack([w.values.field(0).to_numpy(), w.values.field(1).to_numpy()], axis=1), length)
                n, found = int((found[:, 1] - found[:, 0]).sum()), a.places(row, found)
                kept = b"".join(raw[x:y] for x, y in zip([0, *found[:, 1].tolist()], [*found[:, 0].tolist(), len(raw)]))
                out.append((n, len(found), kept, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["k1", "k2", "n_removed", "n_spans", "kept", "kept_sha256"])

    with temporary(docs.sparkSession):
        keyed = docs.select(*text_keys(text), text.alias("text")).where(F.octet_length("text") >= kind.least_bytes(length))
        anchors = materialize(_anchor_rows(keyed, length, kind), "anchors")
        again = anchors.groupBy("g").agg(F.sum("places").alias("n")).where("n > 1").select("g")
        wanted = anchors.join(again, "g").select("k1", "k2", "g").groupBy("k1", "k2").agg(F.collect_set("g").alias("again"))
        texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        # the number of a text is fixed by writing it
        found = materialize(texts.join(wanted, ["k1", "k2"]).select(F.monotonically_increasing_id().alias("tid"), "k1", "k2", "text", "copies", "again"), "candidates")
        blocks = materialize(_block_rows(found, length, kind), "windows")
        places = blocks.select("c1", F.xxhash64("c2", "edges").alias("e"), "tid", "base", "valid")
        windows = places.join(_repeated_windows(blocks, kind.width), ["c1", "e"]).select("tid", "base", F.col("again").bitwiseAND(F.col("valid").cast("long")).alias("bits")).where("bits <> 0")
        windows = windows.groupBy("tid").agg(F.collect_list(F.struct("base", "bits")).alias("windows"))
        done = found.select("tid", "k1", "k2", "text").join(windows, "tid").select("k1", "k2", "text", "windows")
        return materialize(done.mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept binary, kept_sha256 string"), "repeats", keep=True)


def removal_report(docs: DataFrame, length: int = BYTES, unit: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``.

    A symbol (a byte, or a word) goes if a string of ``length`` symbols over it starts anywhere else too, in the same text
    or another; all places lose it. n_removed counts symbols, n_spans maximal runs of them, kept_sha256 is of the bytes that
    stay. Null and empty texts have no bytes, shorter texts keep all; a null id stays null; each repeated row is a text of
    its own. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    found = repeated_spans(docs, length, unit, text_col).select("k1", "k2", "n_removed", "n_spans", "kept_sha256")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")]
    return each.join(found, ["k1", "k2"], "left").select("doc_id", "n_bytes", *counts, F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = BYTES, unit: str = "bytes", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, without the strings of ``length`` symbols that start more than once.

    Bytes of a character that a cut leaves in part go too; by words, the white space after them goes with them.
    """
    found = repeated_spans(docs, length, unit, text_col).select("k1", "k2", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.decode("utf-8", "ignore") for x in batch.column(2).to_pylist()], pa.string())], ["k1", "k2", "kept"])

    return _replaced(docs, found.mapInArrow(run, "k1 long, k2 long, kept string"), text_col)


def _replaced(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``docs`` with the text that ``found`` (k1, k2, kept) has for theirs."""
    names = docs.columns
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    both = docs.select(*text_keys(text), row.alias("row")).join(found, ["k1", "k2"], "left")
    return both.select(*[F.coalesce("kept", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, strings of 400 bytes."""
    return removal_report(table(spark, sf_dir, "documents"))
