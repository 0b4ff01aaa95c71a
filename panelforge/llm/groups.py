"""Runs of equal keys in sorted record batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups and their bounds; rows arrive sorted by the first ``keys`` columns (integers).

    What is held back is the group that a batch may have cut.
    """
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        same = np.ones(batch.num_rows, bool)
        for c in columns:
            same &= c == c[-1]
        last = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if last == 0 and held and all(held[-1].column(i)[-1].as_py() == batch.column(i)[0].as_py() for i in range(keys)):
            held.append(batch)
            continue
        whole = joined([*held, batch.slice(0, last)]) if last else (joined(held) if held else None)
        held = [batch.slice(last)]
        if whole is not None and whole.num_rows:
            yield whole, _bounds(whole, keys)
    if held:
        whole = joined(held)
        yield whole, _bounds(whole, keys)


def _bounds(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for i in range(keys):
        c = batch.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)
