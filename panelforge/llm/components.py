"""Connected components over link tables, without a driver-side union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def min_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the least node that each reaches through them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label != (up := label[label])).any():
            label = up


def _contracted(links: DataFrame) -> DataFrame:
    """Each task's links as stars around their least node: never more rows, and each node once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, least = min_labels(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            keep = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(least[keep])], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


#: Links that one task joins; beyond it the rounds below do.
SMALL = 1_000_000


def _joined(links: DataFrame) -> DataFrame:
    """The components of at most ``SMALL`` links, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            nodes, least = min_labels(t.column(0).to_numpy(), t.column(1).to_numpy())
            keep = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(least[keep])], ["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least node it reaches) for every node of ``links`` (a, b) that isn't its own component.

    Alternating small and large stars: each round every node points its neighbours at the least node it sees, by one
    aggregation and one join, so that a node of any degree is handled by partial aggregation and split joins. A round's
    links are written to the shared folder. Null ends and links of a node to itself are ignored.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    links = materialize(_contracted(links).distinct(), name)
    if links.count() <= SMALL:
        return materialize(_joined(links), name)
    before = None
    while True:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        small = links.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        small = materialize(small, name)
        both = small.union(small.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        links = materialize(large, name)
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
