"""Semantic records with their vector views."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MissingArtifact
from ..functions.scalars import unit


@dataclass(frozen=True)
class SemanticDataset:
    """``records`` by ``key`` and tables of vectors (key, embedding) by view name."""

    records: DataFrame
    views: Mapping[str, DataFrame] = field(default_factory=dict)
    key: str = "record_id"

    def list_views(self) -> list[str]:
        return sorted(self.views)

    def has_view(self, name: str) -> bool:
        return name in self.views

    def view(self, name: str, normalize: bool = False) -> DataFrame:
        """The vectors of a view, of unit length if asked for; an unknown name raises."""
        if name not in self.views:
            raise MissingArtifact(f"no view {name}")
        v = self.views[name].select(self.key, "embedding")
        return v.withColumn("embedding", unit(F.col("embedding"))) if normalize else v

    def record(self, key) -> DataFrame:
        """The record's row; an unknown key raises KeyError."""
        row = self.records.where(F.col(self.key) == key)
        if row.isEmpty():
            raise KeyError(key)
        return row

    def num_rows(self) -> int:
        return self.records.count()

    def with_metadata(self, dimension: DataFrame, by: str, theirs: str) -> SemanticDataset:
        """Records with the dimension's further columns; NULLs where it lacks the key."""
        new = [c for c in dimension.columns if c not in self.records.columns and c != theirs]
        x = dimension.select(F.col(theirs).alias("_theirs"), *new)
        return SemanticDataset(self.records.join(x, F.col(by) == F.col("_theirs"), "left").drop("_theirs"), self.views, self.key)
