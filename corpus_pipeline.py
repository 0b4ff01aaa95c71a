"""The corpus pipeline: documents in, packed sequences out. Belongs to the ``llm`` subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import contamination, neardup, packing, quality, suffixes
from panelforge.llm.common import materialize, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among ``docs``."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a similarity of at least 0.8 by five-word shingles."""
    return neardup.one_of_each(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 51 words and then the strings of 400 bytes that start more than once."""
    return suffixes.without_repeats(suffixes.without_repeats(docs, suffixes.WORDS, "words"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return contamination.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 ids; written through small Arrow batches, as the pieces are few bytes."""
    return materialize(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")), "packed")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("repeats", repeat_removal),
    ("decontamination", decontamination),
    ("packing", sequence_packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage keeps is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path, compression="zstd")
        docs = spark.read.parquet(path)
    return docs
