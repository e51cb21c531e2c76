"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import cotraining, near_duplicates, packing, queries, scratch, suffix_dedup, toxicity, vocabulary

#: Bytes from which a repeated passage is cut out; 51 words of prose are longer, but 51 words of one or two letters can have as few as 101 bytes and stay.
PASSAGE_BYTES = 200
PASSAGE_GRAM = 48

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    """When a stage begins, the one before it has been written: its scratch tables can go."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, "pipeline")
        with scratch.scope("pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels")))


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views call bad go."""
    return cotraining.keep_good(docs, cotraining.fit(docs, queries.table(spark, sf_dir, "labels")))


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that resemble each other (five-word shingles, similarity 0.8) the first stays."""
    return near_duplicates.one_of_each(docs, width=5, threshold=0.8)


@_stage
def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start more than once are cut out of the texts."""
    return suffix_dedup.dedup(docs, PASSAGE_BYTES, PASSAGE_GRAM)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that fill windows of 1024 ids."""
    spec = vocabulary.read_vocabulary(queries.tokenizer_path("byte_bpe_50k.json"))
    return packing.piece_digest(packing.pack(docs, spec, window=1024, end_id=0, keep_loaded=False, block_bytes=1 << 20))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", passage_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained stages; tests/llm compare each stage with brute force or held-out labels, on what the stages before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    A stage's output goes when the next one is written; the last one stays for
    the result, until ``scratch.clear`` or the end of the application.
    """
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch.scope(f"pipeline {name}"):
            path = scratch.new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        scratch.release(spark, "pipeline")
        if before:
            scratch.release(spark, f"pipeline {before}")
        docs, before = spark.read.parquet(path), name
    return docs
