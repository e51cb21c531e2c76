"""The ten queries of this subpackage, their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import byte_bpe, cotraining, fm_index, inner_product, keyed_store, near_duplicates, nearest, packing, suffix_dedup, toxicity, vocabulary
from lexiloom.sources import corpus


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return corpus.table(spark, sf_dir, name)


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), every=50, top=5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = vocabulary.read_vocabulary(tokenizer_path("byte_bpe_50k.json"))
    return packing.piece_digest(packing.pack(table(spark, sf_dir, "documents"), spec, window=1024, end_id=0))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"), width=400)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = vocabulary.read_vocabulary(tokenizer_path("word_bpe_49k.json"))
    return keyed_store.read_store(keyed_store.write_store(table(spark, sf_dir, "documents"), spec, end_id=2))


def op6_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.report(table(spark, sf_dir, "documents"), width=35)


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.top_inner_products(table(spark, sf_dir, "embeddings"), every=50, top=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=2, threshold=0.8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining": op1_cotraining,
    "op2_multi_index": op2_multi_index,
    "op3_packing": op3_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_store": op5_token_store,
    "op6_fm_dedup": op6_fm_dedup,
    "op7_top_products": op7_top_products,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLE_SQL: dict[str, str] = {
    "op7_top_products": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
