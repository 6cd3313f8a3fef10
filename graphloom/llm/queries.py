"""The registered queries of these operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, packing, simhash, substring, token_counts, topk, toxicity, url_filter
from .common import read as _read
from .common import settings


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return _read(settings(spark), sf_dir, table)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"))


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.items(read(spark, sf_dir, "documents")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bpe.round_trip(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), PATTERN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_exact_topk, op3_kmeans_tree, op4_best_fit_packing, op5_byte_bpe, op6_language_id, op7_toxicity, op8_substring_dedup, op9_token_counts, op10_simhash)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Of the ten, only the exact search is plain SQL; the others are tested against brute force."""
    return {
        "op2_exact_topk": """
            WITH whole AS (
              SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS g
              FROM embeddings
              WHERE vec_id IS NOT NULL AND len(embedding) > 0
                AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
            ), scored AS (
              SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.g, c.g) AS BIGINT) AS score
              FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.g) = len(c.g)
              WHERE q.vec_id % 100 = 0
            )
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
            WHERE rank <= 10"""
    }
