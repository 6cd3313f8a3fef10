"""From raw documents to packed training bins, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, packing, simhash, substring, toxicity
from graphloom.llm.common import read, settings, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among ``docs``, calls toxic go.

    Null and empty texts are judged as empty ones, repeated rows alike; an empty table stays empty,
    and without labels of both kinds all documents stay. Other columns pass through.
    """
    settings(spark)
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no learned language describes, go.

    Null and empty texts have no letter. Repeated rows are judged alike; an empty table stays empty,
    and without any lang in the training folds all documents stay. Other columns pass through.
    """
    settings(spark)
    return langid.accepted(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 0.8 or more of their five-word shingles, the smallest id stays.

    Texts without words, null ones too, are alike. Rows with a null id stay, as do all rows of a kept
    id. An empty table stays empty; other columns pass through.
    """
    settings(spark)
    return simhash.deduplicated(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of smaller id holds are cut out.

    Documents left without a word go; those that lose nothing, null and empty texts among them, stay
    as they are. Rows of one id are not held against each other. An empty table stays empty.
    """
    settings(spark)
    return substring.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of words in which no source and no text occurs twice.

    Texts without words get a row with a null bin; a null source never conflicts; repeated rows are
    packed each; an empty table gives no rows.
    """
    settings(spark)
    return packing.pack(packing.items(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("language_id", in_known_language),
    ("simhash_near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("best_fit_packing", packed),
]

#: Trained models and chained alignments have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
