"""From raw documents to packed training sequences: five stages, each written and read again as the next one's input.

Every stage takes null texts and ids, empty and very long texts, repeated rows, empty tables and further columns of any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from podium.llm.common import table
from podium.llm.line_dedup import drop_lines
from podium.llm.near_dedup import drop_near_duplicates
from podium.llm.packing import pack_documents
from podium.llm.quality import drop_poor
from podium.llm.queries import vocabulary
from podium.llm.toxicity import drop_toxic
from podium.session import Stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Null texts score the intercept, repeated rows go or stay together."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality, by their own measures and their site, go. Null ids and texts are judged like others."""
    return drop_poor(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines the first one stays; every document stays with what is left of its text. Null texts stay null."""
    return drop_lines(docs, length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest id stays, of repeated rows one. Documents without words are like no other."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, as pieces of documents. Null text is empty: one piece, the end id."""
    return pack_documents(docs, vocabulary(), end_id=0, window=1024)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("quality_classifier", quality_classifier), ("line_dedup", line_dedup),
                                   ("near_dedup", near_dedup), ("packing", packing)]
#: Tokenizer, learnt models and Hamming join have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder, and dropped when it has been used."""
    stages, docs = Stages(spark, "corpus-pipeline"), table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stages.write(stage(spark, docs, sf_dir), name)
        if n:
            stages.drop(STAGES[n - 1][0])
    return docs
