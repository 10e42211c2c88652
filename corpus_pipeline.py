"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next one.

What each stage does with null, empty, very long and repeated rows and with other columns is told by the operator it calls;
every stage but the last one keeps the columns as they are, and gives no rows for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, exact_dedup, pieces, shingle_dedup, simhash
from tidemark.llm import toxicity as toxic
from tidemark.llm.common import configure, release, scratch, staged, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the model of the labelled documents."""
    return toxic.drop_toxic(docs, table(configure(spark), sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    configure(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints at most 4 bits apart; then one of each group of the rest
    linked by five-word shingles with a similarity of 0.8 or more, most of which fingerprints leave apart."""
    configure(spark)
    with scratch() as keep:
        apart = keep(staged(simhash.drop_near_copies(docs), "simhash-apart"))
    out = shingle_dedup.drop_similar(apart)
    release(apart)  # the result reads the stages of the shingles
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(configure(spark), sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids in place of their text, with the scores of the n best segmentations."""
    configure(spark)
    return pieces.encode(docs, into="__pieces").select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("__pieces.ids").alias("piece_ids"),
        F.col("__pieces.score").alias("piece_score"), F.transform("__pieces.others", lambda o: o["score"]).alias("other_scores"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_encoding", encoding),
]

#: A trained model, components and segmentations are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
