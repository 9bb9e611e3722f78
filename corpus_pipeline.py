"""A corpus pipeline: language ID, exact dedup, near dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of
its ``docs``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import exact_dedup, jaccard, langid, mixing, packing
from ledgerloom.llm.common import drop, written_alone


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the nearest-centroid model accepts.

    Texts that are null, empty or without a letter go. Where no row has a
    language, no model can be fitted and all rows go.
    """
    model = langid.fit(docs.where(langid.fold("doc_id", 4) != 2))
    return langid.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id.

    Null and empty texts are equal; a null id goes where a text has another id.
    """
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents without words, and those with a null id, stay.
    """
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are not taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a document taken more than once is packed as often.

    Null and empty texts are a closing id alone.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("source_mixing", mix),
    ("packing", pack),
]
#: Language ID and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        drop(*made)
        made = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
