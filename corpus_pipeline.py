"""Documents made ready for training: five stages, each on what the one before has kept.

Every stage reads whole texts, however long. An empty table gives no rows. Columns beyond those of
``documents`` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postsignal.llm import chunk_dedup, mixing, ngram_join, pieces, toxicity
from postsignal.session import written


def toxic_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted to be toxic, those that score at or above the limit.

    Null and empty texts score like a text without any toxic word; null ids and repeated rows are
    scored by their texts like all others.
    """
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those that are equal without their blanks: the longest, then the smallest id.

    Null and empty texts are equal to each other. Null ids come after all others. Of rows that repeat
    an id and a text, one stays.
    """
    return chunk_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group linked by five-word shingles at 0.8.

    Texts without words and rows without an id are in no group and stay. Rows that repeat an id are
    one document: all of them stay or none.
    """
    return ngram_join.one_of_each(docs, ngram_join.Rule(words=5, percent=80))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, once per turn, the last turn cut at a word.

    Null, empty and blank texts have no words and are not taken. Null sources are a source of their
    own. Rows that share id, source and size share what is taken of them, rounded up for each.
    """
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces, and whether they decode to its text.

    Null and empty texts have no ids. Null ids stay null. Repeated rows are all returned. Other
    columns are left out.
    """
    return pieces.encoded_and_decoded(docs)


STAGES = [
    ("toxicity", toxic_free),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("mixing", source_mix),
    ("sentencepiece", piece_ids),
]

#: No SQL: a trained tagger and a shortest path are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
