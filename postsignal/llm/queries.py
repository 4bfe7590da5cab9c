"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, licenses, lm, merkle, mixing, ngram_join, pieces, secrets, simhash, sketches, toxicity, url_filter, vector_codes


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.components(_read(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    made = mixing.mix(_read(spark, folder, "documents"))
    return made.select("doc_id", "size", "source_size", "target", "taken", "source", "first_at")


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded_and_decoded(_read(spark, folder, "documents"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find(_read(spark, folder, "documents")))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.groups(_read(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    made = toxicity.score(_read(spark, folder, "documents"), _read(spark, folder, "labels"))
    return made.select("doc_id", "held_out", "score", "predicted", "spans")


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_read(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_read(spark, folder, "pages"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.fingerprints(_read(spark, folder, "documents"))


def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_read(spark, folder, "documents"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    made = vector_codes.codes(_read(spark, folder, "embeddings"))
    return made.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.components(_read(spark, folder, "documents"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.proofs(_read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_mixing": op2_mixing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_secrets": op4_secrets,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_licenses": op7_licenses,
    "op8_url_filter": op8_url_filter,
    "op9_fingerprints": op9_fingerprints,
    "op10_lm_scores": op10_lm_scores,
    "op11_vector_codes": op11_vector_codes,
    "op12_simhash": op12_simhash,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op11_vector_codes": vector_codes.codes_sql(),
    "op13_merkle": merkle.PROOFS_SQL,
    "op5_exact_dedup": r"""
        with d as (
          select doc_id, length(coalesce(text, '')) as n_cp,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
          from documents),
        k as (
          select *, first_value(doc_id) over (partition by text_sha256 order by n_cp desc, doc_id) as keep_id,
                 cast(count(*) over (partition by text_sha256) as bigint) as group_size
          from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from k""",
}
