"""Vocabulary numbers, padded word-id arrays, one-hot arrays and the joined feature array."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import written
from . import packets
from .ranking import ordered_rank

# These functions travel to the workers with the job, whatever the import path there is.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tokenized(docs: DataFrame) -> DataFrame:
    """The words of ``docs(post_id, cleaned)`` as a stored table of packets, which the functions below take for ``docs``."""
    return docs if "packet" in docs.columns else packets.packed(docs, text.encoder_words(F.col("cleaned")))


def first_seen(docs: DataFrame) -> DataFrame:
    """``(term, first_doc, first_pos)`` over ``docs(post_id, cleaned)`` or packets, posts taken in id order.

    ``array_distinct`` keeps first occurrences in order, so the place among a post's distinct
    terms orders them like the place in its text, which packets have.
    """
    if "packet" in docs.columns:
        places = docs.select(F.inline(F.arrays_zip("terms", "first_docs", "first_pos"))).toDF("term", "post_id", "pos")
    else:
        tokens = text.encoder_words(F.col("cleaned"))
        places = docs.select("post_id", F.posexplode(F.array_distinct(tokens)).alias("pos", "term"))
    return places.groupBy("term").agg(F.min("post_id").alias("first_doc"), F.min_by("pos", "post_id").alias("first_pos"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(term, term_id)`` numbered from 1 in the order terms are first seen; 0 stays free."""
    distinct = written(first_seen(docs))
    ranked = ordered_rank(distinct, ["first_doc", "first_pos"], "term_id")
    return ranked.select("term", "term_id")


def max_length(docs: DataFrame) -> Column:
    """Largest number of blank-separated pieces of any document, as a scalar subquery."""
    return docs.agg(F.max(text.blank_count(F.col("cleaned")))).scalar()


def fitted(ids: Column, length: Column) -> Column:
    """``ids`` cut to ``length`` or filled up with zeros."""
    missing = F.greatest(length - F.size(ids), F.lit(0))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), missing)), F.lit(1), length)


def encoded_docs(docs: DataFrame, vocab: DataFrame, length: Column | None = None) -> DataFrame:
    """``(post_id, word_ids)``: term numbers in text order, unknown terms as 0, ``length`` long if given.

    Posts are kept in packets whose distinct terms meet the vocabulary, not one row per token or per post
    and term. Rows of one identifier have their words put together, place by place; rows without one get
    none. Store arrays as long as their texts (``length=None``) and pad where batches are made: padded to
    the longest text, every row costs as much as that one.
    """
    held = tokenized(docs)
    kind = held.schema["post_ids"].dataType.elementType.simpleString()
    found = packets.answered(held, vocab, ["term_id"], _numbered, f"post_id {kind}, word_ids array<bigint>")
    if not packets.alone(held):
        found = _put_together(held.select(F.explode("post_ids").alias("post_id")), found)
    ids = F.col("word_ids")
    return found.select("post_id", (ids if length is None else fitted(ids, length)).alias("word_ids"))


def _numbered(packet: dict, known: pa.Table) -> pa.Table:
    """A packet's posts with term numbers; terms that are not known stay 0."""
    number = np.zeros(len(packet["terms"]), np.int64)
    number[known.column("place").to_numpy()] = known.column("term_id").to_numpy()
    offsets = np.concatenate([[0], np.cumsum(packet["sizes"].to_numpy())])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(number[packet["codes"]]))
    return pa.table({"post_id": packet["post_ids"], "word_ids": lists})


def _put_together(ids: DataFrame, found: DataFrame) -> DataFrame:
    placed = F.transform("word_ids", lambda x, i: F.struct(i.alias("pos"), x.alias("id")))
    runs = found.groupBy("post_id").agg(F.collect_list(placed).alias("runs"))
    joined = ids.join(runs, "post_id", "left")
    words = F.coalesce(F.array_sort(F.flatten("runs"))["id"], F.array().cast("array<bigint>"))
    return joined.select("post_id", words.alias("word_ids"))


def padded_by(rows: DataFrame, batch: str) -> DataFrame:
    """``rows`` with ``word_ids`` filled up to the longest of each ``batch``."""
    longest = rows.groupBy(batch).agg(F.max(F.size("word_ids")).alias("_longest"))
    return rows.join(longest, batch).withColumn("word_ids", fitted(F.col("word_ids"), F.col("_longest"))).drop("_longest")


def one_hot(label: Column, labels: list[str]) -> Column:
    """Array with 1.0 at the place of the label in the sorted ``labels`` and 0.0 elsewhere."""
    return F.array(*[F.when(label == name, 1.0).otherwise(0.0) for name in sorted(labels)])


def feature_array(ids: Column, scores: list[Column], hot: Column) -> Column:
    """Word ids, then the three scores, then the one-hot values, as one array of doubles."""
    return F.concat(ids.cast("array<double>"), F.array(*scores), hot)
