"""Term counts, tf-idf weights and keywords, as long tables keyed by post and term."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import packets

# These functions travel to the workers with the job, whatever the import path there is.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def default_tokens() -> Column:
    """Words of the segmented text, so a run of Han characters gives its pairs and not one term.

    Words are the same whether punctuation is set apart or not, so only Han runs are.
    """
    return text.paired_words(F.col("content"))


def term_counts(posts: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``(post_id, term, tf)``. Counted inside each row: no shuffle."""
    tokens = default_tokens() if tokens is None else tokens
    return posts.select("post_id", F.inline(text.term_frequencies(tokens)))


def term_stats(counts: DataFrame) -> DataFrame:
    """Document frequency ``df`` and total frequency ``cf`` per term."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def document_frequencies(posts: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``(term, df)`` alone: terms are made distinct in the row, without counting them."""
    tokens = default_tokens() if tokens is None else tokens
    terms = posts.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def tfidf_weights(
    posts: DataFrame, tokens: Column | None = None, fit_on: DataFrame | None = None
) -> DataFrame:
    """``(post_id, term, tf, df, weight)``: tf · (ln((1+n)/(1+df)) + 1), unit length per post.

    Frequencies come from ``fit_on``, by default from ``posts`` themselves, in which case later
    posts influence earlier ones. Terms that ``fit_on`` lacks are dropped.

    Texts are tokenised once, into packets of posts with their counts. Document frequencies are summed
    from the packets, and only a packet's distinct terms meet them, not those of every post. A post's
    squares are added up in its packet; only where identifiers are missing or repeated, rows of one
    identifier, which make up one vector, are shuffled for that.
    """
    tokens = default_tokens() if tokens is None else tokens
    held = packets.packed(posts, tokens, count=True)
    if fit_on is None:
        counted = held.select(F.inline(F.arrays_zip("terms", "df"))).toDF("term", "df")
        frequencies = counted.groupBy("term").agg(F.sum("df").alias("df"))
        n_posts = held.agg(F.sum(F.size("post_ids"))).scalar()
    else:
        frequencies = document_frequencies(fit_on, tokens)
        n_posts = fit_on.agg(F.count("*")).scalar()
    idf = F.log((F.lit(1) + n_posts) / (F.lit(1) + F.col("df"))) + F.lit(1.0)
    kind = posts.schema["post_id"].dataType.simpleString()
    found = packets.answered(
        held,
        frequencies.select("term", "df", idf.alias("idf")),
        ["df", "idf"],
        _weighted,
        f"post_id {kind}, term string, tf bigint, df bigint, _raw double, _square double",
    )
    raw = F.col("_raw")
    square = F.col("_square") if packets.alone(held) else F.sum(raw * raw).over(Window.partitionBy("post_id"))
    return found.withColumn("weight", raw / F.sqrt(square)).select("post_id", "term", "tf", "df", "weight")


def _weighted(packet: dict, known: pa.Table) -> pa.Table:
    """A packet's counts of known terms with tf · idf, and the sum of its squares per post."""
    place, n = known.column("place").to_numpy(), len(packet["terms"])
    df, idf = np.zeros(n, np.int64), np.full(n, np.nan)
    df[place], idf[place] = known.column("df").to_numpy(), known.column("idf").to_numpy()
    post = np.repeat(np.arange(len(packet["sizes"])), packet["sizes"].to_numpy())
    there = ~np.isnan(idf)[packet["codes"]]
    post, code, tf = post[there], packet["codes"][there].astype(np.int64), packet["times"][there].astype(np.int64)
    raw = tf * idf[code]
    square = np.bincount(post, raw * raw, len(packet["sizes"])).astype(np.float64)[post]  # whole numbers if empty
    columns = {"post_id": packet["post_ids"].take(pa.array(post)), "term": packet["terms"].take(pa.array(code))}
    return pa.table({**columns, "tf": tf, "df": df[code], "_raw": raw, "_square": square})


def keywords(weights: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Terms whose weight is strictly above ``threshold``.

    Weights of a post have unit length, so at most 1/threshold² terms of a post can pass.
    """
    return weights.filter(F.col("weight") > threshold).select("post_id", "term", "weight")


def keyword_lists(posts: DataFrame, kept: DataFrame) -> DataFrame:
    """``(post_id, words)`` with words in code-point order; posts without any get an empty array."""
    lists = kept.groupBy("post_id").agg(F.array_sort(F.collect_list("term")).alias("words"))
    return posts.select("post_id").join(lists, "post_id", "left").select(
        "post_id", F.coalesce("words", F.array().cast("array<string>")).alias("words")
    )


def to_string(words: Column) -> Column:
    """Word list as one ``;``-joined string, the form used in CSV files."""
    return F.array_join(words, ";")


def from_string(joined: Column) -> Column:
    """Word list from its string form; null and ``''`` give an empty array."""
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(joined, F.lit("")) == "", empty).otherwise(F.split(joined, ";"))
