"""Votes per post and whole-post scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.votes import vote_counts


def vote_tally(comments: DataFrame) -> DataFrame:
    """``n_push``, ``n_hate``, ``n_neutral`` per post from rows with a vote code ``score``.

    The counts are combined before the shuffle, so a post with most of the comments is no burden.
    """
    return comments.groupBy("post_id").agg(*vote_counts(F.col("score")))


def post_score(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Sum of vote codes for every post, 0 where there are no comments."""
    sums = comments.groupBy("post_id").agg(F.sum("score").alias("score"))
    return posts.select("post_id").join(sums, "post_id", "left").select(
        "post_id", F.coalesce("score", F.lit(0)).cast("long").alias("score")
    )
