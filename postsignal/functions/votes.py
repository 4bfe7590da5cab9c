"""Vote columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks readers put in front of a comment.
PUSH_MARK = "推"
HATE_MARK = "噓"


def vote_code(tag: Column) -> Column:
    """1 for a push mark, -1 for a hate mark, else 0. A push mark wins over a hate mark."""
    return F.when(tag.contains(PUSH_MARK), 1).when(tag.contains(HATE_MARK), -1).otherwise(0)


def vote_counts(score: Column) -> list[Column]:
    """Aggregates ``n_push``, ``n_hate``, ``n_neutral`` over a column of vote codes."""
    return [
        F.count_if(score == code).alias(name)
        for name, code in (("n_push", 1), ("n_hate", -1), ("n_neutral", 0))
    ]


def total_score(comments: Column) -> Column:
    """Sum of the vote codes of a comment array; 0 when there are none."""
    return F.aggregate(
        F.coalesce(comments["score"], F.array().cast("array<int>")),
        F.lit(0).cast("long"),
        lambda total, score: total + F.coalesce(score, F.lit(0)),
    )
