"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word a title must have and the two prefixes it must not have.
NEWS_WORD = "新聞"
NOT_NEWS = ["Re: [新聞]", "Fw: [新聞]"]


def is_news(title: Column) -> Column:
    """True for news posts that are neither replies nor forwards."""
    keep = title.contains(NEWS_WORD)
    for prefix in NOT_NEWS:
        keep = keep & ~title.contains(prefix)
    return keep


def news_posts(posts: DataFrame) -> DataFrame:
    return posts.filter(is_news(F.col("title")))


def keep_last(posts: DataFrame, cols: list[str] | None = None, key: str = "post_id") -> DataFrame:
    """One row per distinct value of ``cols``, by default all but the key: one of the largest ``key``.

    Rows are grouped by a 256-bit digest and the kept one travels with the maximum, which is combined
    before the shuffle: a text with very many copies costs no more than one row per task, a key may
    occur any number of times, and no join follows. Nulls and the borders between columns are part of
    the digest.
    """
    parts = [
        F.when(F.col(c).isNull(), F.lit("-")).otherwise(
            F.concat(
                F.octet_length(F.col(c).cast("string")).cast("string"),
                F.lit(":"),
                F.col(c).cast("string"),
            )
        )
        for c in (cols or [c for c in posts.columns if c != key])
    ]
    last = F.max_by(F.struct(*posts.columns), F.struct(key)).alias("_row")
    return posts.groupBy(F.sha2(F.concat(*parts), 256).alias("_digest")).agg(last).select("_row.*")
