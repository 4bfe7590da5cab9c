"""The six-hourly work as streams: vote tallies per step, and scores for posts as they come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.votes import vote_counts
from ..operators.trend import topic_scores


def step_tallies(comments: DataFrame, step: str = "6 hours", late: str = "6 hours") -> DataFrame:
    """Votes per step from a stream of ``ts, score``; comments later than ``late`` are not counted."""
    return (
        comments.withWatermark("ts", late)
        .groupBy(F.window("ts", step).alias("step"))
        .agg(*vote_counts(F.col("score")))
        .select(
            F.col("step.start").alias("low"),
            F.col("step.end").alias("up"),
            "n_push",
            "n_hate",
            "n_neutral",
        )
    )


def kept_tallies(comments: DataFrame, out: str, checkpoint: str, step: str = "6 hours") -> StreamingQuery:
    """Writes the tallies of all steps so far after every batch of what has arrived.

    The stream ends when it has read what is there; started again with the same ``checkpoint``, it goes
    on with the sums it had. Every batch has its own folder, ``batch=<number>``, and overwrites itself
    when it is run again; the greatest number is the newest state.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        step_tallies(comments, step).writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest(spark: SparkSession, out: str) -> DataFrame:
    """The tallies after the last batch."""
    every = spark.read.parquet(out)
    return every.join(every.agg(F.max("batch").alias("batch")), "batch").drop("batch")


def score_stream(
    topics: DataFrame,
    newest_index: Callable[[], DataFrame],
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Scores each arriving batch of ``post_id, topics`` with the newest topic index.

    ``topics`` is ``array<struct<topic, p>>``: a post is one row, so no batch border can divide it.
    ``newest_index`` is asked once per batch for ``topic, avg_*``. A batch is written under its own
    number and overwrites itself when it is run again.
    """

    def score(batch: DataFrame, number: int) -> None:
        index = newest_index().withColumn("window_id", F.lit(0))
        shares = batch.select("post_id", F.lit(0).alias("window_id"), F.inline("topics"))
        scored = topic_scores(shares, index)
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        topics.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
