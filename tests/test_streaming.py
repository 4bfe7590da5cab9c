from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postsignal.streaming import rescore


def test_step_tallies(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h), (h % 3) - 1) for h in range(30)]
    schema = "ts timestamp, score int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        rescore.step_tallies(stream).writeStream.outputMode("complete").format("memory").queryName("tallies")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.table("tallies").agg(F.count("*"), F.sum("n_push"), F.sum("n_hate"), F.sum("n_neutral")).first()
    assert tuple(got) == (5, 10, 10, 10)


def test_scores_use_the_newest_index(spark, tmp_path):
    topics = spark.createDataFrame(
        [(1, [(0, 0.5), (1, 0.5)]), (2, [(1, 1.0)]), (3, [])],
        "post_id long, topics array<struct<topic: bigint, p: double>>",
    )
    topics.coalesce(1).write.parquet(str(tmp_path / "in"))
    index = spark.createDataFrame(
        [(0, 1.0, 10.0, 0.0), (1, 3.0, 20.0, 0.0)],
        "topic long, avg_n_push double, avg_n_hate double, avg_n_neutral double",
    )
    stream = spark.readStream.schema(topics.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    rescore.score_stream(stream, lambda: index, out, str(tmp_path / "cp")).awaitTermination(120)
    got = {r["post_id"]: r["score_hate"] for r in spark.read.parquet(out).collect()}
    assert got == pytest.approx({1: 15.0, 2: 20.0})


def test_a_stream_goes_on_with_its_sums(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "ts timestamp, score int"
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))

    def arrive(hours):
        spark.createDataFrame([(start + timedelta(hours=h), (h % 3) - 1) for h in hours], schema).coalesce(1).write.mode("append").parquet(source)

    def totals():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        rescore.kept_tallies(stream, out, checkpoint).awaitTermination(120)
        found = rescore.newest(spark, out).agg(F.count("*"), F.sum("n_push"), F.sum("n_hate"), F.sum("n_neutral"))
        return tuple(found.first())

    arrive(range(0, 12))
    arrive(range(12, 18))
    assert totals() == (3, 6, 6, 6)
    arrive(range(9, 30))  # three hours of it in steps that were there before
    assert totals() == (5, 13, 13, 13)
