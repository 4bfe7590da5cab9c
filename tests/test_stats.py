import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postsignal.operators import evaluate, stats, tally


def test_t_distribution(spark):
    cases = [(2.0, 10.0, 0.073388034771), (0.0, 3.0, 1.0), (1.0, 1.0, 0.5), (1.959963984540054, 1e6, 0.0500002)]
    df = spark.createDataFrame(cases, "t double, df double, p double")
    for r in df.select("p", stats.t_two_sided(F.col("t"), F.col("df")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-6)


def test_welch_moments(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", x) for x in (2, 4, 9)] + [("c", 99)], "g string, v int")
    r = stats.welch(df, "g", "a", "b", "v").first()
    e1, e2 = (5 / 3) / 4, 13 / 3
    assert (r["n1"], r["n2"]) == (4, 3)
    assert r["t"] == pytest.approx((2.5 - 5) / math.sqrt(e1 + e2))
    assert r["df"] == pytest.approx((e1 + e2) ** 2 / (e1**2 / 3 + e2**2 / 2))


def test_six_numbers(spark):
    df = spark.createDataFrame([(x, None) for x in (1, 2, 3, 10)] + [(None, None)], "a int, b int")
    (r,) = stats.six_numbers(df, ["a", "b"]).collect()
    assert tuple(r) == ("a", 1, 1.75, 2.5, 4.0, 4.75, 10)


def test_previous_day_baseline_by_hand(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(days=rng.choice([0, 1, 2, 2, 2, 4, 5]), hours=3), rng.randrange(9)) for i in range(80)]
    days = {}
    for _, t, y in rows:
        days.setdefault(t.date(), []).append(y)
    errors = [
        (y - sum(days[d]) / len(days[d])) ** 2
        for _, t, y in rows
        if (d := t.date() - timedelta(days=1)) in days
    ]
    df = spark.createDataFrame(rows, "post_id long, posted_at timestamp_ntz, n_hate long")
    r = evaluate.baseline_previous_day(df).first()
    assert r["n"] == len(errors) and r["rmse"] == pytest.approx(math.sqrt(sum(errors) / len(errors)))
    mean = sum(y for *_, y in rows) / 80
    expected = math.sqrt(sum((y - mean) ** 2 for *_, y in rows) / 80)
    assert evaluate.baseline_mean(df).first()["rmse"] == pytest.approx(expected)


def test_batch_errors_have_no_empty_batch(spark):
    df = spark.range(128).select(F.col("id").alias("post_id"), F.lit(3.0).alias("y"), F.lit(1.0).alias("p"))
    assert tuple(evaluate.rmse_by_batch(df, "y", "p").first()) == (2, 2.0, 2.0)


def test_tally_with_one_post_holding_a_third_of_the_comments(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("post_id"), (F.col("id") % 2).cast("int").alias("score")
    )
    got = {r["post_id"]: (r["n_push"], r["n_neutral"]) for r in tally.vote_tally(df).collect()}
    assert got[0] == (1500, 1500) and len(got) == 6001


def test_welch_without_variance_is_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2)], "g string, v int")
    got = stats.welch(df, "g", "a", "b", "v").first()
    assert (got["n1"], got["mean1"], got["mean2"]) == (2, 1.0, 2.0)
    assert got["t"] is None and got["df"] is None and got["p_value"] is None
