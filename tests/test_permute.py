"""Orders by a keyed permutation: one to one at every size, different per seed, and spread out."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from postsignal.operators import permute


def places(spark, n, seed="57:0"):
    df = spark.range(n).select("id", permute.permuted(F.col("id"), n, F.lit(seed)).alias("place"))
    return [r["place"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 12, 13, 50, 101, 4097, 20_011])
def test_one_to_one(spark, n):
    assert sorted(places(spark, n)) == list(range(n))


def test_all_domains_cover_their_numbers():
    for n in [*range(1, 3000), 10**6 + 3, 2**40 + 1, 2**51]:
        a, b = permute.sides(n)
        assert n <= a * b < n + a and max(a, b) < permute.PRIME


def test_orders_differ_and_look_random(spark):
    n = 10_000
    one, two = places(spark, n, "57:0"), places(spark, n, "57:1")
    assert one != two and one == places(spark, n, "57:0")
    for order in (one, two):
        kept = sum(abs(a - b) == 1 for a, b in zip(order, order[1:]))
        assert kept < 20
        cells = Counter((i * 10 // n, p * 10 // n) for i, p in enumerate(order))
        assert sum((c - 100) ** 2 / 100 for c in (cells[i, j] for i in range(10) for j in range(10))) < 140
        mean = (n - 1) / 2
        together = sum((i - mean) * (p - mean) for i, p in enumerate(order)) / sum((i - mean) ** 2 for i in range(n))
        assert abs(together) < 0.05


def test_batches_need_no_sort(spark):
    numbered = spark.range(130).withColumnRenamed("id", "number")
    made = permute.epoch_batches(numbered, 130, size=50, epochs=3)
    assert Counter((r["epoch"], r["batch"]) for r in made.collect()) == {(e, b): n for e in range(3) for b, n in ((0, 50), (1, 50), (2, 30))}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Sort", "Window"))
    assert permute.epoch_batches(numbered.limit(0), 0).collect() == []
