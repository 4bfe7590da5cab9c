"""Order statistics against sorting: hot values, ties, extreme doubles, odd rows."""

import math
import random

import pytest

from postsignal.operators import selection


def measured(spark, cases):
    rows = [(m, x) for m, values in cases.items() for x in values]
    rows = [(m, None if x is None else float(x)) for m, x in rows]
    return spark.createDataFrame(rows, "measure string, value double")


def test_any_rank_equals_sorting(spark):
    rng = random.Random(4)
    cases = {
        "even": [rng.random() for _ in range(3000)],
        "hot": [7.5] * 2000 + [rng.gauss(0, 1) for _ in range(1000)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 308) for _ in range(500)],
        "ends": [-math.inf, math.inf, 1.7e308, -1.7e308, 5e-324, 1e-323, 0.0, -0.0, 1.0, math.inf],
        "one": [3.0],
        "same": [2.0] * 50,
    }
    values = measured(spark, cases).cache()
    wanted = {m: sorted({0, len(v) - 1, len(v) // 2, len(v) // 3, *rng.sample(range(len(v)), min(3, len(v)))}) for m, v in cases.items()}
    assert selection.selected(values, wanted) == {(m, r): sorted(cases[m])[r] for m, ranks in wanted.items() for r in ranks}
    few = {"hot": [0, 1500, 2999], "ends": list(range(10))}
    assert selection.selected(values, few, 4) == {(m, r): sorted(cases[m])[r] for m, ranks in few.items() for r in ranks}


def test_six_numbers_and_odd_rows(spark):
    values = measured(spark, {"a": [1, 2, 3, 10], "b": [5.0, None, math.nan], "c": [None, math.nan], None: [1.0]})
    got = {r["measure"]: tuple(r)[1:] for r in selection.six_numbers(values).collect()}
    assert got == {"a": (1, 1.75, 2.5, 4.0, 4.75, 10), "b": (5,) * 6}
    assert selection.six_numbers(values.limit(0)).collect() == []


def test_values_over_many_tasks(spark):
    values = measured(spark, {"a": [float(i) for i in range(20_000)]}).repartition(16)
    got = selection.six_numbers(values).first()
    assert tuple(got)[1:] == pytest.approx((0, 4999.75, 9999.5, 9999.5, 14999.25, 19999))
