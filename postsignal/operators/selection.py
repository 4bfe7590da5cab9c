"""Exact order statistics of any number of distinct values, by narrowing ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

QUARTILES = (0.25, 0.5, 0.75)


def _magnitude(value: float) -> float:
    """Sign and order of magnitude; rises with the value. All finite doubles but 0 have logarithms above -800."""
    return math.copysign(math.log(abs(value)) + 800.0, value) if value else 0.0


def _bucket(value: Column, low: float, high: float, buckets: int, by_magnitude: bool) -> Column:
    """A number that never falls as the value rises; the ends of the range have one each to themselves.

    Halves are subtracted, so the widest range of finite doubles does not overflow. A quotient that is
    no number (an infinite end, or a range too narrow to halve) puts all between the ends in one bucket.
    """
    place, first, last = value, low, high
    if by_magnitude:
        place = F.when(value == 0, 0.0).otherwise(F.signum(value) * (F.log(F.abs(value)) + 800.0))
        first, last = _magnitude(low), _magnitude(high)
    share = F.try_divide(place / 2 - F.lit(first / 2), F.lit(last / 2 - first / 2))
    inner = F.coalesce(F.floor(F.nanvl(share, F.lit(0.0)) * buckets), F.lit(0)) + 1
    inside = F.greatest(F.lit(1).cast("long"), F.least(inner, F.lit(buckets).cast("long")))
    return F.when(value <= F.lit(low), 0).when(value >= F.lit(high), buckets + 1).otherwise(inside)


def selected(values: DataFrame, wanted: dict[str, list[int]], buckets: int = 256) -> dict[tuple[str, int], float]:
    """``{(measure, rank): value}`` for ranks from 0 in the ascending order of each measure.

    ``values`` has ``measure`` and ``value`` (a double, neither null nor NaN) and is read once per pass,
    so it should be a stored table. A pass counts the values of each open range by bucket and goes on
    with the buckets that hold a wanted rank, from their smallest to their largest value. A range of
    which a pass keeps over a quarter is next cut by orders of magnitude, then evenly again. Each pass
    parts a range's two ends, so it comes to single values; values spread evenly take a pass per
    eight bits of their number. Counts are combined before they move, and no task or driver sees more
    than the buckets of the open ranges, of which there is at most one per wanted rank.
    """
    measures = [m for m, ranks in wanted.items() if ranks]
    ends = values.filter(F.col("measure").isin(measures)).groupBy("measure").agg(F.min("value"), F.max("value"), F.count("*"))
    spans = [(m, low, high, 0, n, False, sorted(set(wanted[m]))) for m, low, high, n in ends.collect()]
    found: dict[tuple[str, int], float] = {}
    while True:
        found.update({(m, r): low for m, low, high, *_, ranks in spans if low == high for r in ranks})
        spans = [s for s in spans if s[1] != s[2]]
        if not spans:
            return found
        slot = F.lit(None).cast("int")
        bucket = F.lit(None).cast("long")
        holds = F.lit(False)
        for i, (m, low, high, before, _, by_magnitude, ranks) in enumerate(spans):
            inside = (F.col("measure") == m) & F.col("value").between(low, high)
            slot = F.when(inside, i).otherwise(slot)
            bucket = F.when(inside, _bucket(F.col("value"), low, high, buckets, by_magnitude)).otherwise(bucket)
            for r in ranks:
                holds = holds | ((F.col("slot") == i) & (F.col("upto") - F.col("n") <= r - before) & (F.col("upto") > r - before))
        counted = (
            values.select(slot.alias("slot"), bucket.alias("bucket"), "value")
            .filter("slot is not null")
            .groupBy("slot", "bucket")
            .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        )
        upto = F.sum("n").over(Window.partitionBy("slot").orderBy("bucket"))
        narrowed = []
        for row in counted.withColumn("upto", upto).filter(holds).collect():
            m, _, _, before, n, by_magnitude, ranks = spans[row["slot"]]
            first, end = before + row["upto"] - row["n"], before + row["upto"]
            turned = by_magnitude != (4 * row["n"] > n)
            narrowed.append((m, row["low"], row["high"], first, row["n"], turned, [r for r in ranks if first <= r < end]))
        spans = narrowed


def six_numbers(values: DataFrame, buckets: int = 256) -> DataFrame:
    """Minimum, quartiles, mean and maximum per ``measure``, quartiles interpolated linearly.

    Like :func:`stats.six_numbers`, for measures with as many distinct values as rows. ``values`` has
    ``measure`` and ``value``. Rows with a null measure, a null value or NaN are skipped; measures
    are few, such as columns or categories. No rows: no measures.
    """
    made = values.select(F.col("measure").cast("string"), F.col("value").cast("double"))
    kept = written(made.filter(F.col("measure").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")))
    per = kept.groupBy("measure").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high")
    ).collect()
    places = {r["measure"]: [q * (r["n"] - 1) for q in QUARTILES] for r in per}
    found = selected(kept, {m: [f(p) for p in at for f in (math.floor, math.ceil)] for m, at in places.items()}, buckets)

    def between(measure: str, place: float) -> float:
        low, high = found[measure, math.floor(place)], found[measure, math.ceil(place)]
        return low if low == high else low + (high - low) * (place - math.floor(place))

    rows = []
    for r in per:
        q1, median, q3 = (between(r["measure"], p) for p in places[r["measure"]])
        rows.append((r["measure"], r["low"], q1, median, r["mean"], q3, r["high"]))
    schema = "measure string, minimum double, q1 double, median double, mean double, q3 double, maximum double"
    return values.sparkSession.createDataFrame(rows, schema)
