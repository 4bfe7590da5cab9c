"""Random orders as arithmetic: a keyed permutation of row numbers, without a sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, WALKS = 6, 64
#: A prime below 2^31, so products of two remainders fit 64 bits, and multipliers below it.
PRIME, SPREAD, STIR = 2147483647, 48271, 16807


def sides(n: int) -> tuple[int, int]:
    """``(a, b)`` with ``n <= a * b < n + a``: numbers are pairs of a digit below a and one below b."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _stirred(digit: Column, key: Column) -> Column:
    spread = (digit * SPREAD + key) % PRIME
    return (spread * spread % PRIME * STIR + key) % PRIME


def _once(number: Column, keys: Column, a: int, b: int) -> Column:
    """One pass of Feistel rounds over [0, a * b): each adds to one digit a function of the other."""
    start = F.struct(F.floor(number / b).cast("long").alias("l"), (number % b).alias("r"))

    def both(s: Column, key: Column) -> Column:
        left = (s["l"] + _stirred(s["r"], key["even"])) % a
        return F.get(
            F.transform(F.array(left), lambda l: F.struct(l.alias("l"), ((s["r"] + _stirred(l, key["odd"])) % b).alias("r"))), F.lit(0)
        )

    return F.aggregate(keys, start, both, lambda s: s["l"] * b + s["r"])


def permuted(number: Column, n: int, seed: Column) -> Column:
    """The place of each number of [0, n) in a random order of them; every order has its ``seed``.

    A number that leaves [0, n) is sent on until it is back, which keeps the map one to one. Fewer
    than ``sqrt(n) + 1`` places lie outside, so up to 4,096 numbers no walk is longer than 64 steps,
    and beyond one that long has a chance below 2^-384; it would end the job. ``n`` is below 2^52.
    """
    a, b = sides(n)
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)),
        lambda i: F.struct(_key(seed, i * 2).alias("even"), _key(seed, i * 2 + 1).alias("odd")),
    )
    first = _once(number.cast("long"), keys, a, b)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(_once(x, keys, a, b))
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk did not come back")).cast("long"))


def _key(seed: Column, i: Column) -> Column:
    """A number below the prime from the seed and the number of the round, in any engine the same."""
    digest = F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def epoch_batches(numbered: DataFrame, n: int, size: int = 64, epochs: int = 4, seed: int = 57, number: str = "number") -> DataFrame:
    """Every row once per epoch with its ``place`` and ``batch`` from 0, in another order each epoch.

    ``numbered`` has dense numbers from 0 to ``n - 1``, made once; every epoch is a projection of
    them, with no sort, shuffle or window of its own. Null numbers: null places and batches. Empty
    table: no rows.
    """
    repeated = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = repeated.withColumn("place", permuted(F.col(number), n, F.concat_ws(":", F.lit(str(seed)), "epoch")))
    return placed.withColumn("batch", F.floor(F.col("place") / size).cast("long"))
