"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow of its documents in a seeded random order, repeated up to ``most`` times. A
document is one packet; one that is longer than ``1/packets`` of its source's target goes as several
packets in a row. A packet's virtual finish time is the words its source has sent up to and with it,
divided by the source's target. All packets are sorted by it over the whole table and sent until the
total budget is reached, where the packet being sent is cut at a word. What a source gets is decided
by that order alone; it ends within two packets of its target.

Null text: size 0, never sent. Null source: a source of its own, last in order. Ties in the random
order: by id, then by size; of finish times: by source, then by document. Very long texts: packets of
bounded share, so none keeps its source from its target. Repeated rows: documents of their own. Empty
table: no rows. Other columns: left out by :func:`mix`, kept by :func:`mixed_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .names import unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Shares of the total by weight, where no source gets more than ``most`` times its size. With
    sources in the order of ``most * size / weight``, those up to some place are full and the others
    share what is left by weight; that place is the first whose level the next sources exceed. Only
    one row per source is ordered here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", (most * F.col("source_size")).cast("double"))
    level = F.col("most") / F.col("weight")
    upto = Window.orderBy(level, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    fair = (
        per.withColumn("full", F.sum("most").over(upto))
        .withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(upto))
        .withColumn("budget", F.sum("source_size").over(every).cast("double"))
    )
    # The level of the others once this source and those before it are full.
    after = F.try_divide(F.col("budget") - F.col("full"), F.col("open"))
    fits = F.when(F.col("open") < 0.5, F.col("budget") >= F.col("full")).otherwise(after >= level)
    # Sources are full as long as the level they leave to the rest is at least their own.
    last = F.max(F.when(fits, F.struct(level.alias("level"), "full", "open"))).over(every)
    shared = F.when(
        last.isNull(), F.col("budget") / F.sum("weight").over(every)
    ).otherwise(F.try_divide(F.col("budget") - last["full"], last["open"]))
    return fair.withColumn("shared", shared).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("shared") * F.col("weight"), F.col("most"))).alias("target")
    )


def _running(df: DataFrame, by: list[str], bucket: str, order: list, size: str, name: str) -> DataFrame:
    """Sum of ``size`` before each row, per ``by`` in ``order``, of which ``bucket`` is a coarse form.

    Rows are summed inside their bucket; only one row per bucket is summed in sequence.
    """
    keys = [*by, bucket]
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.sum(size).alias("_n")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_inside", "_start", *[f"_{k}" for k in keys])
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    seed: int = 7,
    rows_a_bucket: int = 2000,
    packets: int = 10_000,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, first_at)``, one row per row of ``docs``.

    ``taken`` counts words with repeats; ``first_at`` is the place in the mix, in words, where the
    document first begins (null if it is not taken).
    """
    sizes = written(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))
    n = sizes.count()
    buckets = 1 << max(0, math.ceil(math.log2(max(1, n / rows_a_bucket))))
    per = written(targets(sizes, weights, most))
    drawn = F.xxhash64(F.lit(seed), "doc_id", "size")
    ordered = _running(
        sizes.withColumn("draw", drawn).withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 20), F.lit(buckets))),
        ["source"], "bucket", [F.pmod("draw", F.lit(1 << 20)), "draw", "doc_id"], "size", "before",
    )
    ordered = ordered.join(
        per.withColumnsRenamed({"source": "_source"}), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    ordered = written(ordered.withColumn("row", F.struct("doc_id", "size", "before", "draw")))
    # Packets that begin beyond this time cannot be sent: by then every source, none of whose packets
    # spans more than one part in ``packets`` or a word, has sent its target, and targets add up to the budget.
    end = F.col("target") * (1 + 2.0 / packets) + 2
    longest = F.ceil(F.col("target") / packets)
    sent = (
        ordered.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("start", F.col("turn") * F.col("source_size") + F.col("before"))
        .filter((F.col("size") > 0) & (F.col("start") < end))
        .withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, longest)))
        .withColumn("words", F.least(F.col("size") - F.col("skip"), longest))
        .withColumn("start", F.col("start") + F.col("skip"))
        .filter(F.col("start") < end)
        .withColumn("finish", (F.col("start") + F.col("words")) / F.col("target"))
        .withColumn("range", F.least(F.floor(F.col("finish") * 4 * buckets), F.lit(8 * buckets)))
        .select("source", "row", "turn", "skip", "words", "finish", "range")
    )
    queued = _running(sent, [], "range", ["finish", F.col("source").asc_nulls_last(), "row", "turn", "skip"], "words", "at")
    budget = F.coalesce(F.lit(sizes.agg(F.sum("size")).first()[0]), F.lit(0))
    taken = (
        queued.withColumn("words", F.greatest(F.least(F.col("words"), budget - F.col("at")), F.lit(0)))
        .groupBy("source", "row")
        .agg(F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("at"))).alias("first_at"))
        .select(F.col("source").alias("_source"), F.col("row").alias("_row"), "taken", "first_at")
    )
    same = F.col("row").eqNullSafe(F.col("_row")) & F.col("source").eqNullSafe(F.col("_source"))
    return ordered.join(taken, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_at"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: once per turn, the last turn cut after its last taken word.

    Rows that share id, source and size share what is taken of them evenly.
    """
    p = unused(docs, "mix_")
    plan = mix(docs, **options).filter("taken > 0").groupBy("doc_id", "source", "size").agg(
        F.ceil(F.sum("taken") / F.count("*")).cast("long").alias(f"{p}share")
    )
    plan = plan.withColumnsRenamed({c: p + c for c in ("doc_id", "source", "size")})
    sized = docs.withColumn(f"{p}words", words_in(F.col("text")))
    same = (
        F.col("doc_id").eqNullSafe(F.col(f"{p}doc_id"))
        & F.col("source").eqNullSafe(F.col(f"{p}source"))
        & (F.col(f"{p}words") == F.col(f"{p}size"))
    )
    share, size, turn = F.col(f"{p}share"), F.col(f"{p}size"), F.col(f"{p}turn")
    turns = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(share / size).cast("long")))
    left = share - (turn - 1) * size
    text = F.when(left >= size, F.col("text")).otherwise(first_words(F.col("text"), left))
    out = sized.join(plan, same).withColumn(f"{p}turn", turns).withColumn(f"{p}text", text)
    changed = {"text": F.col(f"{p}text"), "n_chars": F.length(f"{p}text").cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word, spaces as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(parts, 1, n.cast("int")), "")
