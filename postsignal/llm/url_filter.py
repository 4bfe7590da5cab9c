"""URL verdicts from host rules and, where none fits, from two character language models.

URLs that a rule accepts or rejects train one variable-order Markov model each. A model is a table of
all character sequences of up to ``order + 1`` with their counts, whatever their number. A character's
probability takes a discount off its count after the longest context and gives what that leaves to the
next shorter one, down to even odds. A URL is blocked if its log-likelihood under the rejected model
exceeds that under the accepted one, per character, by more than a threshold that is calibrated on
labelled URLs left out of training.

Lines (host and path) are scored once each. Probabilities are worked out for the distinct sequences that
occur in any line, one join per length, and a line's are added up in one grouped sum.

Null URL or one without ``://``: empty host and path, no rule, nothing for the models to compare (the
difference is null), so ``allow``. Path without a leading slash: no rule fits. Very long URLs: scored
whole. Ties at the threshold: ``allow``. A class without training URLs: the threshold is infinite, so
``allow``. Repeated rows: all returned, and all count in training. Empty table: no rows. Other columns
are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# Fixed values: (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER, DISCOUNT, SYMBOLS = 4, 0.5, 256
CLASSES = ["allow", "block"]
BEGIN, END = "\x02", "\x03"


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, CAPITALS, SMALL), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, ruled)``; of the rules that fit, the longest wins."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        ruled = F.when(fits, F.lit(verdict)).otherwise(ruled)
    cut = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return cut.withColumn("rule", rule).withColumn("ruled", ruled)


def _line() -> Column:
    return F.concat("host", "path")


def windows(line: Column, order: int = ORDER) -> Column:
    """For each character and the end, the character with the ``order`` before it."""
    padded = F.concat(F.repeat(F.lit(BEGIN), order), line, F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))


def sequences(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``(seq, allow, block)``: how often each window occurs in either class, over all its URLs."""
    every = labelled.select("ruled", F.explode(windows(_line(), order)).alias("seq"))
    return every.groupBy("seq").agg(*[F.count_if(F.col("ruled") == c).alias(c) for c in CLASSES])


def probabilities(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """``(seq, allow, block)``: probability of the last character after the others, for ``asked (seq)``.

    ``counts`` and ``asked`` are read for every length and should be stored tables.
    """
    lower = None
    for k in range(order + 1):
        level = counts.groupBy(F.right("seq", F.lit(k + 1)).alias("seq")).agg(*[F.sum(c).alias(f"n_{c}") for c in CLASSES])
        sums = [F.sum(f"n_{c}").alias(f"all_{c}") for c in CLASSES] + [F.count_if(F.col(f"n_{c}") > 0).alias(f"kinds_{c}") for c in CLASSES]
        contexts = level.groupBy(F.left("seq", F.lit(k)).alias("context")).agg(*sums)
        wanted = asked.select(F.right("seq", F.lit(k + 1)).alias("seq")).distinct()
        made = wanted.withColumn("context", F.left("seq", F.lit(k))).join(level, "seq", "left").join(contexts, "context", "left")
        if lower is None:
            made = made.withColumns({f"lower_{c}": F.lit(1.0 / SYMBOLS) for c in CLASSES})
        else:
            shorter = lower.withColumnsRenamed({"seq": "end", **{c: f"lower_{c}" for c in CLASSES}})
            made = made.withColumn("end", F.right("seq", F.lit(k))).join(shorter, "end")
        found = {}
        for c in CLASSES:
            n, whole = F.coalesce(f"n_{c}", F.lit(0)), F.col(f"all_{c}")
            own = F.greatest(n - DISCOUNT, F.lit(0.0)) / whole + DISCOUNT * F.col(f"kinds_{c}") / whole * F.col(f"lower_{c}")
            found[c] = F.when(whole > 0, own).otherwise(F.col(f"lower_{c}"))
        lower = written(made.select("seq", *[found[c].alias(c) for c in CLASSES]))
    return lower


def differences(urls: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(line, difference)`` of every distinct line: how much likelier, per character, it is to be rejected."""
    distinct = urls.select(_line().alias("line")).filter("line <> ''").distinct()
    lines = written(distinct.withColumn("number", F.monotonically_increasing_id()))
    spread = lines.select("number", F.explode(windows(F.col("line"), order)).alias("seq"))
    placed = written(spread.groupBy("number", "seq").agg(F.count("*").alias("times")))
    found = probabilities(counts, written(placed.select("seq").distinct()), order)
    gain = found.select("seq", (F.ln("block") - F.ln("allow")).alias("gain"))
    # In a fixed order, so that equal tables give equal sums.
    scored = placed.join(gain, "seq").groupBy("number").agg(
        F.array_sort(F.collect_list(F.col("times") * F.col("gain"))).alias("gains"), F.sum("times").alias("size")
    )
    total = F.aggregate("gains", F.lit(0.0), lambda a, x: a + x)
    return lines.join(scored.select("number", (total / F.col("size")).alias("difference")), "number").select("line", "difference")


def calibrated(scored: DataFrame, bins: int = 200) -> float:
    """The difference that best parts blocked from allowed URLs, from one histogram of each."""
    low, high = scored.agg(F.min("difference"), F.max("difference")).first()
    if low is None:
        return 0.0
    step = max((high - low) / bins, 1e-9)
    rows = scored.groupBy("ruled", F.floor((F.col("difference") - low) / step).alias("bin")).count().collect()
    count = {k: [0] * (bins + 2) for k in ("allow", "block")}
    for r in rows:
        count[r["ruled"]][min(r["bin"], bins + 1)] += r["count"]
    totals = {k: max(1, sum(v)) for k, v in count.items()}
    best, at, below = -1.0, [], {"allow": 0, "block": 0}
    for b in range(bins + 2):
        right = below["allow"] / totals["allow"] + 1 - below["block"] / totals["block"]
        if right > best + 1e-12:
            best, at = right, []
        if right > best - 1e-12:
            at.append(low + b * step)
        for k in below:
            below[k] += count[k][b]
    return at[len(at) // 2]


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """``(page_id, host, path, rule, verdict, difference)`` for each row."""
    urls = written(parsed(pages, rules).withColumn("line", _line()))
    labelled = urls.filter("ruled is not null")
    held_out = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    counts = written(sequences(labelled.filter(~held_out), order))
    scored = written(differences(urls, counts, order))
    judged = urls.join(scored, "line", "left")
    known = counts.agg(*[F.max(c) for c in CLASSES]).first()
    both = all(known)
    threshold = calibrated(judged.filter("ruled is not null").filter(held_out)) if both else math.inf
    verdict = F.coalesce("ruled", F.when(F.col("difference") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "difference")
