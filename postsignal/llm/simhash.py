"""Near-duplicates by SimHash, found through variants of segments with one bit left out.

A fingerprint bit is set if it is set in over half the hashes of a text's ``words``-word shingles,
repeats included. Two fingerprints link when at most ``bits`` of their 64 bits differ.

The 64 bits are cut into as few segments as leave one that differs by at most one bit in every linked
pair: three with four bits, since two differing bits in each would be six. Each segment is indexed under its variants, one for each of its bits
with that bit left out. Segments that differ by at most one bit share a variant, so an equality join on
``(segment, bit left out, other bits)`` meets every linked pair, and the whole fingerprints decide.

* Equal fingerprints are one class, kept once, whatever the number of its documents.
* Pairs are tried in two rounds. First each class is tried against the largest class with which it has
  a whole segment in common, which joins groups of near copies around what they were made from. Then
  the index is joined with itself, and pairs of classes that link and are still in different components
  become rows, so a group does not unfold into all its pairs and no link between components is lost.
* With so many classes that buckets would be crowded, they are cut further, without loss: the bits
  outside the segment are cut into ``bits + 1`` pieces, of which a linked pair has one in common.

Null or empty text, or only blanks: fingerprint zero, linked like any other. Fewer words than a shingle
has: their sequence is the one hashed. Very long texts: read whole, one at a time. Ties (a bit in just
half of the hashes): not set. Repeated rows: all returned. Rows that repeat an id with other texts link
those texts. Null id: linked like any other, but no component is named by it; a component of null ids
alone is null. Empty table: no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .graph import connected

WORDS, BITS, SEED = 4, 4, 42
#: With more classes than this for each value a segment can have, buckets are cut further.
CROWDED = 16
_LANES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half of ``hashes``, counted in eight lanes of bytes, 255 hashes at a time."""
    count = np.zeros(64, np.int64)
    pad = -len(hashes) % 255
    blocks = np.concatenate([hashes, np.zeros(pad, np.uint64)]).reshape(-1, 255)
    for low in range(8):
        lanes = ((blocks >> np.uint64(low)) & _LANES).sum(axis=1, dtype=np.uint64)
        count[low::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned fingerprint of one text."""
    found = (text or "").encode().lower().split()  # of bytes: A-Z and [\x20\x09-\x0D] alone
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    made = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :])]
    return _majority(np.array(made, np.uint64))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed number."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def segments(bits: int = BITS) -> list[tuple[int, int]]:
    """``(lowest bit, width)`` of each segment."""
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def _shift(bits: int) -> int:
    """Bits that an entry has for the segment's own."""
    return max(width for _, width in segments(bits))


def variants(fp: Column, bits: int = BITS) -> Column:
    """Index entries, 64 in all: numbers that hold which bit is left out and the segment's other bits."""
    made = []
    for low, width in segments(bits):
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        made += [segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << i))) + F.lit(low + i << _shift(bits)) for i in range(width)]
    return F.array(*made)


def _by_segment(values: list[Column], bits: int) -> Column:
    """That of ``values`` which belongs to the segment of ``entry``."""
    hole, cuts = F.shiftright("entry", _shift(bits)), segments(bits)
    out = F.when(hole < cuts[1][0], values[0]) if len(cuts) > 1 else values[0]
    for k in range(1, len(cuts)):
        out = out.when(hole < sum(cuts[k]), values[k])
    return out


def _near(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def _first_meeting(a: Column, b: Column, bits: int) -> Column:
    """Whether a pair's bucket is the first of those it meets in, so that it becomes one row.

    Segments that differ in one bit meet only where that bit is left out; equal ones meet everywhere,
    first where their lowest bit is.
    """
    apart, cuts = a.bitwiseXOR(b), segments(bits)
    meets = [apart.bitwiseAND(F.lit(_signed(_mask(low, width)))) for low, width in cuts]
    hole = F.shiftright("entry", _shift(bits))
    first = F.coalesce(*[F.when(F.bit_count(m) <= 1, F.lit(low)) for m, (low, _) in zip(meets, cuts)])
    here = _by_segment([F.lit(low) for low, _ in cuts], bits)
    return (here == first) & ((_by_segment(meets, bits) != 0) | (hole == here))


def _pieces(fp: Column, bits: int) -> Column:
    """``(piece, value)`` of the bits outside the entry's segment; a linked pair has one in common."""
    made = []
    for low, width in segments(bits):
        others = [b for b in range(64) if not low <= b < low + width]
        cuts = [len(others) * i // (bits + 1) for i in range(bits + 2)]
        masks = [sum(1 << b for b in others[x:y]) for x, y in zip(cuts, cuts[1:])]
        made.append(F.array(*[F.struct(F.lit(i).alias("piece"), fp.bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks)]))
    return _by_segment(made, bits)


def _exact(fp: Column, bits: int) -> Column:
    """The segments themselves, as ``(number, value)``."""
    cuts = enumerate(segments(bits))
    return F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for s, (low, width) in cuts])


def links(classes: DataFrame, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """``(a, b)``: enough links between the fingerprints of ``classes (fp, rows)`` for their components.

    Every two classes that link are in one component of these links, and all of these do link. Joins
    test the whole fingerprints, so classes that merely share a bucket never become rows.
    """
    fp, key = F.col("fp"), ["segment", "value"]
    equal = classes.select("fp", "rows", F.inline(_exact(fp, bits)))
    # The class of most rows is likely what its neighbours were made from.
    hubs = equal.groupBy(*key).agg(F.max_by("fp", F.struct("rows", "fp")).alias("hub"))
    near = equal.join(hubs, key).filter((fp != F.col("hub")) & _near(fp, F.col("hub"), bits))
    found = written(near.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct())
    labels = connected(found)
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    indexed = named.select("fp", "label", F.explode(variants(fp, bits)).alias("entry"))
    key = ["entry"]
    if classes.count() > crowded << (_shift(bits) - 1):
        indexed = indexed.select("entry", "fp", "label", F.inline(_pieces(fp, bits)))
        key = ["entry", "piece", "value"]
    left = indexed.select(*key, F.col("fp").alias("a"), F.col("label").alias("x"))
    right = indexed.select(*[F.col(c).alias(f"{c}_b") for c in key], F.col("fp").alias("b"), F.col("label").alias("y"))
    same = [F.col(c) == F.col(f"{c}_b") for c in key]
    a, b = F.col("a"), F.col("b")
    wanted = (a < b) & (F.col("x") != F.col("y")) & _near(a, b, bits) & _first_meeting(a, b, bits)
    more = left.join(right, [*same, wanted]).select("a", "b")
    return written(found.union(more.distinct()))


def components(docs: DataFrame, words: int = WORDS, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``."""
    held = written(fingerprints(docs, words))
    classes = written(held.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    found = links(classes.select("fp", "rows"), bits, crowded)
    # An id that stands for several texts links their fingerprints.
    twice = held.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z")
    if not twice.isEmpty():
        found = found.union(held.join(twice, "doc_id").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct())
    labels = connected(found)
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "label").join(least, "label").select("fp", "component_id")
    return held.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
