"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A sketch holds every distinct hash of a five-word sequence that lies in the lowest ``1/scale`` of the
hash range, and the smallest hash if there is none there. Sketches of parts merge to the sketch of
all their sequences (:func:`merged`), and the share of one sketch found in another estimates
containment however unequal the two documents are.

Null text: an empty text. Empty text, or only blanks: an empty sketch, like only to another empty
one. Fewer than five words: their sequence is the one hashed. Null id: after all others in the order
of ids. Ties of ids: ordered by text. Very long text: split whole; its sketch grows with it. Repeated rows: all returned. One row: it is its own next
document. Empty table: no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SHINGLE = 5


def _let(value: Column, use) -> Column:
    """``use(value)`` where ``value`` is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _kept(hashes: Column, scale: int) -> Column:
    """The sketch of some hashes: those in the lowest part of the unsigned range, else the smallest."""
    below = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 1) < (1 << 63) // scale)
    # The range is unsigned, so negative hashes are its upper half.
    least = F.coalesce(F.array_min(F.filter(hashes, lambda h: h >= 0)), F.array_min(hashes))
    return _let(below, lambda b: F.when(F.size(b) > 0, F.array_sort(F.array_distinct(b))).otherwise(F.array(least)))


def merged(sketches: Column, scale: int = 4) -> Column:
    """One sketch from an array of sketches of the same ``scale``.

    It is the sketch of all their sequences together: a part without a hash in the lowest part gives
    its smallest, which is dropped once another part has one there. No sketch, or only empty ones: empty.
    """
    every = F.flatten(F.filter(sketches, lambda s: s.isNotNull()))
    return _let(every, lambda h: F.when(F.size(h) > 0, _kept(h, scale)).otherwise(F.array().cast("array<bigint>")))


def sketch(text: Column, scale: int = 4, words: int = SHINGLE) -> Column:
    """Sorted hashes; a text is split once, and only kept hashes are sorted."""

    def hashes(tokens: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.size(tokens) - words, F.lit(0)))
        return F.transform(begins, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(words)]))

    bare = F.trim(text, F.lit(BLANKS))
    made = _let(F.split(bare, r"[\x20\x09-\x0D]+"), lambda tokens: _let(hashes(tokens), lambda h: _kept(h, scale)))
    return F.when(F.length(bare) == 0, F.array().cast("array<bigint>")).otherwise(made)


def shown(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both (0 to 1)."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, 1.0).otherwise(F.try_divide(common, every))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too (0 to 1)."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)))


def _ranges(docs: DataFrame, rows: int) -> Column:
    """A number that falls with the id and is shared by about ``rows`` neighbours.

    Up to 256 cuts are quantiles of the ids, numbers in the plan; each range between two cuts is
    then divided evenly, so the count of ranges follows the count of rows.
    """
    total, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = max(1, -(-total // rows))
    coarse = min(256, wanted)
    if low is None:
        return F.lit(0).cast("long")
    inner = docs.approxQuantile("doc_id", [i / coarse for i in range(1, coarse)], 0.25 / coarse) if coarse > 1 else []
    cuts = sorted({low, *map(int, inner)}) + [high + 1]
    fine = -(-wanted // coarse)
    place = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long"))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        step = max(1, -(-(b - a) // fine))
        place = place.when(F.col("doc_id") < b, i * fine + F.expr(f"(doc_id - ({a})) div {step}"))
    return place


def next_documents(docs: DataFrame, scale: int = 4, rows: int = 2000) -> DataFrame:
    """``(doc_id, text, sketch, next_text, next_sketch)`` by falling id; the first follows the last.

    Texts move once, to their range of ids. Each range's first document is handed to the range
    above, whose last document it follows; only these are sketched a second time.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = texts.withColumn("range", _ranges(docs.select("doc_id"), rows))
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    placed = ranged.withColumn("row", F.row_number().over(inside))
    held = ranged.withColumn("sketch", sketch(F.col("text"), scale)).select(
        "range", "doc_id", "text", "sketch",
        F.lead("text").over(inside).alias("next_text"),
        F.lead("sketch").over(inside).alias("next_sketch"),
    )
    falling = Window.orderBy(F.col("range").desc())
    whole = Window.partitionBy()
    above = ranged.select("range").distinct().select(
        F.col("range").alias("of"),
        F.coalesce(F.lag("range").over(falling), F.min("range").over(whole)).alias("to"),
    )
    heads = placed.filter("row = 1").join(above, F.col("range") == F.col("of")).select(
        "to", F.col("text").alias("head_text"), sketch(F.col("text"), scale).alias("head_sketch")
    )
    last = F.col("next_text").isNull()
    return held.join(heads, (F.col("range") == F.col("to")) & last, "left").select(
        "doc_id", "text", "sketch",
        F.when(last, F.col("head_text")).otherwise(F.col("next_text")).alias("next_text"),
        F.when(last, F.col("head_sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"),
    )


def fingerprints(docs: DataFrame, scale: int = 4) -> DataFrame:
    """Each text's sketch beside those of its edited text and of the next document.

    The edited text has its last third replaced by as many code points of the next one's beginning.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.left("text", F.length("text") - third), F.left("next_text", third))
    both = next_documents(docs, scale).withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), scale))
    own, other, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(own).alias("fingerprint"),
        shown(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, after).alias("near_next"),
        containment(own, other).alias("in_edited"),
        containment(own, after).alias("in_next"),
    )
