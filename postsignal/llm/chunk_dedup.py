"""Exact de-duplication by content-defined chunk recipes.

Texts count as equal when they agree after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
Such a normalised text is cut where a rolling hash of its bytes says so, and its recipe is the list
of its chunks' keys. Each chunk's content travels once per task and key; a key under which more than
one content turns up gets an ordinal per content, so a key, with its ordinal, is a verified
identifier. From there on only recipes are moved and compared, never texts.

Null text: an empty text. Empty texts: equal to each other, with an empty recipe. Equal rows with
equal ids: all of them are returned, and one of them is kept. Null ids: rank after all others.
Empty table: no rows. Other columns are left out by :func:`groups` and kept by
:func:`deduplicated`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .names import unused
from .words import SPACE

LEAST, MOST, BITS = 256, 8192, 10


def _gear() -> np.ndarray:
    seed = b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256))
    return np.frombuffer(seed, "<u4")


def chunks(text: bytes, gear: np.ndarray) -> list[bytes]:
    """Pieces of ``text`` that end where the hash of the last 16 bytes has ten leading zeros."""
    if not text:
        return []
    rolled = gear[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8):
        if len(rolled) <= step:
            break
        wider = rolled.copy()
        wider[step:] += rolled[:-step] << np.uint32(step)
        rolled = wider
    out, begin = [], 0
    for end in (np.flatnonzero(rolled >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while end - begin > MOST:
            out.append(text[begin : begin + MOST])
            begin += MOST
        if end - begin >= LEAST:
            out.append(text[begin:end])
            begin = end
    while begin < len(text):
        out.append(text[begin : begin + MOST])
        begin += MOST
    return out


def _key(chunk: bytes, key_bits: int) -> bytes:
    whole = hashlib.blake2b(chunk, digest_size=16).digest()
    return whole if key_bits == 128 else (int.from_bytes(whole, "big") >> 128 - key_bits).to_bytes(16, "big")


def _normalised(batch: pa.RecordBatch) -> Iterator[tuple[object, str, bytes]]:
    for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        text = text or ""
        yield id_, text, text.encode().translate(None, SPACE)


def recipes(docs: DataFrame, key_bits: int = 128) -> DataFrame:
    """``(doc_id, n_cp, n_bytes, text_sha256, recipe)`` for each row; nothing is shuffled."""

    def run(batches):
        gear = _gear()
        for batch in batches:
            rows = [
                (i, len(t), len(b), hashlib.sha256(b).hexdigest(), [_key(c, key_bits) for c in chunks(b, gear)])
                for i, t, b in _normalised(batch)
            ]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary())))],
                ["doc_id", "n_cp", "n_bytes", "text_sha256", "recipe"],
            )

    schema = "doc_id long, n_cp long, n_bytes long, text_sha256 string, recipe array<binary>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def chunk_contents(docs: DataFrame, key_bits: int = 128) -> DataFrame:
    """``(chunk, content)``, each pair once per batch of rows."""

    def run(batches):
        gear = _gear()
        for batch in batches:
            found = {c for _, _, b in _normalised(batch) for c in chunks(b, gear)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(c, key_bits) for c in found], pa.binary()), pa.array(list(found), pa.binary())],
                ["chunk", "content"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "chunk binary, content binary")


def _ordinals(docs: DataFrame, shared: DataFrame, key_bits: int) -> DataFrame:
    """For texts with a chunk whose key has several contents: which of them, place by place."""

    def run(batches):
        gear = _gear()
        for batch in batches:
            rows = [
                (i, hashlib.sha256(b).hexdigest(), p, _key(c, key_bits), c)
                for i, _, b in _normalised(batch)
                for p, c in enumerate(chunks(b, gear))
            ]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                ["doc_id", "text_sha256", "place", "chunk", "content"],
            )

    schema = "doc_id long, text_sha256 string, place long, chunk binary, content binary"
    placed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    unclear = placed.join(shared, "chunk", "left_semi")
    which = F.row_number().over(Window.partitionBy("chunk").orderBy("content")).alias("which")
    contents = unclear.select("chunk", "content").distinct().select("chunk", "content", which)
    return (
        unclear.join(contents, ["chunk", "content"])
        .groupBy("doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_set(F.struct("place", "which"))).alias("which"))
    )


def _identified(docs: DataFrame, key_bits: int) -> DataFrame:
    """Recipes with the verified identifier list ``ids`` of each row."""
    made = written(recipes(docs, key_bits))
    shared = written(
        chunk_contents(docs, key_bits)
        .groupBy("chunk")
        .agg(F.min("content").alias("a"), F.max("content").alias("b"))
        .filter("a <> b")
        .select("chunk")
    )
    if shared.isEmpty():
        which = F.lit(None).cast("array<struct<place: bigint, which: int>>")
        return made.withColumn("ids", F.struct("n_bytes", "recipe", which.alias("which")))
    unclear = _ordinals(docs, shared, key_bits).withColumnsRenamed({"doc_id": "_id", "text_sha256": "_sha"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
    return made.join(unclear, same, "left").withColumn("ids", F.struct("n_bytes", "recipe", "which"))


def groups(docs: DataFrame, key_bits: int = 128) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Of equal texts the row with the most code points in the original text stays, then the smallest
    ``doc_id``. Groups of one row need no further look; the others are one row each when they meet
    their members, so a group of any size is only counted, never gathered.
    """
    rows = _identified(docs, key_bits).withColumn("digest", F.xxhash64("ids"))
    best = F.max(F.struct("n_cp", (-F.col("doc_id")).alias("minus"))).alias("best")
    several = written(
        rows.groupBy("digest", "ids").agg(F.count("*").alias("n"), best).filter("n > 1")
    ).select(F.col("digest").alias("_digest"), F.col("ids").alias("_ids"), "n", "best")
    met = rows.join(several, _same_ids(), "left")
    alone = F.col("n").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(-F.col("best.minus"))
    first = alone | (
        (F.col("n_cp") == F.col("best.n_cp")) & F.col("doc_id").eqNullSafe(keep)
    )
    # Rows that repeat an id share its place; one of them stays.
    repeat = F.row_number().over(Window.partitionBy("digest", "doc_id", "n_cp", "ids", first).orderBy("text_sha256"))
    return met.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (first & (repeat == 1)).alias("kept"),
        "text_sha256",
    )


def _same_ids() -> Column:
    return (F.col("digest") == F.col("_digest")) & F.col("ids").eqNullSafe(F.col("_ids"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each repeated id.

    Texts move once, spread by text and id together, so copies do not meet in one task.
    """
    p = unused(docs, "key_")
    keys = [f"{p}sha", f"{p}id", f"{p}no_id"]

    def keyed(sha: Column) -> list[Column]:
        return [c.alias(k) for c, k in zip((sha, F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id")), keys)]

    stays = groups(docs.select("doc_id", "text")).filter("kept").select(*keyed(F.col("text_sha256")))
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    own = [F.col(f"`{c}`") for c in docs.columns]
    first = Window.partitionBy(*keys).orderBy(F.length("text").desc_nulls_last(), "text")
    return (
        docs.select(*own, *keyed(F.sha2(bare, 256)))
        .join(stays, keys, "left_semi")
        .withColumn(f"{p}row", F.row_number().over(first))
        .filter(F.col(f"{p}row") == 1)
        .select(*own)
    )
