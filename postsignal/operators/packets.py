"""Token lists in packets, which ask for the values of their distinct terms and get them back.

A packet holds the lists of some posts as numbers into the packet's own terms. Only distinct terms of a
packet meet a table of all terms, not those of every post, and no task needs that table whole.

Null lists: as empty ones. Null or repeated identifiers: every row stays one of its own (``alone`` tells).
Empty table: no packets.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# These functions travel to the workers with the job, whatever the import path there is.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a packet; a longer list is a packet of its own.
PACKET = 250_000


def _cut(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of lists of about ``PACKET`` tokens."""
    begins = np.cumsum(sizes) - sizes
    bounds = np.flatnonzero(np.diff(begins // PACKET, prepend=-1, append=-1)) if len(sizes) else []
    return list(zip(bounds[:-1], bounds[1:]))


def counted(sizes: np.ndarray, codes: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and distinct codes of lists, and how often each occurs in its list."""
    cell, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(terms, 1) + codes, return_counts=True)
    return np.bincount(cell // max(terms, 1), minlength=len(sizes)), cell % max(terms, 1), times


def _bytes(numbers: np.ndarray) -> pa.Array:
    """Numbers as one value, two or four bytes each."""
    return pa.array([numbers.astype("<u2" if numbers.max(initial=0) < 1 << 16 else "<u4").tobytes()], pa.binary())


def numbers(stored: bytes, n: int) -> np.ndarray:
    return np.frombuffer(stored, f"<u{len(stored) // max(n, 1) or 4}")


def packed(posts: DataFrame, tokens: Column, count: bool = False) -> DataFrame:
    """A stored table ``(packet, post_ids, sizes, terms, first_docs, first_pos, codes)`` of ``tokens``.

    Lists of a packet are in the order of their identifiers; the first one with a term, and the place
    there, are kept. ``codes`` are the tokens as numbers into ``terms``. With ``count`` a list's codes are
    distinct, and ``times`` and ``df`` tell how often a list has each of its codes and how many lists have
    each of the terms.
    """
    kind = posts.schema["post_id"].dataType.simpleString()
    schema = f"packet bigint, post_ids array<{kind}>, sizes array<int>, terms array<string>, "
    schema += "times binary, df array<bigint>, " if count else f"first_docs array<{kind}>, first_pos array<int>, "
    schema += "codes binary"
    names = [part.split()[0] for part in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by("post_id")
            ids, lists = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])
            for a, b in _cut(sizes):
                coded = flat.slice(ends[a], ends[b] - ends[a]).dictionary_encode()
                terms, own, codes = coded.dictionary, sizes[a:b], coded.indices.to_numpy()
                if count:
                    own, codes, times = counted(own, codes, len(terms))
                    more = {"times": _bytes(times), "df": _one(np.bincount(codes, minlength=len(terms)))}
                else:
                    # Codes are given as terms turn up, so a term is new where the largest code grows.
                    new = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
                    post = np.searchsorted(ends[a + 1 : b + 1] - ends[a], new, side="right")
                    more = {"first_docs": _one(ids.take(pa.array(a + post))), "first_pos": _one((new - (ends[a + post] - ends[a])).astype(np.int32))}
                made = {"packet": pa.array([uuid.uuid4().int >> 65]), "post_ids": _one(ids.slice(a, b - a)), "sizes": _one(own.astype(np.int32))}
                made |= {"terms": _one(terms), "codes": _bytes(codes), **more}
                yield pa.RecordBatch.from_arrays([made[name] for name in names], names)

    return written(posts.select("post_id", tokens.alias("tokens")).mapInArrow(pack, schema))


def _one(values) -> pa.Array:
    """One list of all the values."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def alone(packets: DataFrame) -> bool:
    """Whether every identifier is there and belongs to one row."""
    ids = packets.select(F.explode("post_ids").alias("post_id")).groupBy("post_id").agg(F.count("*").alias("n"))
    return ids.filter("n > 1 or post_id is null").isEmpty()


def answered(packets: DataFrame, values: DataFrame, names: list[str], unpack: Callable[[dict, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``unpack(packet, known)`` of all packets; ``known`` has ``place`` and the columns ``names`` of the terms
    that ``values (term, ...)`` has. Terms of ``values`` must be unique."""

    def run(packet: pa.Table, known: pa.Table) -> pa.Table:
        given = {c: packet.column(c).combine_chunks().flatten() for c in ("post_ids", "sizes", "terms")}
        n = pc.sum(given["sizes"]).as_py() or 0
        given |= {c: numbers(packet.column(c)[0].as_py(), n) for c in ("codes", "times") if c in packet.column_names}
        return unpack(given, known)

    asked = packets.select("packet", F.posexplode("terms").alias("place", "term"))
    known = asked.join(values, "term").select(F.col("packet").alias("of"), "place", *names)
    return packets.drop("df", "first_docs", "first_pos").groupBy("packet").cogroup(known.groupBy("of")).applyInArrow(run, schema)
