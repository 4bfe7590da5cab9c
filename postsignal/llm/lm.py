"""Language-model scores by a weighted backoff automaton.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end per text. Each word, and the
begin of a text, is a state. A state has an arc for every token that followed it in training, and a
failure arc to the root, which has an arc for every token. With counts ``c``, the root's arcs weigh
``P(w) = (c(w) + a) / (N + a (V + 1))``, those of a state ``v`` weigh ``(1 - f) c(v w) / c(v) + f P(w)``,
and its failure arc weighs ``f``: a proper distribution in every state. A state never seen is the
root. One walk from left to right carries the state and adds the logarithms. ``f`` depends on how
often the state was seen, in a few classes; in each it is the value of a fixed list under which the
training texts, each token left out of its own counts, are likeliest.

Counts are never held whole. Texts are dealt into chunks; a chunk sends its distinct words and pairs,
as sorted 56-bit hashes with its own counts, to ranges of hashes. A range adds them up and answers
each chunk with the totals in the chunk's own order, and the chunk then walks its texts. A frequent
word or pair is one entry per chunk, so no range is hot; chunks and ranges follow the input's size. A
chunk sends one row per range that it has entries in, so rows never outnumber distinct entries of
chunks, which grow in proportion to the input.

Null or empty text: one token, the end. Null id: not held out. Repeated rows: all counted and all
scored. No training text: ``N`` and ``V`` are 0 and every token is unknown. Very long text: scored
whole, in a chunk that is larger by it. Ties of failure weights: the larger weight. Empty table: no rows.
Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .words import chained, pieces, word_hashes

ADDED = 0.1
FAILURES = (0.01, 0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95)
#: A state's class is the number of these bounds that its count reaches.
CLASSES = (2, 8, 128, 4096)
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
CHUNK_BYTES, RANGE_TOKENS = 8 << 20, 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(token, state before it, where each text begins)`` of all texts in a row, as hashes."""
    values, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, raw, offsets in pieces(texts):
        value, before = word_hashes(raw, offsets)
        values.append(value)
        sizes.append(np.diff(before))
    value, size = np.concatenate(values), np.concatenate(sizes)
    begins = np.concatenate([[0], np.cumsum(size + 1)])
    token = np.empty(len(value) + len(size), np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[begins[1:] - 1] = True
    token[~is_end] = value
    token[is_end] = END
    state = np.empty_like(token)
    state[1:] = token[:-1]
    state[begins[:-1]] = BEGIN
    return token, state, begins


def _entries(token: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
    """56-bit hashes of words and of pairs, token by token."""
    return [token >> np.uint64(8), chained([state, token]) >> np.uint64(8)]


def packed(values: np.ndarray) -> bytes:
    """Sorted 56-bit numbers as differences of five bytes, or whole where one is longer."""
    steps = np.diff(values, prepend=np.uint64(0))
    steps[:1] = 0
    head = values[:1].astype("<u8").tobytes()
    if len(values) and int(steps.max()) >> 40:
        return b"w" + values.astype("<u8").tobytes()
    return b"d" + head + steps.astype("<u4").tobytes() + (steps >> np.uint64(32)).astype("u1").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    if data[:1] == b"w":
        return np.frombuffer(data, "<u8", n, 1)
    if not n:
        return np.zeros(0, np.uint64)
    low = np.frombuffer(data, "<u4", n, 9).astype(np.uint64)
    high = np.frombuffer(data, "u1", n, 9 + 4 * n).astype(np.uint64)
    steps = low | (high << np.uint64(32))
    steps[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest."""
    kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if not len(counts) or counts.max() <= np.iinfo(k).max)
    return kind[-1:].encode() + counts.astype(kind).tobytes()


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {"1": "u1", "2": "<u2", "4": "<u4", "8": "<u8"}[data[:1].decode()], -1, 1).astype(np.int64)


def _distinct(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each is in training."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(train[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


REQUEST = "range int, chunk int, kind int, n int, hashes binary, counts binary"
ANSWER = "chunk int, range int, kind int, counts binary, total long, known long, ends long"


def requests(dealt: DataFrame, ranges: int) -> DataFrame:
    """What each chunk holds, by range of hashes."""
    shift = 56 - (ranges.bit_length() - 1)

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        token, state, begins = tokens(_one(table.column("text")))
        train = np.repeat(np.asarray(_one(table.column("train")).to_numpy(zero_copy_only=False), bool), np.diff(begins))
        rows: list[tuple] = []
        for kind, values in enumerate(_entries(token, state)):
            distinct, counts = _distinct(values, train)
            # Only ranges that hold an entry: a chunk never sends more rows than it has entries.
            into = distinct >> np.uint64(shift)
            begins_at = np.flatnonzero(np.diff(into, prepend=~into[:1])).tolist()
            for a, b in zip(begins_at, [*begins_at[1:], len(distinct)]):
                rows.append((int(into[a]), chunk, kind, b - a, packed(distinct[a:b]), _small(counts[a:b])))
        return _table(rows, REQUEST)

    return dealt.groupBy("chunk").applyInArrow(run, REQUEST)


def answers(asked: DataFrame) -> DataFrame:
    """Totals over all chunks, in the order of each chunk's entries; also sums over each range."""
    last = int(END >> np.uint64(8))

    def run(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        out: list[tuple] = []
        for kind in (0, 1):
            mine = [r for r in asked if r["kind"] == kind]
            if not mine:
                continue
            values = np.concatenate([unpacked(r["hashes"], r["n"]) for r in mine])
            counts = np.concatenate([_counts(r["counts"]) for r in mine])
            distinct, place = np.unique(values, return_inverse=True)
            sums = np.bincount(place, counts, len(distinct)).astype(np.int64)
            at = 0
            for r in mine:
                out.append((r["chunk"], r["range"], kind, _small(sums[place[at : at + r["n"]]]), 0, 0, 0))
                at += r["n"]
            if kind == 0:
                ends = int(sums[distinct == np.uint64(last)].sum())
                out.append((-1, mine[0]["range"], kind, b"", int(sums.sum()), int((sums > 0).sum()), ends))
        return _table(out, ANSWER)

    return asked.groupBy("range").applyInArrow(run, ANSWER)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


WALK = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
    "unseen double, scores array<double>, left_out array<double>"
)


def walk(token_count, pair_count, state_count, total: int, known: int, own: int = 0):
    """Log10 weights of all steps: ``(class, root arc, one row per failure weight)``.

    A step takes the state's own arc if there is one, else the failure arc and the root's. ``own`` is
    what to take off every count: 1 leaves the token itself out of training. States that are not
    there any more have class -1.
    """
    root = np.log10((np.maximum(token_count - own, 0) + ADDED) / (max(total - own, 0) + ADDED * (known + 1)))
    state = np.maximum(state_count - own, 0)
    share = np.maximum(pair_count - own, 0) / np.maximum(state, 1)
    kind = np.where(state > 0, np.searchsorted(CLASSES, state, "right"), -1)
    arc = share > 0

    def steps():
        for failure in FAILURES:
            step = math.log10(failure) + root
            step[arc] = np.log10((1 - failure) * share[arc] + failure * 10.0 ** root[arc])
            yield step

    return kind, root, steps()


def _sums(walked_steps, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: what states never seen add, and what each class and failure weight add.

    ``text`` is the number of each step's text. One failure weight's steps are held at a time.
    """
    kind, root, steps = walked_steps
    wide = len(CLASSES) + 2
    cell = text * wide + np.where(kind < 0, wide - 1, kind)
    unseen = np.bincount(cell, root, texts * wide).reshape(texts, wide)[:, -1]
    added = [np.bincount(cell, step, texts * wide).reshape(texts, wide)[:, :-1] for step in steps]
    return unseen, np.stack(added, 2).reshape(texts, -1)


def walked(dealt: DataFrame, answered: DataFrame, total: int, known: int, texts: int) -> DataFrame:
    """Every text's sums by class and failure weight; each chunk's first row has ``left_out``."""

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        token, state, begins = tokens(_one(table.column("text")))
        told: dict[int, list] = {0: [], 1: []}
        for r in sorted(given.to_pylist(), key=lambda r: r["range"]):
            told[r["kind"]].append(_counts(r["counts"]))
        found = []
        for kind, values in enumerate(_entries(token, state)):
            totals = np.concatenate(told[kind])
            distinct, place = np.unique(values, return_inverse=True)
            assert len(distinct) == len(totals), "a chunk's texts changed between two reads"
            found.append(totals[place])
            del values, distinct, place
        del token, state
        word, pair = found
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[begins[:-1]] = texts
        train = np.asarray(_one(table.column("train")).to_numpy(zero_copy_only=False), bool)
        rows = begins[:-1]
        base = np.add.reduceat(np.log10((word + ADDED) / (total + ADDED * (known + 1))), rows)
        text = np.repeat(np.arange(len(rows)), np.diff(begins))
        unseen, scores = _sums(walk(word, pair, before, total, known), text, len(rows))
        # Only training texts are in the counts, so only they can be left out of them.
        own = train[text]
        _, less = _sums(walk(word[own], pair[own], before[own], total, known, 1), np.zeros(int(own.sum()), np.int64), 1)
        lists = lambda x: pa.array(x, pa.list_(pa.float64()))
        return pa.table(
            {
                "doc_id": _one(table.column("doc_id")), "held_out": pa.array(~train), "n_tokens": pa.array(np.diff(begins)),
                "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), rows)), "base_score": pa.array(base),
                "unseen": pa.array(unseen), "scores": lists(scores.tolist()),
                "left_out": lists([less[0].tolist(), *[None] * (len(rows) - 1)]),
            }
        )

    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, WALK)


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, failures)`` per row."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    chunks = -(-size // chunk_bytes)
    # Words take about six bytes with their blank.
    ranges = 1 << max(0, math.ceil(math.log2(max(1, size / 6 / range_tokens))))
    dealt = own.select(
        "doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"),
        F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int").alias("chunk"),
    )
    answered = written(answers(requests(dealt, ranges)))
    total, known, texts = (x or 0 for x in answered.filter("chunk < 0").agg(F.sum("total"), F.sum("known"), F.sum("ends")).first())
    given = answered.filter("chunk >= 0").select("chunk", "range", "kind", "counts")
    made = written(walked(dealt, given, total, known, texts))
    n = len(FAILURES)
    sums = made.agg(*[F.sum(F.col("left_out")[i]) for i in range(n * (len(CLASSES) + 1))]).first()
    best = [max(range(n), key=lambda i: (sums[k * n + i] or 0.0, i)) for k in range(len(CLASSES) + 1)]
    value = F.col("unseen")
    for k, i in enumerate(best):
        value = value + F.col("scores")[k * n + i]
    return made.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score",
        value.alias("score"), F.array(*[F.lit(FAILURES[i]) for i in best]).alias("failures"),
    )
