"""Regression of a vote count on texts by a small network: embeddings, convolutions, largest response.

Words are numbered by hash into a fixed number of places, each with a trained vector. Filters of two,
three and four words run over the whole text; of each filter the largest response counts. These, the
meta features and a constant give the prediction. All weights are one array of a size that is set
beforehand and does not grow with the rows.

Training is gradient descent over the table: in a step, every task adds up the gradients of its rows,
chunks of these sums are added up over the tasks, and the driver, which holds the weights alone, takes
the step. Rows are stored in packets of some texts, as small numbers in a few bytes each, and are read whole.

Texts shorter than the widest filter, empty and null ones included: filled up with the empty word 0.
Ties of the largest response: the first place. Rows without a label must be left out by the caller.
No training rows: every prediction is 0.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import removed, written

# These functions travel to the workers with the job, whatever the import path there is.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 4096
WORDS = 8_000  # of texts whose responses are held at once: few enough for a core's cache


@dataclass(frozen=True)
class Settings:
    """``batches`` deals the training rows out: step ``t`` reads those whose rank falls into ``t``'s batch."""

    places: int = 4096
    size: int = 16
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    steps: int = 30
    rate: float = 0.01
    penalty: float = 0.05
    batches: int = 1
    seed: int = 57


def word_places(tokens: Column, places: int) -> Column:
    """Numbers from 1 of each word, in text order."""
    numbers = F.transform(tokens, lambda t: (F.pmod(F.xxhash64(t), F.lit(places - 1)) + 1).cast("int"))
    return F.coalesce(numbers, F.array().cast("array<int>"))


def shapes(to: Settings, meta: int) -> dict[str, tuple[int, ...]]:
    filters = {f"filter_{w}": (w, to.size, to.filters) for w in to.widths}
    bias = {f"bias_{w}": (to.filters,) for w in to.widths}
    return {"words": (to.places, to.size), **filters, **bias, "out": (to.filters * len(to.widths) + meta + 1,)}


def parts(flat: np.ndarray, to: Settings, meta: int) -> dict[str, np.ndarray]:
    """Views of ``flat`` by name."""
    out, at = {}, 0
    for name, shape in shapes(to, meta).items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def first(to: Settings, meta: int) -> np.ndarray:
    """Weights to begin with: small random numbers; the empty word and the output are 0."""
    draw = np.random.default_rng(to.seed)
    made = []
    for name, shape in shapes(to, meta).items():
        scale = 0.0 if name.startswith("bias") or name == "out" else 0.5 if name == "words" else 1 / math.sqrt(shape[0] * shape[1])
        made.append(draw.normal(0.0, 1.0, shape) * scale)
    made[0][0] = 0.0
    made[-1][: to.filters * len(to.widths)] = draw.normal(0.0, 0.1, to.filters * len(to.widths))
    return np.concatenate([m.ravel() for m in made])


def _laid_out(lists: pa.ListArray, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words in a row, each text filled up to ``widest``; where texts begin, and their sizes."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    full = np.maximum(sizes, widest)
    if len(sizes) and sizes.min() >= widest:  # nothing to fill up
        return flat.astype(np.int64), np.cumsum(sizes) - sizes, full
    begins = np.concatenate([[0], np.cumsum(full)])
    words = np.zeros(begins[-1], np.int64)
    words[np.repeat(begins[:-1], sizes) + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return words, begins[:-1], full


class Tables:
    """Response of every filter to every word, per place in the filter: ``(first column, responses)``.

    There are far fewer words than places in texts, so a place only looks its responses up and adds them,
    of all filters at once. Columns are filters, width by width; those before the first one are of widths
    that have no such place.
    """

    def __init__(self, flat: np.ndarray, to: Settings, meta: int) -> None:
        weights, self.each = parts(flat, to, meta), []
        for j in range(max(to.widths)):
            begin = min(k for k, w in enumerate(to.widths) if w > j)
            none = np.zeros((to.places, to.filters))
            made = [weights["words"] @ weights[f"filter_{w}"][j] if w > j else none for w in to.widths[begin:]]
            self.each.append((begin * to.filters, np.hstack(made)))
        self._room = np.empty((2, 0))

    def sums(self, words: np.ndarray) -> np.ndarray:
        """Responses at every place, in memory that the next call uses again."""
        n, columns = len(words), self.each[0][1].shape[1]
        if self._room.shape[1] < n * columns:
            self._room = np.empty((2, n * columns))
        made = self._room[0, : n * columns].reshape(n, columns)
        self.each[0][1].take(words, axis=0, out=made, mode="clip")
        for j, (column, table) in enumerate(self.each[1:], 1):
            more = self._room[1, : (n - j) * table.shape[1]].reshape(n - j, -1)
            made[:-j, column:] += table.take(words[j:], axis=0, out=more, mode="clip")
        return made


def tables(flat: np.ndarray, to: Settings, meta: int) -> Tables:
    return Tables(flat, to, meta)


def _responses(made_of: Tables, words: np.ndarray, begins: np.ndarray, full: np.ndarray, to: Settings):
    """``(largest response per text and filter, its place)`` of each width."""
    made = made_of.sums(words)
    # Places whose words reach into the next text are none.
    for k, w in enumerate(to.widths):
        for j in range(1, w):
            made[begins + full - j, k * to.filters : (k + 1) * to.filters] = -np.inf
    place = np.array([b + made[b : b + f].argmax(axis=0) for b, f in zip(begins.tolist(), full.tolist())]).reshape(len(begins), -1)
    top = made[place, np.arange(made.shape[1])]
    return [(top[:, c : c + to.filters], place[:, c : c + to.filters]) for c in range(0, made.shape[1], to.filters)]


def forward(flat: np.ndarray, lists: pa.ListArray, meta: np.ndarray, to: Settings, made_of: Tables | None = None):
    """Predictions, and what :func:`gradient` needs. ``made_of``: the weights' :func:`tables`, if they are at hand."""
    weights = parts(flat, to, meta.shape[1])
    words, begins, full = _laid_out(lists, max(to.widths))
    found = _responses(made_of or tables(flat, to, meta.shape[1]), words, begins, full, to)
    raw = np.concatenate([top + weights[f"bias_{w}"] for w, (top, _) in zip(to.widths, found)], axis=1)
    inputs = np.concatenate([np.maximum(raw, 0), meta, np.ones((len(meta), 1))], axis=1)
    return inputs @ weights["out"], (weights, words, found, raw, inputs)


class Gradient:
    """Sum over rows of the gradient of half the squared error, and that sum itself.

    What falls to a word through a place of a filter is added up as one number per word, place and filter,
    like the responses; products with word vectors and filters are made once, of these sums.
    """

    def __init__(self, flat: np.ndarray, to: Settings, meta: int, made_of: Tables | None = None) -> None:
        self.flat, self.to, self.meta, self.error = flat, to, meta, 0.0
        self.made_of = made_of or tables(flat, to, meta)
        self.sums = np.zeros_like(flat)
        self.into = parts(self.sums, to, meta)
        self.fell = [np.zeros((w, to.places, to.filters)) for w in to.widths]

    def add(self, lists: pa.ListArray, meta: np.ndarray, label: np.ndarray) -> None:
        to = self.to
        predicted, (weights, words, found, raw, inputs) = forward(self.flat, lists, meta, to, self.made_of)
        off = predicted - label
        self.error += 0.5 * float(off @ off)
        into = self.into
        into["out"] += inputs.T @ off
        back = off[:, None] * weights["out"][None, : raw.shape[1]] * (raw > 0)
        for k, (w, (_, place)) in enumerate(zip(to.widths, found)):
            here = back[:, k * to.filters : (k + 1) * to.filters]
            into[f"bias_{w}"] += here.sum(axis=0)
            j, each = np.arange(w)[None, :, None], np.arange(to.filters)
            at = (j * to.places + words[place[:, None, :] + j]) * to.filters + each
            np.add.at(self.fell[k].reshape(-1), at.ravel(), np.broadcast_to(here[:, None, :], at.shape).ravel())

    def total(self) -> np.ndarray:
        weights, out = parts(self.flat, self.to, self.meta), self.sums.copy()
        into = parts(out, self.to, self.meta)
        for w, places in zip(self.to.widths, self.fell):
            for j, fell in enumerate(places):
                into[f"filter_{w}"][j] += weights["words"].T @ fell
                into["words"] += fell @ weights[f"filter_{w}"][j].T
        into["words"][0] = 0.0  # the empty word is no word
        return out


def gradient(flat: np.ndarray, lists: pa.ListArray, meta: np.ndarray, label: np.ndarray, to: Settings, made_of: Tables | None = None) -> tuple[np.ndarray, float]:
    """:class:`Gradient` of the rows given."""
    found = Gradient(flat, to, meta.shape[1], made_of)
    found.add(lists, meta, label)
    return found.total(), found.error


def _inputs(batch: pa.RecordBatch, scaled: list[tuple[float, float]]) -> tuple[pa.ListArray, np.ndarray]:
    meta = [np.asarray(batch.column(2 + i).to_numpy(zero_copy_only=False), np.float64) for i in range(len(scaled))]
    columns = [(m - mean) / sd for m, (mean, sd) in zip(meta, scaled)]
    return batch.column(1), np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


def _pieces(batch: pa.RecordBatch, scaled: list[tuple[float, float]]):
    """``(begin, end, word lists, meta features)`` of rows with about ``WORDS`` words together."""
    lists, meta = _inputs(batch, scaled)
    ends = lists.offsets.to_numpy()[1:]
    cuts = np.flatnonzero(np.diff((ends - ends[:1]) // WORDS, prepend=-1, append=-1)).tolist() if len(ends) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield a, b, lists.slice(a, b - a), meta[a:b]


def _packed(train: DataFrame, meta: list[str], to: Settings) -> DataFrame:
    """A stored table of packets of training rows: batch, word numbers, sizes, labels and meta features as bytes.

    Every step reads all of it. A value per text and word would be taken apart and put together again then.
    """
    kind = "<u2" if to.places <= 1 << 16 else "<u4"
    names = ["batch", "words", "sizes", "label", "meta"]

    def run(batches):
        for whole in batches:
            turns = np.asarray(whole.column(2).to_numpy(zero_copy_only=False))
            for turn in np.unique(turns):
                batch = whole.filter(pa.array(turns == turn))
                label = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.float64)
                own = pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, *range(3, 3 + len(meta)))], [str(i) for i in range(2 + len(meta))])
                for a, b, lists, features in _pieces(own, [(0.0, 1.0)] * len(meta)):
                    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                    values = [v.tobytes() for v in (flat.astype(kind), sizes.astype("<u4"), label[a:b], np.ascontiguousarray(features))]
                    yield pa.RecordBatch.from_arrays([pa.array([int(turn)], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names)

    batch = (F.col("rank") % to.batches).cast("int") if to.batches > 1 else F.lit(0)
    schema = "batch int, words binary, sizes binary, label binary, meta binary"
    return written(train.select("label", "words", batch.alias("batch"), *meta).mapInArrow(run, schema))


def _unpacked(batch: pa.RecordBatch, meta: int, to: Settings):
    """``(word lists, labels, meta features)`` of every packet; the columns are those of a packet but its batch."""
    kind = "<u2" if to.places <= 1 << 16 else "<u4"
    for words, sizes, label, features in zip(*[c.to_pylist() for c in batch.columns]):
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int32)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(words, kind)))
        yield lists, np.frombuffer(label), np.frombuffer(features).reshape(-1, meta)


def _summed(packets: DataFrame, flat: np.ndarray, scaled, centre: float, spread: float, to: Settings) -> tuple[np.ndarray, float, int]:
    """Gradient, half the squared error and number of rows, added up over all tasks."""
    mean, sd = np.array(scaled).reshape(-1, 2).T

    def run(batches):
        found, n = Gradient(flat, to, len(scaled)), 0
        for batch in batches:
            for lists, label, meta in _unpacked(batch, len(scaled), to):
                found.add(lists, (meta - mean) / sd, (label - centre) / spread)
                n += len(label)
        if n:
            every = np.concatenate([[found.error, n], found.total()])
            for k in range(0, len(every), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([every[k : k + CHUNK].tobytes()])], ["chunk", "sums"])

    def add(table: pa.Table) -> pa.Table:
        chunks = [np.frombuffer(b) for b in table.column("sums").to_pylist()]
        return pa.table({"chunk": [table.column("chunk")[0].as_py()], "sums": [np.sum(chunks, axis=0).tobytes()]})

    schema = "chunk bigint, sums binary"
    given = packets.select("words", "sizes", "label", "meta")
    found = given.mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).collect()  # the size of the weights
    every = np.zeros(len(flat) + 2)
    for r in found:
        values = np.frombuffer(r["sums"])
        every[r["chunk"] : r["chunk"] + len(values)] = values
    return every[2:], every[0], int(every[1])


@dataclass(frozen=True)
class Model:
    flat: np.ndarray
    scaled: list[tuple[float, float]]
    centre: float
    spread: float
    losses: list[float]


def fit(train: DataFrame, meta: list[str], to: Settings = Settings()) -> Model:
    """The network fitted to ``train (rank, label, words, meta columns)``, a stored table."""
    stats = train.agg(
        *[f(c) for c in ["label", *meta] for f in (F.avg, F.stddev_pop)]
    ).first()
    moments = [(stats[2 * i] or 0.0, stats[2 * i + 1] or 1.0) for i in range(len(meta) + 1)]
    (centre, spread), scaled = moments[0], moments[1:]
    flat = first(to, len(meta))
    mean, square, losses = np.zeros_like(flat), np.zeros_like(flat), []
    packets = _packed(train, meta, to)
    for turn in range(1, to.steps + 1):
        rows = packets if to.batches == 1 else packets.filter(F.col("batch") == turn % to.batches)
        total, error, n = _summed(rows, flat, scaled, centre, spread, to)
        if not n:
            continue
        slope = total / n
        out = parts(flat, to, len(meta))["out"]
        parts(slope, to, len(meta))["out"][:-1] += to.penalty * out[:-1]
        losses.append(error / n + 0.5 * to.penalty * float(out[:-1] @ out[:-1]))
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        flat = flat - to.rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    removed(packets)
    return Model(flat, scaled, centre, spread, losses)


def predicted(rows: DataFrame, model: Model, meta: list[str], to: Settings = Settings()) -> DataFrame:
    """``(post_id, split, label, prediction)``."""

    def run(batches):
        made_of = tables(model.flat, to, len(model.scaled))
        for batch in batches:
            for a, b, lists, own in _pieces(batch, model.scaled):
                made, _ = forward(model.flat, lists, own, to, made_of)
                given = batch.slice(a, b - a).columns
                columns = [*given[-2:], given[0], pa.array(made * model.spread + model.centre)]
                yield pa.RecordBatch.from_arrays(columns, ["post_id", "split", "label", "prediction"])

    given = rows.select(F.col("label").cast("double"), "words", *meta, F.col("post_id").cast("long"), "split")
    return given.mapInArrow(run, "post_id long, split string, label double, prediction double")
