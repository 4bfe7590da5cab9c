"""Words of Han text from a dictionary that is learnt from the texts themselves.

A string of two to ``longest`` characters is a word if it is frequent enough, its parts stand together
more often than by chance at each of its cuts (cohesion), and many different characters stand before
and after it (branching entropy). Both follow from counts of strings alone. A run of Han characters is
then cut into the most probable row of words, where a word's probability is its share of all counts.

Cutting is done per stretch of a run that no place without a word across it divides; there are no
choices across such a place. So each stretch is short however long the run is, and the most probable
rows of all stretches of a packet of runs are found together, place by place. Equal runs are cut once.

Null and empty texts have no runs. Ties: of equally probable rows, the one whose last word is longer.
Repeated rows: counted and cut as often as they occur. No words found: single characters. Empty table:
no rows.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HAN_LETTER
from ..session import written

# These functions travel to the workers with the job, whatever the import path there is.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Induction:
    longest: int = 4
    least: int = 5
    cohesion: float = 1.0
    entropy: float = 0.8


#: Characters of runs that are numbered, and cut, at once.
PACKET = 1_000_000


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Runs of ``PACKET`` characters or a little more; a longer run is a packet of its own."""
    held, size = [], 0
    for batch in batches:
        for run in batch.column(0).to_pylist():
            held.append(run)
            size += len(run)
            if size >= PACKET:
                yield held
                held, size = [], 0
    if held:
        yield held


def _laid_out(held: list[str]) -> np.ndarray:
    """Code points of all runs in a row, each followed by a 0."""
    return np.frombuffer("\0".join([*held, ""]).encode("utf-32-le"), np.uint32)


def _numbered(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(n, places, numbers, at)`` for each length: where strings begin, which of the distinct ones they are
    (numbered as they turn up), and a place of each distinct one.

    A string is numbered by its first ``n - 1`` characters' number and its last character, which is exact.
    """
    letters = np.flatnonzero(np.bincount(codes, minlength=1))
    letter = np.zeros(letters[-1] + 1, np.int64)
    letter[letters] = np.arange(len(letters))  # a 0 is always there, and first
    own = np.concatenate([letter[codes], np.zeros(longest, np.int64)])
    places, before = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for n in range(1, longest + 1):
        last = own[places + n - 1]
        places, before, last = places[last > 0], before[last > 0], last[last > 0]
        coded = pa.array(before * len(letters) + last).dictionary_encode()
        numbers = coded.indices.to_numpy().astype(np.int64)
        at = np.empty(len(coded.dictionary), np.int64)
        at[numbers] = places
        yield n, places, numbers, at
        before = numbers


def _spelled(codes: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The strings of ``n`` characters at some places."""
    shown = np.ascontiguousarray(codes[at[:, None] + np.arange(n)])
    return pa.array(shown.view(f"<U{n}").ravel().tolist(), pa.string())


def gram_counts(texts: DataFrame, to: Induction = Induction(), column: str = "content") -> DataFrame:
    """``(gram, n, count)`` of all strings of up to one more character than a word has, overlapping ones too.

    Counted within packets of runs first, so only a packet's distinct strings leave its task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _packets(batches):
            codes = _laid_out(held)
            for n, _, numbers, at in _numbered(codes, to.longest + 1):
                counts = pa.array(np.bincount(numbers, minlength=len(at)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([_spelled(codes, at, n), counts], ["gram", "count"])

    parts = texts.select(F.explode(runs(F.col(column))).alias("run")).mapInArrow(count, "gram string, count bigint")
    counted = parts.groupBy("gram").agg(F.sum("count").alias("count"))
    return counted.select("gram", F.char_length("gram").cast("long").alias("n"), "count")


def _branching(counts: DataFrame, part: Column, name: str) -> DataFrame:
    """Per string, counts of the strings with one character more at one side: total and ``sum c ln c``."""
    c = F.col("count").cast("double")
    longer = counts.filter("n > 2").select(part.alias("of"), c.alias("c"))
    return longer.groupBy("of").agg(F.sum("c").alias(f"{name}_all"), F.sum(F.col("c") * F.ln("c")).alias(f"{name}_log"))


def _entropy(name: str) -> Column:
    """Entropy of the neighbours at one side; the ends of runs count as one more neighbour."""
    c = F.col("count").cast("double")
    edge = c - F.coalesce(f"{name}_all", F.lit(0.0))
    logs = F.coalesce(f"{name}_log", F.lit(0.0)) + F.when(edge > 0, edge * F.ln(edge)).otherwise(0.0)
    return F.ln(c) - logs / c


def dictionary(counts: DataFrame, to: Induction = Induction()) -> DataFrame:
    """``(gram, n, count, cohesion, left_entropy, right_entropy)`` of the words.

    ``counts`` is read several times and should be a stored table. Single characters are not listed.
    """
    frequent = counts.filter((F.col("n") > 1) & (F.col("n") <= to.longest) & (F.col("count") >= to.least))
    before = _branching(counts, F.expr("substring(gram, 2)"), "left")
    after = _branching(counts, F.expr("left(gram, n - 1)"), "right")
    free = (
        frequent.join(before.withColumnRenamed("of", "gram"), "gram", "left")
        .join(after.withColumnRenamed("of", "gram"), "gram", "left")
        .select("gram", "n", "count", _entropy("left").alias("left_entropy"), _entropy("right").alias("right_entropy"))
        .filter(F.least("left_entropy", "right_entropy") >= to.entropy)
    )
    total = counts.filter("n = 1").agg(F.sum("count")).scalar()
    cuts = free.select("gram", "count", F.explode(F.expr("sequence(1, cast(n as int) - 1)")).alias("cut")).select(
        "gram", "count", F.expr("left(gram, cut)").alias("head"), F.expr("substring(gram, cut + 1)").alias("tail")
    )
    part = counts.select(F.col("gram").alias("part"), F.col("count").cast("double").alias("c"))
    with_head = cuts.join(part.withColumnsRenamed({"part": "head", "c": "head_count"}), "head")
    with_both = with_head.join(part.withColumnsRenamed({"part": "tail", "c": "tail_count"}), "tail")
    chance = F.ln(F.col("count").cast("double")) + F.ln(total.cast("double")) - F.ln("head_count") - F.ln("tail_count")
    bound = with_both.groupBy("gram").agg(F.min(chance).alias("cohesion")).filter(F.col("cohesion") >= to.cohesion)
    return free.join(bound, "gram").select("gram", "n", "count", "cohesion", "left_entropy", "right_entropy")


def word_weights(counts: DataFrame, words: DataFrame) -> DataFrame:
    """``(gram, weight)``: logarithm of the share of all counts in millionths, for words and single characters.

    Whole numbers add up exactly, so equally probable rows are ties in any order of their words.
    """
    known = counts.filter("n = 1").select("gram", "count").unionByName(words.select("gram", "count"))
    total = known.agg(F.sum("count")).scalar()
    return known.select("gram", F.round(F.ln(F.col("count") / total) * 1_000_000).cast("long").alias("weight"))


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({HAN_LETTER}+)"), F.lit(1))


#: Weight of what is no word.
NONE = -(1 << 62)


def _begins(codes: np.ndarray, weight: list[np.ndarray]) -> np.ndarray:
    """Whether a word of the most probable row begins at each place.

    ``weight[n - 1]`` has, per place, the weight of the word of ``n`` characters that begins there, or
    ``NONE``. All stretches take a step at the same time: one character more at the end of the best row
    so far, then, backwards, one word less.
    """
    open_ = np.ones(len(codes) + 1, bool)
    for n in range(2, len(weight) + 1):
        found = np.flatnonzero(weight[n - 1] > NONE)
        for j in range(1, n):
            open_[found + j] = False
    bounds = np.flatnonzero(open_)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    start, size = bounds[order], sizes[order]
    best, chosen = np.zeros(len(codes) + 1, np.int64), np.ones(len(codes) + 1, np.int64)
    for t in range(1, (size[0] if len(size) else 0) + 1):
        active = np.searchsorted(-size, -t, side="right")
        end = start[:active] + t
        top = best[end - 1] + weight[0][end - 1]
        n_top = np.ones(active, np.int64)
        for n in range(2, min(len(weight), t) + 1):
            other = best[end - n] + weight[n - 1][end - n]
            longer = other >= top  # of equals, the longer last word
            top, n_top = np.where(longer, other, top), np.where(longer, n, n_top)
        chosen[end] = n_top
        # The end of a stretch may be the start of the next one, whose best is 0.
        inside = size[:active] > t
        best[end[inside]] = top[inside]
    begins = open_[:-1].copy()
    at = start + size
    while len(at):
        at = at - chosen[at]
        begins[at] = True
        start, at = start[at > start], at[at > start]
    return begins


def _cut(held: list[str], place: np.ndarray, known: np.ndarray, longest: int) -> pa.Array:
    """Lists of words of the runs; ``place`` numbers the strings with a weight, which ``known`` has."""
    codes = _laid_out(held)
    weight, first = [], 0
    given = np.full(place.max(initial=-1) + 1, NONE)
    given[place] = known
    for n, places, numbers, at in _numbered(codes, longest):
        own = np.full(len(at), NONE)
        part = given[first : first + len(at)]
        own[: len(part)] = part
        there = np.full(len(codes), NONE)
        there[places] = own[numbers]
        weight.append(there)
        first += len(at)
    ends = np.flatnonzero(codes == 0)
    sizes = np.diff(ends, prepend=-1) - 1
    lost = (weight[0] == NONE) & (codes > 0)
    weight[0] = np.where(weight[0] == NONE, 0, weight[0])
    begins = _begins(codes, weight)
    # A run with a character that has no weight stays single characters.
    begins |= np.repeat(np.add.reduceat(lost, ends - sizes) > 0, sizes + 1)
    begins[ends] = False
    width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
    width[ends] = 0
    byte = np.concatenate([[0], np.cumsum(width)])
    offsets = np.append(byte[:-1][begins], byte[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer("".join(held).encode()))
    lists = np.concatenate([[0], np.cumsum(begins)[ends]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), words)


def cut_runs(distinct: DataFrame, weights: DataFrame, longest: int = Induction.longest) -> DataFrame:
    """``(run, words)`` for the runs of ``distinct (run)``; every character must be among ``weights``.

    Runs are kept in packets. A packet asks for the weights of its distinct strings, gets back those that
    have one and cuts all its runs with them, so no task needs the dictionary.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _packets(batches):
            codes = _laid_out(held)
            grams = pa.concat_arrays([_spelled(codes, at, n) for n, _, _, at in _numbered(codes, longest)])
            key = pa.array([uuid.uuid4().int >> 65])
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (pa.array(held, pa.string()), grams)]
            yield pa.RecordBatch.from_arrays([key, *lists], ["packet", "runs", "grams"])

    def cut(packet: pa.Table, known: pa.Table) -> pa.Table:
        held = packet.column("runs")[0].as_py()
        place, weight = (known.column(c).to_numpy().astype(np.int64) for c in ("place", "weight"))
        return pa.table({"run": pa.array(held, pa.string()), "words": _cut(held, place, weight, longest)})

    packets = written(distinct.select("run").filter("run <> ''").mapInArrow(pack, "packet bigint, runs array<string>, grams array<string>"))
    asked = packets.select("packet", F.posexplode("grams").alias("place", "gram"))
    known = asked.join(weights, "gram").select(F.col("packet").alias("of"), "place", "weight")
    return (
        packets.select("packet", "runs")
        .groupBy("packet")
        .cogroup(known.groupBy("of"))
        .applyInArrow(cut, "run string, words array<string>")
    )


def segmented(texts: DataFrame, weights: DataFrame, longest: int = Induction.longest, column: str = "content") -> DataFrame:
    """``texts`` with the Han runs of ``column`` cut into words, which are set apart by blanks.

    Everything else of the text stays. ``post_id`` must be unique.
    """
    spread = texts.select("post_id", F.posexplode(runs(F.col(column))).alias("place", "run"))
    cut = written(cut_runs(spread.select("run").distinct(), weights, longest))
    shown = cut.select("run", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("shown"))
    per_text = (
        spread.join(shown, "run")
        .groupBy("post_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "shown")))["shown"].alias("_shown"))
    )
    rest = F.split(F.col(column), f"{HAN_LETTER}+", -1)
    joined = F.array_join(F.flatten(F.zip_with(rest, F.col("_shown"), lambda r, s: F.array(r, F.coalesce(s, F.lit(""))))), "")
    return texts.join(per_text, "post_id", "left").withColumn(column, F.when(F.col("_shown").isNull(), F.col(column)).otherwise(joined)).drop("_shown")
