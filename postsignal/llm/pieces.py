"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

The model file is compiled once, on the driver, into three transducers: the normaliser (blanks to
``▁``, and a leading one), the pieces (one arc per piece, its weight the negated score) and the byte
fallback (a character that no piece covers becomes the arcs of its UTF-8 bytes). An input is composed
with them from left to right: a state is a place in the input and the last piece, and in the tropical
semiring the lightest path to each state is kept.

A model trained by merging has no weights whose sum the merges minimise. It does have one path on
which every two neighbours are what merging their joint text gives, and that path is what merging
gives for the whole. So in such a model a step between two pieces has infinite weight unless merging
their joint text gives just these two, and the lightest path is the merged one.

No piece spans a place where a blank follows something else, so texts are cut there, and a part met
before is looked up. Null or empty text: no ids, decoded as empty. Repeated rows: all returned. Empty
table: no rows. Other columns: left out. A text that itself holds ``▁`` decodes with a blank there,
as the format has it. Texts are worked on one by one, so memory is bounded by the longest text.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2


def _wire(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of one protocol-buffer message as ``(number, value)``."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            n = number()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + n])[0]
            at += n


class Transducer:
    """The compiled model. ``encode`` gives ids, ``decode`` the text."""

    def __init__(self, model: bytes) -> None:
        listed, trainer, normaliser = [], {}, {}
        for field, value in _wire(model):
            if field == 1:
                own = dict(_wire(value))
                listed.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_wire(value))
            elif field == 3:
                normaliser = dict(_wire(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models have a path of pieces")
        if normaliser.get(2):
            raise ValueError("a normaliser with its own character map is not compiled here")
        if normaliser.get(4, 1):
            raise ValueError("a normaliser that removes blanks cannot be decoded exactly")
        self.prefix = BLANK if normaliser.get(3, 1) else ""
        self.weight = {p: -s for p, s, k in listed if k in (NORMAL, DEFINED)}
        self.id = {p: i for i, (p, _, k) in enumerate(listed) if k in (NORMAL, DEFINED)}
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(listed) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(listed) if k == UNKNOWN), 0)
        self.shown = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(BLANK, " ").encode() for p, _, k in listed
        ]
        self.fallback = max(self.weight.values(), default=0.0) + 10
        self.begins = {p[:n] for p in self.weight for n in range(1, len(p) + 1)}
        # Two characters next to each other in some piece: only there can a piece span both.
        self.inside = {p[i : i + 2] for p in self.weight for i in range(len(p) - 1)}
        cut_at_blanks = not any(two[1] == BLANK != two[0] for two in self.inside)
        self.part = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if cut_at_blanks else "(?s).+")

    def merged(self, text: str, trace: list[tuple[float, str, str]] | None = None) -> list[str]:
        """What merging gives: the best pair first, the leftmost of equals.

        ``trace`` gets the first and the last symbol after each merge, with the weight merged at.
        """
        out = list(text)
        while len(out) > 1:
            best = min(
                ((self.weight[out[i] + out[i + 1]], i) for i in range(len(out) - 1) if out[i] + out[i + 1] in self.weight),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [out[i] + out[i + 1]]
            if trace is not None:
                trace.append((best[0], out[0], out[-1]))
        return out

    def edges(self, piece: str) -> tuple[list, list] | None:
        """First and last symbols while ``piece`` is merged, as ``(symbol, from, until)`` by weight.

        None if merging does not give the piece.
        """
        trace: list[tuple[float, str, str]] = []
        if self.merged(piece, trace) != [piece]:
            return None
        sides: tuple[list, list] = ([], [])
        for side, start in ((0, piece[:1]), (1, piece[-1:])):
            symbol, since = start, -math.inf
            for weight, *ends in trace:
                if ends[side] != symbol:
                    sides[side].append((symbol, since, weight))
                    symbol, since = ends[side], weight
            sides[side].append((symbol, since, math.inf))
        return sides

    def apart(self, left: tuple[list, list], right: tuple[list, list]) -> bool:
        """Whether two pieces stay two when their joint text is merged.

        They do unless the last symbol of one and the first of the other, both there at some moment,
        make a piece that is merged before either changes. Of equal pieces the leftmost goes first:
        one inside the left text wins over one across, and that over one inside the right text.
        """
        for x, x_from, x_until in left[1]:
            for y, y_from, y_until in right[0]:
                weight = self.weight.get(x + y)
                if weight is not None:
                    moment = max(weight, x_from, y_from)
                    if moment < x_until and moment <= y_until:
                        return False
        return True

    def arcs(self, text: str, at: int) -> Iterator[tuple[str, float]]:
        """Pieces that begin at a place, and the byte fallback where the character is no piece."""
        end = at + 1
        if text[at] not in self.weight:
            yield text[at], self.fallback
        while end <= len(text) and text[at:end] in self.begins:
            if text[at:end] in self.weight:
                yield text[at:end], self.weight[text[at:end]]
            end += 1

    def path(self, text: str, seen: Steps) -> list[str]:
        """The lightest path from the first to the last place."""
        return self.only_path(text, seen) if self.kind == MERGES else self.lightest_path(text)

    def only_path(self, text: str, seen: Steps) -> list[str]:
        """The path of finite weight in a merge model, which is the only one: depth first.

        Each place has at most one state with a finite path to it, so a place that leads nowhere is
        not entered again. ``seen`` remembers which steps are finite.
        """
        out: list[str] = []
        begins, weight, end = self.begins, self.weight, len(text)
        stack: list[tuple[int, int]] = []
        dead: set[int] = set()
        at, last, size = 0, "", -1
        while at < end:
            if size < 0:
                size = 1
                while at + size < end and text[at : at + size + 1] in begins:
                    size += 1
            while size:
                piece = text[at : at + size]
                if at + size not in dead and (piece in weight or size == 1) and seen[last, piece]:
                    break
                size -= 1
            if size:
                stack.append((at, size))
                out.append(piece)
                at, last, size = at + size, piece, -1
            else:
                dead.add(at)
                at, size = stack.pop()
                out.pop()
                last, size = out[-1] if out else "", size - 1
        return out

    def lightest_path(self, text: str) -> list[str]:
        """The path of least weight where steps weigh nothing: the least so far at each place."""
        best: list[tuple[float, str] | None] = [(0.0, ""), *[None] * len(text)]
        for at in range(len(text)):
            if best[at] is None:
                continue
            for piece, weight in self.arcs(text, at):
                there = best[at + len(piece)]
                if there is None or best[at][0] + weight < there[0]:
                    best[at + len(piece)] = (best[at][0] + weight, piece)
        out, at = [], len(text)
        while at > 0:
            out.append(best[at][1])
            at -= len(out[-1])
        return out[::-1]

    def ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[b] for b in piece.encode()]

    def parts(self, text: str) -> list[str]:
        return self.part.findall(self.prefix + text.replace(" ", BLANK)) if text else []

    def decode(self, ids) -> str:
        whole = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return whole[1:] if self.prefix and whole.startswith(" ") else whole


class Steps(dict):
    """Whether a step from one piece to the next is finite in a merge model, worked out once."""

    def __init__(self, model: Transducer) -> None:
        super().__init__()
        self.model, self.edges = model, {}

    def piece(self, piece: str):
        if piece not in self.edges:
            self.edges[piece] = self.model.edges(piece)
        return self.edges[piece]

    def __missing__(self, step: tuple[str, str]) -> bool:
        left, right = step
        a, b = self.piece(left) if left else None, self.piece(right)
        made = bool(b) and (not left or (bool(a) and self.model.apart(a, b)))
        self[step] = made
        return made


class Known(dict):
    """Ids of the parts met so far; a new part is encoded when it is looked up."""

    def __init__(self, model: Transducer, most: int) -> None:
        super().__init__()
        self.model, self.most, self.steps, self.short = model, most, Steps(model), {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        # No piece spans two characters that no piece has side by side.
        inside, begin, out = self.model.inside, 0, []
        for i in range(1, len(part) + 1):
            if i == len(part) or part[i - 1 : i + 1] not in inside:
                out += self._ids(part[begin:i])
                begin = i
        made = tuple(out)
        if len(part) <= 48:
            self[part] = made
        return made

    def _ids(self, text: str) -> tuple[int, ...]:
        if text in self.short:
            return self.short[text]
        made = tuple(i for p in self.model.path(text, self.steps) for i in self.model.ids(p))
        if len(text) <= 48:
            self.short[text] = made
        return made

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
        if len(self.short) > self.most:
            self.short.clear()
        if len(self.steps) > self.most:
            self.steps.clear()


def compiled(path: str = MODEL) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode(docs: DataFrame, path: str = MODEL, most_known: int = 600_000) -> DataFrame:
    """``(doc_id, ids)`` for each row; nothing is shuffled."""
    model = compiled(path)

    def run(batches):
        known = Known(model, most_known)
        for batch in batches:
            # Rows go out in small batches, so ids of many long texts are never held together.
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                values, ends = [], [0]
                for text in part.column(1).to_pylist():
                    parts = model.parts(text or "")
                    ids = np.fromiter(chain.from_iterable(map(known.__getitem__, parts)), np.int32)
                    values.append(ids)
                    ends.append(ends[-1] + len(ids))
                    known.trim()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give an empty text."""
    model = compiled(path)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [model.decode(ids or ()) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def encoded_and_decoded(docs: DataFrame, path: str = MODEL, most_known: int = 600_000) -> DataFrame:
    """``(doc_id, n_ids, ids, n_fallback, round_trip)``: ids, and whether they decode to the text."""
    model = compiled(path)
    bytes_first, bytes_last = min(model.byte_id.values(), default=-1), max(model.byte_id.values(), default=-2)

    def run(batches):
        known = Known(model, most_known)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                values, same, fell = [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    ids = list(chain.from_iterable(map(known.__getitem__, model.parts(text))))
                    same.append(model.decode(ids) == text.replace(BLANK, " "))
                    values.append(np.array(ids, np.int32))
                    fell.append(int(((values[-1] >= bytes_first) & (values[-1] <= bytes_last)).sum()))
                    known.trim()
                sizes = [len(v) for v in values]
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), lists, pa.array(fell, pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_ids", "ids", "n_fallback", "round_trip"],
                )

    schema = "doc_id long, n_ids long, ids array<int>, n_fallback long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
