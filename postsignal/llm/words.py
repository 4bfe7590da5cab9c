"""Word places and word hashes of many texts at once, as numpy arrays over Arrow buffers.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. Both hold byte for
byte in UTF-8, so nothing has to be decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = bytes([32, *range(9, 14)])
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for the sequence of the hashes in ``parts``, element by element."""
    out = mixed(parts[0] + np.uint64(len(parts)))
    for part in parts[1:]:
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + part)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _ODD, np.uint64), np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"] = np.multiply.accumulate(up)
        _POWERS["down"] = np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs ``(first row, end row, bytes, offsets)`` of about ``most`` bytes; a longer text is one run.

    A null text is an empty one.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(at, at[first] + most, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of each word, words before each text)``; the second has one entry more than texts."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.ones(256, bool)
    inside[list(SPACE)] = False
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    word = inside[raw]
    begins = offsets[:-1][offsets[:-1] < n]
    head = word.copy()
    head[1:] &= ~word[:-1]
    head[begins] = word[begins]
    tail = word.copy()
    tail[:-1] &= ~word[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    tail[ends] = word[ends]
    start, stop = np.flatnonzero(head), np.flatnonzero(tail)
    up, down = _powers(n)
    total = np.cumsum((lower + np.uint64(1))[raw] * up[:n])
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    value = (total[stop] - before) * down[start]
    value = mixed(value + mixed((stop - start + 1).astype(np.uint64)))
    return value, np.searchsorted(start, offsets)
