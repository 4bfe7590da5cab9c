"""Codes over metric trees against every part compared with every entry."""

import hashlib

import numpy as np
import pytest

from postsignal.llm import vector_codes
from postsignal.llm.vector_codes import Coding

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, to):
    """``(id, code, error, label)`` sorted, and the digest of the codebooks."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(r[1]) for r in kept) // to.parts) * to.parts
    x = np.zeros((len(kept), width), np.int64)
    for i, r in enumerate(kept):
        x[i, : len(r[1])] = np.floor(np.array(r[1], np.float32).astype(np.float64) * to.scale)
    code, error, numbers = [""] * len(kept), np.zeros(len(kept), np.int64), []
    for part in np.split(x, to.parts, axis=1):
        book = part[: to.entries].copy()
        for turn in range(to.rounds + 1):
            gap = ((part[:, None] - book[None]) ** 2).sum(-1)
            entry = gap.argmin(1)
            if turn < to.rounds:
                for e in set(entry.tolist()):
                    mine = part[entry == e]
                    book[e] = [int(s) // len(mine) for s in mine.sum(0)]
        error += gap[np.arange(len(kept)), entry]
        code = [c + f"{e:02x}" for c, e in zip(code, entry)]
        numbers += book.ravel().tolist()
    sha = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    per_label = {}
    for r, e in zip(kept, error.tolist()):
        per_label[r[2]] = per_label.get(r[2], 0) + e
    return sorted(((r[0], c, e, per_label[r[2]], sha) for r, c, e in zip(kept, code, error.tolist())), key=repr)


def found(vectors, to):
    made = vector_codes.codes(vectors, to=to).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in made.collect()), key=repr)


@pytest.mark.parametrize("leaf", [4, 160])
def test_equals_brute_force_with_clumps_and_repeats(spark, leaf):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(9, 16))
    rows = [(i, (centres[i % 9] + draw.normal(size=16) * 0.05).astype(np.float32).tolist(), i % 4) for i in range(600)]
    rows += [(1000 + i, rows[7][1], None) for i in range(300)]  # a third equal
    to = Coding(leaf=leaf)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), to) == by_hand(rows, to)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.5] * 8, 1), (3, None, 1), (4, [nan] * 8, 1), (6, [inf, *[0.0] * 7], 1), (7, [None, *[0.0] * 7], 2), (None, [0.25] * 8, None),
        (8, [1.0, 2.0], 2), (9, [], 2), (5, [0.5] * 8, 1), (10, [-0.0001] * 8, 2), (11, [0.1] * 11, None),
    ]
    to = Coding(rounds=2)
    vectors = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", error string, trees string")
    assert found(vectors, to) == by_hand(rows, to)
    assert len(found(vectors, to)) == 7


def test_ties_go_to_the_lower_entry(spark):
    rows = [(0, [0.0] * 8, 0), (1, [2.0] * 8, 0), (2, [0.0] * 8, 0), (3, [1.0] * 8, 0)]
    got = {r[0]: r[1] for r in found(spark.createDataFrame(rows, SCHEMA), Coding(entries=3, rounds=0))}
    assert got == {0: "00" * 8, 1: "01" * 8, 2: "00" * 8, 3: "00" * 8}


def test_huge_components_do_not_fail(spark):
    rows = [(i, [3e38 if i == 2 else 0.1 * i] * 8, 0) for i in range(20)]
    assert len(found(spark.createDataFrame(rows, SCHEMA), Coding(rounds=1))) == 20


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA), Coding()) == []
    assert found(spark.createDataFrame([(1, None, 1)], SCHEMA), Coding()) == []


def test_balls_hold_their_points_and_most_are_owned_whole():
    draw = np.random.default_rng(1)
    points = (draw.normal(size=(30, 4))[draw.integers(0, 30, 5000)] * 4096 + draw.normal(size=(5000, 4)) * 40).astype(np.int64)
    grown = vector_codes.tree(points, 40)
    for b in range(len(grown.first)):
        mine = grown.points[grown.first[b] : grown.end[b]]
        assert np.sqrt(((mine - grown.pivot[b]) ** 2).sum(1)).max() <= grown.radius[b] + 1e-9
        assert (mine.sum(0) == grown.total[b]).all()
    assert sorted(grown.order.tolist()) == list(range(5000))
    compared = sum(len(at) for at, whole, _ in vector_codes.owned(grown, points[:16]) if whole is None)
    assert compared < 2500
