"""SimHash fingerprints and components against bit counts and all pairs."""

import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from postsignal.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_bits(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    k = min(4, len(words))
    made = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in made) > len(made))


def least_of(fps):
    """Smallest index reachable for each index of ``fps``."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_equals_brute_force(documents, texts):
    ids = sorted(texts)
    fps = [by_bits(texts[i]) for i in ids]
    roots = least_of(fps)
    expected = {i: (f"{fp:016x}", ids[r]) for i, fp, r in zip(ids, fps, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.components(documents).collect()} == expected


@pytest.mark.parametrize("crowded", [0, 1000])
def test_components_of_clouds_of_fingerprints(spark, crowded):
    """Chains, balls around a centre, near misses and noise; each way a pair can differ in is there."""
    draw = random.Random(8)
    flip = lambda x, n: x ^ sum(1 << b for b in draw.sample(range(64), n))
    fps = set()
    for _ in range(30):
        at = draw.getrandbits(64)
        for n in (1, 2, 3, 4, 5, 6, 9):
            fps |= {at, flip(at, n)}
    for _ in range(3):
        at = draw.getrandbits(64)
        for _ in range(60):
            at = flip(at, draw.choice([3, 4, 4]))
            fps.add(at)
        fps |= {flip(at, draw.choice([1, 2, 3, 4, 5, 6])) for _ in range(120)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f, 1) for f in signed], "fp long, rows long"), crowded=crowded)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    place = {f: i for i, f in enumerate(signed)}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in pairs)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(place[a]), root(place[b])))
        parent[y] = x
    assert [root(i) for i in range(len(fps))] == least_of(fps)


def test_every_pair_within_reach_shares_a_variant():
    draw = random.Random(2)
    cuts = simhash.segments()
    assert sum(w for _, w in cuts) == 64 and len(cuts) == 3
    for _ in range(3000):
        apart = [0, 0, 0]
        for b in draw.sample(range(64), 4):
            apart[next(s for s, (low, w) in enumerate(cuts) if low <= b < low + w)] += 1
        assert min(apart) <= 1


def test_odd_rows(docs_of):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (None, "one"), (7, "a b c d e f g"), (7, "a b c d e f g"),
        (7, "u v w x y z"), (8, "U v\nw x y z"), (9, "word " * 200_000), (10, "é漢字 🎉 Ünï Éa É"), (None, "a word alone here too"),
    ]
    docs = docs_of(rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")
    got = simhash.components(docs).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == {(i, f"{by_bits(t):016x}") for i, t in rows}
    by_id = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by_id == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 9, 10: 10}
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [4, None]


def test_a_third_in_one_group_of_near_copies(docs_of):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(250):
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(word() for _ in range(50))) for i in range(300)]
    roots = least_of([by_bits(t) for _, t in rows])
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(docs_of(rows)).collect()}
    assert got == {i: rows[r][0] for (i, _), r in zip(rows, roots)}


def test_empty_table(docs_of):
    assert simhash.components(docs_of([])).collect() == []
