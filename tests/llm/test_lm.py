"""Scores against plain counting, packing of hashes, and odd rows."""

import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsignal.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def check(rows, got):
    assert len(got) == len(rows)
    tokens = [(i, WORD.findall((t or "").translate(LOWER)) + ["</s>"]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    words, pairs, texts = Counter(), Counter(), 0
    for i, w in tokens:
        if not held(i):
            words.update(w)
            pairs.update(zip(["<s>", *w], w))
            texts += 1
    total, known = sum(words.values()), len(words)
    by_id = {r["doc_id"]: r for r in got}
    for i, w in tokens:
        r = by_id[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(i), len(w), total)
        assert r["n_known"] == sum(words[x] > 0 for x in w)
        root = [(words[x] + 0.1) / (total + 0.1 * (known + 1)) for x in w]
        assert r["base_score"] == pytest.approx(sum(map(math.log10, root)), rel=1e-9)
        score = 0.0
        for v, x, p in zip(["<s>", *w], w, root):
            n = words[v] if v != "<s>" else texts
            f = r["failures"][bisect.bisect_right(lm.CLASSES, n)]
            score += math.log10((1 - f) * pairs[v, x] / n + f * p if n else p)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_whole_table_in_many_chunks_and_ranges(documents, texts):
    check(list(texts.items()), lm.score(documents, chunk_bytes=40_000, range_tokens=3_000).collect())


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    got = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.85 * sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.85 * len(held)


def test_steps_of_a_state_sum_to_one():
    words = np.array([7, 3, 0, 0])  # the last stands for all unknown words
    pairs, state, total, known = np.array([2, 1, 1, 0]), 4, 10, 3
    words[2] = 0
    words = np.array([6, 3, 1, 0])
    kind, root, steps = lm.walk(words, pairs, np.full(4, state), total, known)
    assert set(kind) == {1} and sum(10**root) == pytest.approx(1)
    for step in steps:
        assert sum(10**step) == pytest.approx(1)


@pytest.mark.parametrize("values", [[], [5], [0, 1, 2**40, 2**41], [0, 2**56 - 1], sorted(range(0, 10**6, 7))])
def test_packing(values):
    values = np.array(values, np.uint64)
    assert (lm.unpacked(lm.packed(values), len(values)) == values).all()
    counts = np.array([0, 3, 300, 70_000, 2**33][: len(values)], np.int64)
    assert (lm._counts(lm._small(counts)) == counts).all()


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a A b"), (None, "a b"), (6, "x " * 60_000), (7, "é漢 É"), (23, "a c zzz")]
    docs = docs_of(rows).withColumnRenamed("lang", "chunk")
    check(rows, lm.score(docs).collect())
    assert len(lm.score(docs_of([(4, "a b"), (4, "a b")])).collect()) == 2
    assert lm.score(docs_of([])).collect() == []


def test_no_training_text(docs_of):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm.score(docs_of([(only, "a b")])).first()
    assert (got["n_known"], got["train_tokens"], got["n_tokens"]) == (0, 0, 3)
    assert got["base_score"] == pytest.approx(0.0) and got["score"] == pytest.approx(0.0)


def test_chunks_send_no_more_rows_than_they_have_entries(documents):
    dealt = documents.select("doc_id", "text", F.lit(True).alias("train"), F.col("doc_id").cast("int").alias("chunk")).filter("chunk < 12")
    texts = {r["doc_id"]: WORD.findall((r["text"] or "").translate(LOWER)) + ["</s>"] for r in dealt.collect()}
    wanted = {i: (len(set(w)), len(set(zip(["<s>", *w], w)))) for i, w in texts.items()}
    for ranges in (1, 8, 1 << 14, 1 << 30):
        rows = lm.requests(dealt, ranges).collect()
        for i, sizes in wanted.items():
            for kind, n in enumerate(sizes):
                mine = [r for r in rows if r["chunk"] == i and r["kind"] == kind]
                assert sum(r["n"] for r in mine) == n and len(mine) <= min(n, ranges)
