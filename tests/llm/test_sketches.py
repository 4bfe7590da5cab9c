"""Fingerprints against plain loops over the same hash, merging, and odd rows."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from postsignal.llm import sketches

SCALE = 4


def plain(text, scale=SCALE):
    bare = text.strip(" \t\n\x0b\x0c\r")
    if not bare:
        return set()
    words = re.split(r"[\x20\x09-\x0D]+", bare)
    out = set()
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        out.add(h)
    below = {h for h in out if h < (1 << 64) // scale}
    return below or {min(out)}


def shown(hashes):
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in hashes)
    return "".join(f"{h & (1 << 64) - 1:016X}" for h in signed)


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = plain(text), plain(edited), plain(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), like(a, b), like(a, c))
    return out


def found(docs):
    rows = sketches.fingerprints(docs, SCALE).collect()
    return {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], pytest.approx(r["near_edited"]), pytest.approx(r["near_next"])) for r in rows}


def test_whole_table(documents, texts):
    assert found(documents) == expected(texts.items())


def test_ranges_of_any_size_give_the_same_neighbours(documents):
    whole = sketches.next_documents(documents, SCALE, 10_000).select("doc_id", "next_text")
    for rows in (1, 7, 60):
        assert sorted(sketches.next_documents(documents, SCALE, rows).select("doc_id", "next_text").collect()) == sorted(whole.collect())


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (-7, " \n"), (40, "a b c"), (10**15, "é漢字 🎉 x y z w v"), (None, "null id text here now"), (9, "w " * 50_000)]
    assert found(docs_of(rows).withColumnRenamed("lang", "sketch")) == expected(rows)
    assert found(docs_of([(5, "a b c d e f g h i")])) == expected([(5, "a b c d e f g h i")])
    assert sketches.fingerprints(docs_of([])).collect() == []
    twice = sketches.fingerprints(docs_of([(1, "b"), (1, "a"), (1, "a")])).collect()
    assert len(twice) == 3


def test_sketches_merge_and_tell_containment(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(500, 900))
    df = spark.createDataFrame([(long, part)], "a string, b string").select(sketches.sketch(F.col("a"), 8).alias("a"), sketches.sketch(F.col("b"), 8).alias("b"))
    got = df.select(sketches.containment(F.col("b"), F.col("a")).alias("in"), sketches.containment(F.col("a"), F.col("b")).alias("out"), F.array_except("b", "a").alias("rest")).first()
    assert got["in"] == 1.0 and 0.05 < got["out"] < 0.15 and got["rest"] == []


def test_parts_merge_to_the_sketch_of_their_sequences(spark):
    parts = [["a b c d e", "f g h i j"], ["x"], ["", "one two three"], ["", ""], []]
    parts += [[" ".join(f"{k}w{i * k % 17}" for i in range(n)) for n in sizes] for k, sizes in enumerate([(5, 6, 7), (300, 5), (5, 5, 5, 5)], 2)]
    for scale in (2, 4, 64):
        df = spark.createDataFrame([(p,) for p in parts], "parts array<string>")
        made = df.select(sketches.merged(F.transform("parts", lambda t: sketches.sketch(t, scale)), scale).alias("m")).collect()
        for row, texts in zip(made, parts):
            every = set().union(*[plain(t, 1) for t in texts])
            below = {h for h in every if h < (1 << 64) // scale}
            wanted = below or ({min(every)} if every else set())
            assert {h & (1 << 64) - 1 for h in row["m"]} == wanted
            assert row["m"] == sorted(row["m"])
