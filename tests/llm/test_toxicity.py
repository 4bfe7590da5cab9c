"""Marginals against all taggings, held-out accuracy, and odd rows."""

import itertools

import numpy as np
import pytest

from postsignal.llm import toxicity

DATA = "/root/testdata/sf0.01"


def test_marginals_equal_the_sum_over_all_taggings():
    draw = np.random.default_rng(1)
    chain = toxicity.Chain({}, 0.0, (-1.2, 0.4, 1.5))
    texts = [draw.normal(size=n) for n in (0, 1, 5, 3, 7)]
    for emission, got in zip(texts, chain.marginals(texts)):
        n = len(emission)
        weight, ones = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            w = sum(e for e, t in zip(emission, tags) if t)
            w += sum({(0, 0): 0, (0, 1): -1.2, (1, 0): 0.4, (1, 1): 1.5}[p] for p in zip(tags, tags[1:]))
            weight += np.exp(w)
            ones += np.exp(w) * np.array(tags)
        assert np.allclose(got, ones / weight if n else [])


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    return toxicity.score(docs, labels).join(labels, "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id").collect()


def test_held_out_documents_are_told_apart(scored):
    held = [r for r in scored if r["held_out"] and r["toxic"] is not None]
    toxic = [r["predicted"] for r in held if r["toxic"]]
    clean = [r["predicted"] for r in held if not r["toxic"]]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)


def test_spans_hold_the_toxic_words(scored):
    words = {"idiot", "stupid", "moron", "scum", "loser", "clown", "trash", "pathetic", "worthless", "disgusting"}
    named = [r for r in scored if words & set(r["text"].lower().split())]
    assert named
    for r in named:
        inside = " ".join(r["text"][s["start"] : s["end"]] for s in r["spans"]).lower()
        assert any(w in inside for w in words)


def test_labels_of_held_out_documents_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    changed = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    one, other = toxicity.learn(docs, labels), toxicity.learn(docs, changed)
    assert one[0].weights == other[0].weights and one[1] == other[1]


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "İ idiot"), (5, "word " * 40_000)]).withColumnRenamed("lang", "spans")
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()  # no clean label: nothing can be learnt
    assert len(got) == 6 and {r["predicted"] for r in got} == {0}
    assert toxicity.score(docs_of([]), labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.clean_documents(docs, none)
    assert kept.columns == docs.columns and kept.count() == 6


def test_a_short_passage_in_a_long_text_is_learnt(spark, docs_of):
    draw = np.random.default_rng(5)
    bad = ["qip", "zam", "vok", "jub", "xet", "yrd"]
    rows = []
    for i in range(360):
        words = [f"w{n}" for n in draw.integers(0, 200, 1_000)]
        if i % 2:
            at = int(draw.integers(0, 990))
            words[at : at + 3] = [bad[i // 2 % 6]] * 3
        rows.append((i, " ".join(words)))
    docs, labels = docs_of(rows), spark.createDataFrame([(i, i % 2) for i in range(360)], "doc_id long, toxic int")
    chain, _ = toxicity.learn(docs, labels, window=64)
    assert set(chain.weights) >= {"=" + w for w in bad}
    assert min(chain.emission(w) for w in bad) > 0 > chain.emission("w1")
    held = [r for r in toxicity.score(docs, labels, window=64).collect() if r["held_out"]]
    assert all(r["predicted"] == r["doc_id"] % 2 for r in held) and len(held) > 60
