"""The Jaccard join against brute force, groups of copies, and odd rows."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsignal.llm import ngram_join
from postsignal.llm.graph import connected
from postsignal.llm.ngram_join import Rule
from postsignal.llm.words import chained, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (None, "three four five six"), (7, "a b c d e f g"),
    (7, "a b c d e f g"), (8, "a  B c\nd e f\tg"), (9, "word " * 30_000), (10, "é漢字 🎉 Ünï"), (11, "a b c d e f g"),
]


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def by_hand(texts, rule):
    sets = {i: shingles(t, rule.words) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= rule.percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def found(docs, rule):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs, rule).collect()}


@pytest.mark.parametrize("rule", [Rule(), Rule(5, 80)])
def test_equals_brute_force(documents, texts, rule):
    assert found(documents, rule) == by_hand(texts, rule)


def test_group_of_edited_copies_and_common_passages(docs_of):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(50)]
    texts = {}
    for i in range(90):  # edited copies, most within reach of the base and of each other
        copy = list(base)
        for _ in range(draw.randint(0, 5)):
            copy[draw.randrange(len(copy))] = word()
        texts[i] = " ".join(copy)
    for i in range(90, 150):  # different texts around one passage
        texts[i] = " ".join([word() for _ in range(draw.randint(1, 30))] + passage + [word() for _ in range(3)])
    rule = Rule()
    assert found(docs_of(list(texts.items())), rule) == by_hand(texts, rule)


def test_odd_rows(docs_of):
    got = ngram_join.components(docs_of(EDGES)).collect()
    assert len(got) == len(EDGES)
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[4] == (1, 4) and by_id[9] == (1, 9) and by_id[None] == (2, None)
    assert by_id[7] == by_id[8] == by_id[11] == (5, 7)


def test_empty_table(docs_of):
    assert ngram_join.components(docs_of([])).collect() == []


def test_id_with_two_texts_links_them(docs_of):
    a, b = "a b c d e f", "u v w x y z"
    got = found(docs_of([(1, a), (2, a), (2, b), (3, b)]), Rule())
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 1}


def test_one_of_each_keeps_columns_and_first_ids(docs_of):
    docs = docs_of([(3, "a b c d e f g"), (2, "a b c d e f g"), (5, "other words stand in this one")])
    docs = docs.withColumnRenamed("lang", "gone").withColumnRenamed("n_chars", "component_id")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(10, 60)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected(links).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 160)}}


def recipes(draw, tries=500_000):
    """Texts of 22 words with no shingle in the leading range, whose last two are among their three smallest."""
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(22 * 2_000)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    value, _ = word_hashes(raw, np.array([0, len(raw)]))
    picks = np.random.default_rng(11).integers(0, len(words), (tries, 22))
    hashes = chained([value[picks[:, k : 20 + k]] for k in range(3)])
    rank = np.argsort(np.argsort(hashes, axis=1), axis=1)
    fits = ~ngram_join._leading(hashes, Rule().range).any(axis=1) & (rank[:, 18:] < 3).all(axis=1)
    return [[words[i] for i in row] for row in picks[fits]]


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_links_at_the_threshold_without_leading_shingles(spark, docs_of, broadcast):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("klmnopqrst") for _ in range(6))
    texts, bases = {}, recipes(draw)[:120]
    assert len(bases) == 120
    for k, base in enumerate(bases):
        rows = [base[:20], base, base[-4:] + [word() for _ in range(15)], base[:20] + [word(), word()]]
        texts.update({10 * k + i: " ".join(r) for i, r in enumerate(rows)})
    with_conf = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for c in with_conf:
            spark.conf.set(c, broadcast)
        got = found(docs_of(list(texts.items())), Rule())
    finally:
        for c, v in with_conf.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert all(got[10 * k + 1][1] == 10 * k for k in range(120))
    assert got == by_hand(texts, Rule())


@pytest.mark.parametrize("rule", [Rule(), Rule(5, 80)])
def test_short_random_texts(docs_of, rule):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(4))
    texts = {}
    for k in range(70):
        base = [word() for _ in range(draw.randint(10, 60))]
        for i in range(draw.randint(1, 5)):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                at = draw.choice([0, len(copy) - 1, draw.randrange(len(copy))])
                copy[at : at + draw.randint(0, 1)] = [word()] * draw.randint(0, 1)
            texts[10 * k + i] = " ".join(copy)
    assert found(docs_of(list(texts.items())), rule) == by_hand(texts, rule)


def test_passage_shared_by_many_makes_no_pairs_of_their_own(spark, docs_of):
    """Only documents whose own words leave room in the prefix are compared at all."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join(passage + [word() for _ in range(draw.randint(12, 30))])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " " + word()) for i in range(5)]
    rule = Rule()
    docs = docs_of(rows)
    sets = ngram_join.whole_sets(docs, rule, docs.select(F.col("doc_id").alias("doc")))
    assert ngram_join.bridges(sets.withColumn("label", F.col("doc")), rule).select("doc").distinct().count() <= 10
    got = found(docs, rule)
    assert got == by_hand(dict(rows), rule) and all(got[1000 + i][1] == i for i in range(5))
