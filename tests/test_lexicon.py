"""The learnt dictionary and the cutting of runs against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postsignal.operators import lexicon
from postsignal.operators.lexicon import Induction

ALPHABET = "台北市政府今天"


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    words = ["台北", "市政府", "今天", "天", "政", "北市今台"]
    rows = []
    for i in range(150):
        text = "".join(draw.choice(words) for _ in range(draw.randint(1, 12)))
        rows.append((i, f"x{text[:5]}, {text[5:]}é" if i % 3 else text))
    rows += [(1000, None), (1001, ""), (1002, "no such run"), (1003, rows[0][1])]
    return rows, spark.createDataFrame(rows, "post_id long, content string")


def runs_of(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c in ALPHABET:
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def counted(rows, longest):
    found = Counter()
    for _, text in rows:
        for run in runs_of(text):
            for n in range(1, longest + 2):
                found.update(run[i : i + n] for i in range(len(run) - n + 1))
    return found


def learnt(counts, to):
    total = sum(c for g, c in counts.items() if len(g) == 1)
    words = {}
    for g, c in counts.items():
        if not (1 < len(g) <= to.longest and c >= to.least):
            continue
        sides = []
        for beside in ([x for x in counts if len(x) == len(g) + 1 and x[1:] == g], [x for x in counts if len(x) == len(g) + 1 and x[:-1] == g]):
            near = [counts[x] for x in beside]
            near += [c - sum(near)] if c > sum(near) else []
            sides.append(-sum(x / c * math.log(x / c) for x in near))
        bound = min(math.log(c * total / (counts[g[:i]] * counts[g[i:]])) for i in range(1, len(g)))
        if min(sides) >= to.entropy and bound >= to.cohesion:
            words[g] = (c, bound, *sides)
    return words


def test_counts_and_dictionary(corpus):
    rows, texts = corpus
    to = Induction(cohesion=0.3, entropy=0.4)
    counts = lexicon.gram_counts(texts, to)
    expected = counted(rows, to.longest)
    assert {r["gram"]: r["count"] for r in counts.collect()} == dict(expected)
    got = {r["gram"]: tuple(r)[2:] for r in lexicon.dictionary(counts, to).collect()}
    wanted = learnt(expected, to)
    assert len(wanted) > 3 and set(got) == set(wanted)
    assert all(got[g] == pytest.approx(wanted[g]) for g in got)


def best_cut(run, weights):
    """The most probable of all ways to cut; of equals, the one with the longest last word, then so on."""
    ways = [([], 0)]
    for mask in range(1 << (len(run) - 1)):
        words, word = [], run[0]
        for i, c in enumerate(run[1:]):
            if mask >> i & 1:
                words.append(word)
                word = c
            else:
                word += c
        words.append(word)
        if all(w in weights for w in words):
            ways.append((words, sum(weights[w] for w in words)))
    ways = ways[1:]
    top = max(w for _, w in ways)
    return max((words for words, w in ways if w == top), key=lambda words: [len(x) for x in reversed(words)])


def test_cutting_equals_all_ways_to_cut(spark):
    draw = random.Random(7)
    weights = {c: draw.randint(-9, -5) * 1_000_000 for c in ALPHABET}
    for _ in range(40):
        weights["".join(draw.choices(ALPHABET, k=draw.randint(2, 4)))] = draw.randint(-14, -6) * 1_000_000
    runs = sorted({"".join(draw.choices(ALPHABET, k=draw.randint(1, 13))) for _ in range(150)})
    table = spark.createDataFrame([(g, w) for g, w in weights.items()], "gram string, weight long")
    got = lexicon.cut_runs(spark.createDataFrame([(r,) for r in runs], "run string"), table)
    assert {r["run"]: r["words"] for r in got.collect()} == {r: best_cut(r, weights) for r in runs}


def test_a_long_run_is_cut_in_stretches(spark):
    table = spark.createDataFrame([("台", -5), ("北", -5), ("台北", -6), ("天", -4)], "gram string, weight long")
    run = "台北天" * 20_000
    got = lexicon.cut_runs(spark.createDataFrame([(run,)], "run string"), table).first()["words"]
    assert got == ["台北", "天"] * 20_000


def test_texts_keep_everything_else(corpus):
    rows, texts = corpus
    counts = lexicon.gram_counts(texts)
    weights = lexicon.word_weights(counts, lexicon.dictionary(counts))
    got = {r["post_id"]: r["content"] for r in lexicon.segmented(texts, weights).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert (got[i] or "").replace(" ", "") == (text or "").replace(" ", "") and (got[i] is None) == (text is None)
    assert got[1002] == "no such run" and got[0] == got[1003]
    assert lexicon.segmented(texts.filter(F.lit(False)), weights).collect() == []


def test_packets_of_any_size_give_the_same_words(spark, monkeypatch):
    draw = random.Random(11)
    alphabet = ALPHABET + "\U00020000"  # four bytes in UTF-8
    weights = {c: draw.randint(-9, -5) * 1_000_000 for c in alphabet}
    for _ in range(30):
        weights["".join(draw.choices(alphabet, k=draw.randint(2, 4)))] = draw.randint(-14, -6) * 1_000_000
    runs = sorted({"".join(draw.choices(alphabet, k=draw.randint(1, 9))) for _ in range(60)})
    texts = spark.createDataFrame([(r + " " + r,) for r in runs], "content string").coalesce(1)
    table = spark.createDataFrame([(g, w) for g, w in weights.items()], "gram string, weight long")
    expected = Counter()
    for run in runs:
        for n in range(1, 6):
            expected.update(2 * [run[i : i + n] for i in range(len(run) - n + 1)])
    for size in (1, 40, 1_000_000):
        monkeypatch.setattr(lexicon, "PACKET", size)
        assert {r["gram"]: r["count"] for r in lexicon.gram_counts(texts).collect()} == expected
        got = lexicon.cut_runs(spark.createDataFrame([(r,) for r in runs], "run string").coalesce(1), table)
        assert {r["run"]: r["words"] for r in got.collect()} == {r: best_cut(r, weights) for r in runs}


def test_places_of_runs_are_not_spread_into_rows(spark):
    """Only a packet's distinct strings meet the weights: one row each, however often they occur."""
    table = spark.createDataFrame([("台", -5), ("北", -5), ("台北", -6)], "gram string, weight long")
    cut = lexicon.cut_runs(spark.createDataFrame([("台北" * 500,)], "run string"), table)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert cut.first()["words"] == ["台北"] * 500
    empty = spark.createDataFrame([(None,), ("",)], "run string")
    assert lexicon.cut_runs(empty, table).collect() == []
    # A character without a weight: the whole run is cut into characters.
    assert lexicon.cut_runs(spark.createDataFrame([("台北天",)], "run string"), table).first()["words"] == ["台", "北", "天"]
