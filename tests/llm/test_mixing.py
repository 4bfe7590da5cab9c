"""Targets against step-by-step sharing, and the mix's sums, caps and odd rows."""

import heapq
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from postsignal.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes, most=3):
    """Targets by giving out the excess again until no source is above its bound."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full = float(sum(sizes.values())), set()
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest)
        above = [s for s in rest if level * weight[s] > most * sizes[s] + 1e-9]
        if not above:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        for s in above:
            full.add(s)
            left -= most * sizes[s]


def check(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    wanted = shared(sizes)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - wanted[r["source"]]) <= 1e-6 * max(1, wanted[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= 1 + len(wanted), (s, taken[s], target)
    assert sum(taken.values()) <= sum(sizes.values())


def test_whole_table(documents, texts):
    rows = mixing.mix(documents).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    check(rows)


def queue(rows, targets, buckets, packets, most=3):
    """Words taken of each document, packet by packet from a heap of the sources' next finish times."""
    per = defaultdict(list)
    for doc_id, source, size, draw in rows:
        per[source].append(((draw % (1 << 64) >> 20) % buckets, draw % (1 << 20), draw, doc_id, size))
    sizes = {s: sum(d[4] for d in docs) for s, docs in per.items()}
    name = lambda s: (s is None, s or "")

    def flow(s):
        longest, done = math.ceil(targets[s] / packets), 0
        for _ in range(most):
            for *_, doc_id, size in sorted(per[s]):
                for skip in range(0, size, longest):
                    words = min(longest, size - skip)
                    done += words
                    yield done / targets[s], name(s), doc_id, words

    flows = {name(s): flow(s) for s in per if sizes[s]}
    heap = [next(f) for f in flows.values()]
    heapq.heapify(heap)
    left, taken = sum(sizes.values()), Counter()
    while heap and left:
        _, s, doc_id, words = heapq.heappop(heap)
        taken[doc_id] += min(words, left)
        left -= min(words, left)
        following = next(flows[s], None)
        if following:
            heapq.heappush(heap, following)
    return taken


def test_takes_what_a_step_by_step_queue_sends(spark, docs_of):
    rows = [(i, "w " * ((i * 37) % 90 + (4000 if i == 11 else 0)), [None, "a", "b", "b", "b", "c"][i % 6]) for i in range(240)]
    docs = docs_of(rows)
    drawn = docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    drawn = [tuple(r) for r in drawn.withColumn("draw", F.xxhash64(F.lit(7), "doc_id", "size")).collect()]
    for packets in (1, 20, 10_000):
        got = mixing.mix(docs, packets=packets, rows_a_bucket=10).collect()
        targets = {r["source"]: r["target"] for r in got}
        assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == +queue(drawn, targets, 32, packets)
        assert sum(r["taken"] for r in got) == sum(r[2] for r in drawn)


def test_sources_at_their_bound_and_null_source(docs_of):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(2, "a"), (1, "a"), (400, "b"), (300, "b"), (90, "c"), (7, "d"), (3, None), (1, "Z")])]
    got = mixing.mix(docs_of(rows)).collect()
    check(got)
    small = [r for r in got if r["source"] == "a"]
    assert sum(r["taken"] for r in small) == 9 and small[0]["target"] == 9.0


def test_reruns_agree_and_order_is_a_queue(documents):
    first = sorted(map(tuple, mixing.mix(documents).collect()))
    assert first == sorted(map(tuple, mixing.mix(documents.repartition(7)).collect()))
    begins = sorted(r[6] for r in first if r[6] is not None)
    assert begins[0] == 0 and len(set(begins)) == len(begins)


def test_odd_rows(docs_of):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "one two", "a"), (4, "one two", "a"), (None, "x", "b"), (6, "y " * 40_000, "c")]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    check(got)
    assert mixing.mix(docs_of([])).collect() == []
    nothing = mixing.mix(docs_of([(1, None, "a"), (2, "", None)])).collect()
    assert [(r["taken"], r["target"]) for r in nothing] == [(0, 0.0), (0, 0.0)]


def test_documents_come_as_often_as_taken(docs_of):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(n)), s) for i, (n, s) in enumerate([(20, "a"), (15, "a"), (200, "b"), (150, "b"), (80, "c")])]
    docs = docs_of(rows).withColumnRenamed("lang", "mix_share")
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.groupBy("doc_id").agg(F.sum(mixing.words_in(F.col("text"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == plan
    whole = {i: t for i, t, _ in rows}
    assert all(whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in out.collect())
