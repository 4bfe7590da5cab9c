import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsignal.functions import text
from postsignal.operators import encode, filters, keywords, packets, ranking, split
from postsignal.sources.posts import write_epochs


def contents(spark, texts, name="content"):
    return spark.createDataFrame(list(enumerate(texts)), f"post_id long, {name} string")


def test_title_filter(spark):
    titles = ["[新聞] a", "Re: [新聞] b", "Fw: [新聞] c", "新聞稿 d", "[問卦] e"]
    kept = filters.news_posts(contents(spark, titles, "title"))
    assert sorted(r["title"] for r in kept.collect()) == ["[新聞] a", "新聞稿 d"]


def test_keep_last_with_a_third_of_all_rows_alike(spark):
    texts = ["hot" if i % 3 == 0 else f"t{i % 50}" for i in range(900)] + [None, None, ""]
    kept = filters.keep_last(contents(spark, texts), ["content"])
    last = {t: i for i, t in enumerate(texts)}
    assert {(r["content"], r["post_id"]) for r in kept.collect()} == set(last.items())


def test_keep_last_keeps_column_borders_apart(spark):
    df = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, "ab", "c")], "post_id long, x string, y string")
    assert sorted(r["post_id"] for r in filters.keep_last(df, ["x", "y"]).collect()) == [1, 3]


def test_keep_last_of_whole_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", 0)], "post_id long, x string, n int")
    assert sorted(r["post_id"] for r in filters.keep_last(df).collect()) == [2, 3]


def test_keep_last_with_repeated_keys(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "post_id long, content string")
    assert sorted(map(tuple, filters.keep_last(df).collect()), key=str) == [(1, "b"), (2, "a"), (None, "c")]


def test_text_queries_neither_shuffle_texts_nor_read_votes(spark):
    from conftest import DATA

    from postsignal.plans import catalog

    for name in ("clean_text", "tokens", "segment_text", "term_counts", "news_posts"):
        plan = catalog.CATALOG[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "events.parquet" not in plan, name


def by_hand_tfidf(texts):
    docs = [Counter(t.split()) for t in texts]
    df = Counter(t for d in docs for t in d)
    out = {}
    for i, d in enumerate(docs):
        w = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in d.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): x / norm for t, x in w.items()})
    return out


def test_weights_against_brute_force_with_a_hot_term(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(["hot"] * rng.randint(1, 9) + rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)]
    texts.append("")
    expected = by_hand_tfidf(texts)
    got = keywords.tfidf_weights(contents(spark, texts))
    rows = {(r["post_id"], r["term"]): r["weight"] for r in got.collect()}
    assert rows.keys() == expected.keys()
    assert all(rows[k] == pytest.approx(expected[k]) for k in rows)
    norms = got.groupBy("post_id").agg(F.sum(F.pow("weight", F.lit(2.0))).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0) for r in norms)


def test_weights_join_by_shuffle_give_the_same(spark):
    texts = [f"hot hot w{i % 17} w{i % 5}" for i in range(200)]
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    spark.conf.set(adaptive, "-1")
    try:
        rows = {(r[0], r[1]): r["weight"] for r in keywords.tfidf_weights(contents(spark, texts)).collect()}
    finally:
        spark.conf.set(threshold, before)
        spark.conf.set(adaptive, "64MB")
    expected = by_hand_tfidf(texts)
    assert rows.keys() == expected.keys()
    assert all(rows[k] == pytest.approx(expected[k]) for k in rows)


def test_weights_fitted_on_earlier_posts_drop_new_terms(spark):
    posts = contents(spark, ["aa bb", "aa cc", "bb dd"])
    got = keywords.tfidf_weights(posts, fit_on=posts.filter("post_id < 2"))
    assert {(r["post_id"], r["term"]) for r in got.collect() if r["post_id"] == 2} == {(2, "bb")}


def test_keyword_strings_go_there_and_back(spark):
    posts = contents(spark, ["x y", "bb aa Aa ZZ"])
    lists = keywords.keyword_lists(posts, keywords.keywords(keywords.tfidf_weights(posts)))
    joined = lists.select("post_id", keywords.to_string(F.col("words")).alias("s"))
    back = joined.select("post_id", "s", keywords.from_string(F.col("s")).alias("w")).orderBy("post_id").collect()
    assert [(r["s"], r["w"]) for r in back] == [("", []), ("aa;bb;zz", ["aa", "bb", "zz"])]


def test_vocabulary_and_encoding_against_a_loop(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 15))) for _ in range(80)]
    ids, coded = {}, []
    for t in texts:
        coded.append([ids.setdefault(w, len(ids) + 1) for w in t.split()])
    longest = max(len(t.split(" ")) for t in texts)
    docs = contents(spark, texts, "cleaned")
    vocab = encode.vocabulary(docs)
    assert {r["term"]: r["term_id"] for r in vocab.collect()} == ids
    got = encode.encoded_docs(docs, vocab, encode.max_length(docs)).orderBy("post_id").collect()
    assert [r["word_ids"] for r in got] == [c + [0] * (longest - len(c)) for c in coded]
    free = encode.encoded_docs(docs, vocab).orderBy("post_id").collect()
    assert [r["word_ids"] for r in free] == coded


def test_unknown_terms_become_zero_and_long_texts_are_cut(spark):
    docs = contents(spark, ["a new b a"], "cleaned")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "term string, term_id long")
    assert encode.encoded_docs(docs, vocab, F.lit(3)).first()["word_ids"] == [1, 0, 2]


def test_one_hot_order(spark):
    df = contents(spark, ["Work", "WakeUp", "OutOfWork", None], "tag")
    labels = ["Work", "OutOfWork", "WakeUp"]
    hot = df.orderBy("post_id").select(encode.one_hot(F.col("tag"), labels).alias("h")).collect()
    assert [r["h"] for r in hot] == [[0, 0, 1], [0, 1, 0], [1, 0, 0], [0, 0, 0]]


def test_padding_reaches_the_longest_of_the_batch_only(spark):
    rows = spark.createDataFrame([(0, [1]), (0, [1, 2, 3]), (1, [4]), (1, [])], "batch long, word_ids array<bigint>")
    got = sorted((r["batch"], r["word_ids"]) for r in encode.padded_by(rows, "batch").collect())
    assert got == [(0, [1, 0, 0]), (0, [1, 2, 3]), (1, [0]), (1, [4])]


@pytest.mark.parametrize("n", [0, 1, 4, 7, 101, 1000])
def test_split_sizes_are_exact(spark, n):
    rows = split.split_rows(spark.range(n).withColumnRenamed("id", "post_id"))
    got = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    test = math.ceil(n * 0.2)
    valid = math.ceil((n - test) * 0.25)
    assert (got.get("test", 0), got.get("valid", 0), got.get("train", 0)) == (test, valid, n - test - valid)
    assert sorted(r["rank"] for r in rows.collect()) == list(range(1, n + 1))


def test_splits_repeat_with_the_seed(spark):
    ids = spark.range(300).withColumnRenamed("id", "post_id")
    order = lambda seed: [r[0] for r in split.split_rows(ids, seed).orderBy("rank").select("post_id").collect()]
    assert order(1) == order(1) != order(2)


def test_batches_hold_every_row_once_per_epoch(spark):
    got = split.epoch_batches(spark.range(128).withColumnRenamed("id", "post_id"), size=64, epochs=3).collect()
    per_batch = Counter((r["epoch"], r["batch"]) for r in got)
    assert set(per_batch.values()) == {64} and len(per_batch) == 6
    orders = [tuple(r["post_id"] for r in got if r["epoch"] == e) for e in range(3)]
    assert all(sorted(o) == list(range(128)) for o in orders) and len(set(orders)) == 3


def test_epoch_folders(spark, tmp_path):
    batches = split.epoch_batches(spark.range(100).withColumnRenamed("id", "post_id"), size=8, epochs=2)
    write_epochs(batches, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("epoch=*")) == ["epoch=0", "epoch=1"]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("epoch", "batch", "post_id").exceptAll(batches.select("epoch", "batch", "post_id")).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_ordered_rank_with_a_hot_first_column(spark, hot):
    rng = random.Random(4)
    rows = [(0 if hot and i % 3 == 0 else rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = ranking.ordered_rank(df, ["a", "b"], buckets=16).orderBy("rank").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows)
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert ranking.ordered_rank(df.limit(0), ["a", "b"]).count() == 0


def test_a_packet_asks_for_each_of_its_terms_once(spark):
    """Posts that share their words: the vocabulary meets a row per term of a packet, not per term and post."""
    docs = contents(spark, [f"aa bb cc aa w{i % 7}" for i in range(400)] + [None, ""], "cleaned").coalesce(1)
    held = packets.packed(docs, text.encoder_words(F.col("cleaned")))
    assert held.select(F.explode("terms")).count() == 10
    vocab = encode.vocabulary(docs)
    ids = {r["term"]: r["term_id"] for r in vocab.collect()}
    coded = encode.encoded_docs(docs, vocab)
    asked = coded._jdf.queryExecution().optimizedPlan().toString()
    assert "positions" not in asked  # places of a post's terms are neither shuffled nor sorted
    got = {r["post_id"]: r["word_ids"] for r in coded.collect()}
    assert got[400] == got[401] == []
    assert all(got[i] == [ids[w] for w in f"aa bb cc aa w{i % 7}".split()] for i in range(400))


def test_packets_are_cut_between_posts(spark, monkeypatch):
    monkeypatch.setattr(packets, "PACKET", 5)
    assert packets._cut(np.array([3, 1, 9, 0, 2, 5])) == [(0, 3), (3, 5), (5, 6)]
    assert packets._cut(np.array([], np.int64)) == []
    texts = [" ".join("abcdefgh"[: i % 9]) for i in range(50)]
    docs = contents(spark, texts, "cleaned")
    vocab = spark.createDataFrame([(c, i) for i, c in enumerate("abcdefg", 1)], "term string, term_id long")
    got = {r["post_id"]: r["word_ids"] for r in encode.encoded_docs(docs, vocab).collect()}
    assert got == {i: [" abcdefg".find(c) if c != "h" else 0 for c in t.split()] for i, t in enumerate(texts)}
    assert encode.encoded_docs(docs.limit(0), vocab).count() == 0
    shuffled = docs.orderBy(F.desc("post_id"))
    first = [{tuple(r)[:2] for r in encode.vocabulary(d).collect()} for d in (shuffled, encode.tokenized(shuffled))]
    assert first[0] == first[1] and len(first[0]) == 8


def test_rows_of_one_identifier_are_put_together(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c a"), (2, "c"), (None, "a")], "post_id long, cleaned string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, term_id long")
    got = sorted((r["post_id"] or 0, r["word_ids"]) for r in encode.encoded_docs(docs, vocab).collect())
    assert got == [(0, []), (1, [1, 2, 2, 3, 1]), (1, [1, 2, 2, 3, 1]), (2, [3])]


def test_weights_of_repeated_and_missing_identifiers_are_one_vector(spark):
    rows = [(1, "aa bb"), (1, "bb cc cc"), (2, "aa"), (None, "cc"), (None, "bb")]
    got = keywords.tfidf_weights(spark.createDataFrame(rows, "post_id long, content string")).collect()
    assert len(got) == 7 and {r["term"]: r["df"] for r in got} == {"aa": 2, "bb": 3, "cc": 2}
    for i in (1, 2, None):
        own = [(r["tf"] * (math.log(6 / (1 + r["df"])) + 1), r["weight"]) for r in got if r["post_id"] == i]
        norm = math.sqrt(sum(x * x for x, _ in own))
        assert [w for _, w in own] == pytest.approx([x / norm for x, _ in own])


def test_weights_move_no_rows_of_posts_and_terms(spark):
    """Terms of 300 posts are asked for once a packet, and nothing is sorted by post."""
    posts = contents(spark, [f"hot aa bb w{i % 5}" for i in range(300)]).coalesce(1)
    plan = keywords.tfidf_weights(posts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "cogroup" in plan.lower()
