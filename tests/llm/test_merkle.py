"""The manifest against a tree built in plain Python, and what tampering does to it."""

import hashlib
import zlib

from pyspark.sql import functions as F

from postsignal.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = [doc_id, source, lang, n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(leaves):
    """All levels from the leaves up to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, rank):
    """``(before, after)`` per level."""
    out = []
    for level in levels[:-1]:
        begin = rank // 8 * 8
        out.append(("".join(level[begin:rank]), "".join(level[rank + 1 : begin + 8])))
        rank //= 8
    return out


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf_of(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = tree([leaf for _, leaf in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for rank, (r, leaf) in enumerate(groups[g]):
            path = siblings(trees[g], rank) + siblings(top, k)
            own = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                own = leaf_of(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for before, after in path:
                own = h(before, own, after)
            root = top[-1][0]
            out.append((r[0], leaf, trees[g][-1][0], root, h(*[b + a for b, a in path]), own, own == root))
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in merkle.proofs(docs).collect()), key=repr)


def test_trees_of_many_depths_and_languages(spark):
    sizes = {None: 1, "": 3, "a": 8, "b": 9, "c": 64, "d": 65, "e": 130, "Z": 2, "é": 7, "ｚ": 1, "🎉": 17}
    rows = []
    for lang, n in sizes.items():
        rows += [((len(rows) + i) * 37 % 1009, f"Text É {i} ABC", lang, f"s{i % 3}", i) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(docs) == by_hand(rows)


def test_a_third_equal_rows_and_nulls(spark):
    rows = [(7, "Same", "en", None, 4)] * 100 + [(i, None if i % 2 else f"Other {i}", "en", "s", None) for i in range(150)]
    rows += [(None, "X", "en", "s", 1), (None, None, None, None, None), (9, "Ünï " * 50_000, None, "s", 200_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("file", F.lit(2))
    assert found(docs) == by_hand(rows)


def test_single_row_and_empty_table(spark):
    rows = [(2, "One", "en", "s", 3)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == by_hand(rows) and got[0][4] == h("")
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_descent_of_some_requests_reaches_their_runs(spark, documents):
    made = merkle.manifest(merkle.leaves(documents))
    some = made.runs.filter("idx % 3 = 1")
    got = merkle.descended(made, some).join(some.select("lang", "idx", "digest"), ["lang", "idx"])
    assert got.count() == some.count() > 1
    assert got.filter("digest <> reached").isEmpty()
    assert made.records.groupBy("digest").count().filter("count > 1").isEmpty()
