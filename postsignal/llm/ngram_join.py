"""N-gram Jaccard join by prefixes under several global orders.

A text's set is that of its distinct ``words``-word shingles (A-Z lower-cased; with fewer words, the
whole sequence as one). Two texts link when their sets' Jaccard similarity is at least
``percent / 100``. Shingles are 64-bit hashes, and sets are compared by them.

* Texts with the same set are one class and are compared once.
* In a global order of all shingles, linked sets share a shingle among their first few (the prefix).
  The orders here put a fixed hash range of the shingles first, those in few documents ahead of
  others, so only that range has to be counted; they differ in how ties of frequency are ordered.
  Shingles of a single document come first and link nothing, so most documents have no prefix left.
* A candidate pair shares a prefix shingle in the first order, at places that leave room for enough
  common shingles, and has sizes that allow a link; it is kept only if it also shares one in every
  other order. Then the whole sets are intersected.
* Pairs are tried in two rounds. First each document of a prefix shingle is tried against that
  shingle's hubs, which joins groups of copies in one step each. Then pairs whose documents are
  still in different components are tried, so no link between components is lost while a group never
  unfolds into all its pairs. This round has an order of its own, over the whole sets of the documents
  that are left: shingles that only one component has come first and link nothing now, the others
  follow by frequency. Hence a passage that very many documents share leads to no pairs among those
  whose own words already fill the prefix. A pair is made only if a table of parities of the two sets
  allows a link, which leaves out near misses before they become rows.

Null or empty text, or only blanks: empty set, linked with nothing, its own component. Very long
texts: read whole, some megabytes at a time. Ties of frequency: broken by hash. Equal rows: linked. Rows that repeat an id: versions of one document, linked through it. Null id: takes part in no
link. Empty table: no rows. Other columns: left out by :func:`components`, kept by
:func:`one_of_each`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .graph import connected
from .names import unused
from .words import chained, pieces, word_hashes

ORDERS = 2
PARITY = 16  # numbers of 64 cells
SIGN = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    words: int = 3
    percent: int = 90

    @property
    def range(self) -> int:
        """Sixteenths of the hashes that come first: about twice the length of a prefix."""
        return min(16, max(1, round(32 * (100 - self.percent) / 100)))

    def prefix(self, n: Column) -> Column:
        """Length of a prefix of ``n`` shingles: without it, too few are left for a link."""
        return n - F.ceil(n * self.percent / F.lit(100.0) - 1e-9).cast("int") + 1

    def links(self, common: Column, a: Column, b: Column) -> Column:
        return 100 * common >= self.percent * (a + b - common)


def shingle_sets(texts: pa.Array, words: int):
    """``(row, sorted distinct hashes)`` for each text."""
    for first, end, raw, offsets in pieces(texts):
        value, before = word_hashes(raw, offsets)
        if len(value) >= words:
            shingles = chained([value[k : len(value) - words + 1 + k] for k in range(words)])
        for row in range(first, end):
            a, b = int(before[row - first]), int(before[row - first + 1])
            if b - a >= words:
                yield row, np.unique(shingles[a : b - words + 1])
            elif b > a:
                yield row, chained([value[i : i + 1] for i in range(a, b)])
            else:
                yield row, np.zeros(0, np.uint64)


def _leading(hashes: np.ndarray, part: int) -> np.ndarray:
    """Which shingles lie in the range that comes first."""
    return (hashes & np.uint64(15)) < np.uint64(part)


def described(docs: DataFrame, rule: Rule) -> DataFrame:
    """``(doc_id, n, digest, n_leading, shingles)``: what may be in a prefix, as signed 64-bit numbers.

    These are the shingles of the leading range and, where they are too few, the next ones by hash.
    """

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            size, leading, digest, kept = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [None] * rows, [None] * rows
            for row, found in shingle_sets(batch.column(1), rule.words):
                n = len(found)
                size[row] = n
                digest[row] = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if n else None
                first = _leading(found, rule.range)
                own, rest = found[first], found[~first]
                least = n - -(-n * rule.percent // 100) + 1
                leading[row] = len(own)
                kept[row] = np.concatenate([own, rest[: max(0, least - len(own))]]).view(np.int64) if n else own.view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])])
            values = np.concatenate(kept) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(size), pa.array(digest, pa.binary()), pa.array(leading),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64())),
                ],
                ["doc_id", "n", "digest", "n_leading", "shingles"],
            )

    schema = "doc_id long, n long, digest binary, n_leading long, shingles array<bigint>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def whole_sets(docs: DataFrame, rule: Rule, wanted: DataFrame) -> DataFrame:
    """``(doc, n, hashes, parity)`` for the documents of ``wanted (doc)``, without moving any text.

    ``parity`` says of 1,024 cells whether the set has an odd number of hashes there. Cells in which
    two sets differ are at most as many as the shingles that only one of them has.

    A bit table of the wanted ids, of at most 2^24 bits whatever their number, picks the texts in the
    scan; the few others that pass are left out by the joins that follow.
    """
    spark = docs.sparkSession
    bits = 1 << min(24, max(16, (16 * max(1, wanted.count())).bit_length()))
    place = F.pmod(F.xxhash64("doc"), F.lit(bits))
    cells = (
        wanted.select(place.alias("place"))
        .select(F.shiftright("place", 5).alias("cell"), F.expr("shiftleft(1L, cast(place & 31 as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
    )
    table = np.zeros(bits >> 5, np.int64)
    for r in cells.collect():
        table[r["cell"]] = r["bits"]
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        table = shared.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            hit = np.flatnonzero((table[place >> 5] >> (place & 31)) & 1)
            for begin in range(0, len(hit), 500):
                part = batch.take(pa.array(hit[begin : begin + 500]))
                found, parity = [None] * part.num_rows, [None] * part.num_rows
                for row, hashes in shingle_sets(part.column(1), rule.words):
                    found[row] = hashes.view(np.int64)
                    cell = (hashes >> np.uint64(20)).astype(np.int64) & (64 * PARITY - 1)
                    parity[row] = np.packbits(np.bincount(cell, minlength=64 * PARITY).astype(np.uint8) & 1).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int64()))
                cells = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(parity), pa.int64()), PARITY).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends), pa.int64()), lists, cells], ["doc", "n", "hashes", "parity"]
                )

    seen = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return seen.withColumn("place", place).mapInArrow(run, "doc long, n long, hashes array<bigint>, parity array<bigint>")


def prefixes(classes: DataFrame, rule: Rule) -> DataFrame:
    """``(doc, n, entries, others)`` of documents with a prefix that another document may share.

    ``entries`` are the prefix in the first order as ``(shingle, place)``; ``others`` the prefixes in
    the other orders.
    """
    spread = classes.select("doc", F.explode("shingles").alias("shingle"))
    shared = spread.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    back = (
        spread.join(shared, "shingle")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("shingle", "df")).alias("met"))
        .join(classes.select("doc", "n", "n_leading"), "doc")
    )
    first = lambda x: (x["shingle"].bitwiseAND(F.lit(15))) < rule.range
    leading = F.filter("met", first)
    back = back.select(
        "doc", "n", "n_leading", leading.alias("leading"), F.filter("met", lambda x: ~first(x)).alias("tail"),
        rule.prefix(F.col("n")).cast("int").alias("length"),
    ).withColumn("alone", (F.col("n_leading") - F.size("leading")).cast("int"))

    def ordered(key) -> Column:
        return F.transform(F.array_sort(F.transform("leading", lambda x: F.struct(key(x).alias("k"), x["shingle"].alias("s")))), lambda y: y["s"])

    left = F.greatest(F.col("length") - F.col("alone"), F.lit(0))
    # Beyond the leading range, the order is that of the unsigned hashes, in which the rows were cut.
    by_hash = F.array_sort(F.transform("tail", lambda x: x["shingle"].bitwiseXOR(F.lit(SIGN))))
    tail = F.when(F.col("length") > F.col("n_leading"), F.transform(by_hash, lambda s: s.bitwiseXOR(F.lit(SIGN)))).otherwise(
        F.array().cast("array<bigint>")
    )
    keys = [
        lambda x: F.struct(x["df"], F.xxhash64(x["shingle"])),
        lambda x: F.struct(F.floor(F.log2(x["df"])), F.xxhash64(x["shingle"], F.lit(1))),
    ]
    made = [F.concat(F.slice(ordered(k), 1, left), tail) for k in keys[:ORDERS]]
    placed = F.transform(made[0], lambda s, i: F.struct(s.alias("shingle"), (i + F.col("alone")).alias("place")))
    return back.select("doc", "n", "alone", placed.alias("entries"), F.array(*made[1:]).alias("others")).filter(F.size("entries") > 0)


def _room(rule: Rule) -> Column:
    """Whether two documents that share a shingle at these places can have enough in common."""
    need = F.col("n_a") + F.col("n_b")
    most = 1 + F.least(F.col("n_a") - 1 - F.col("place_a"), F.col("n_b") - 1 - F.col("place_b"))
    # The shared shingle is the first common one, or an earlier one leaves more room and is tried itself.
    return (most * (100 + rule.percent) >= rule.percent * need) & (
        100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b")
    )


def _near(rule: Rule) -> Column:
    """Whether the cells in which two sets differ leave enough for a link."""
    differ = F.lit(0)
    for k in range(PARITY):
        differ = differ + F.bit_count(F.get("parity_a", F.lit(k)).bitwiseXOR(F.get("parity_b", F.lit(k))))
    both = F.col("n_a") + F.col("n_b")
    return (100 + rule.percent) * (both - differ) >= 2 * rule.percent * both


def verified(pairs: DataFrame, held: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs (a, b)`` that share a prefix shingle in every order and are similar enough."""
    other = held.select("doc", "others")
    a = other.withColumnsRenamed({"doc": "a", "others": "others_a"})
    b = other.withColumnsRenamed({"doc": "b", "others": "others_b"})
    met = F.lit(True)
    for k in range(ORDERS - 1):
        met = met & F.arrays_overlap(F.get("others_a", F.lit(k)), F.get("others_b", F.lit(k)))
    kept = written(pairs.distinct().join(a, "a").join(b, "b").filter(met).select("a", "b"))
    set_a = sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    set_b = sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    common = F.size(F.array_intersect("h_a", "h_b"))
    both = kept.join(set_a, "a").join(set_b, "b").withColumn("common", common)
    return both.filter(rule.links(F.col("common"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def bridges(open_docs: DataFrame, rule: Rule) -> DataFrame:
    """``(doc, label, n, parity, shingle, place)``: prefixes for links between different labels.

    ``open_docs`` has ``doc, label, n, hashes, parity``. In this round's order, shingles that only
    documents of one label have come first; no two documents of different labels share one.
    """
    spread = open_docs.select("doc", "label", F.explode("hashes").alias("shingle"))
    between = (
        spread.groupBy("shingle")
        .agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y"))
        .filter("x < y")
        .select("shingle", F.struct("df", F.xxhash64("shingle"), "shingle").alias("key"))
    )
    met = (
        spread.select("doc", "shingle")
        .join(between, "shingle")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list("key")).alias("keys"))
        .join(open_docs.select("doc", "label", "n", "parity"), "doc")
        .withColumn("alone", (F.col("n") - F.size("keys")).cast("int"))
    )
    left = rule.prefix(F.col("n")).cast("int") - F.col("alone")
    entries = F.transform(
        F.slice("keys", F.lit(1), F.greatest(left, F.lit(0))),
        lambda key, i: F.struct(key["shingle"].alias("shingle"), (i + F.col("alone")).alias("place")),
    )
    return met.select("doc", "label", "n", "parity", F.inline(entries))


def linked_classes(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``(node, label)`` of the class representatives that link with another."""
    held = written(prefixes(classes, rule))
    sets = written(whole_sets(docs, rule, held.select("doc")))
    entries = held.select("doc", "n", "alone", F.inline("entries"))
    # A document with few shingles of its own is likely what its neighbours were made from.
    ranks = [F.struct("alone", "doc"), F.struct("alone", F.xxhash64("doc", F.lit(1))), F.xxhash64("doc", F.lit(2))]
    hubs = written(
        entries.groupBy("shingle")
        .agg(
            F.count("*").alias("members"),
            *[F.min_by(F.struct("doc", "n", "place"), rank).alias(f"hub_{k}") for k, rank in enumerate(ranks)],
        )
        .filter("members > 1")
    )
    hub = F.explode(F.array_distinct(F.array(*[F.col(f"hub_{k}") for k in range(len(ranks))]))).alias("hub")
    tried = (
        entries.join(hubs, "shingle")
        .select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), hub)
        .select("*", F.col("hub.doc").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.place").alias("place_b"))
        .filter("a <> b")
        .filter(_room(rule))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    links = written(verified(tried, held, sets, rule))
    labels = connected(links)
    named = entries.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    mixed_up = named.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("shingle")
    open_docs = named.join(mixed_up, "shingle").select("doc", "label").distinct()
    open_ = written(bridges(written(open_docs.join(sets, "doc")), rule))

    def side(name: str, label: str) -> DataFrame:
        kept = [F.col(c).alias(f"{c}_{name}") for c in ("n", "place", "parity")]
        return open_.select(F.col("shingle").alias(f"shingle_{name}"), F.col("doc").alias(name), F.col("label").alias(label), *kept)

    apart = (F.col("shingle_a") == F.col("shingle_b")) & (F.col("a") < F.col("b")) & (F.col("x") != F.col("y"))
    rest = side("a", "x").join(side("b", "y"), apart & _room(rule) & _near(rule))
    more = written(verified(rest.select("a", "b"), held, sets, rule))
    if more.isEmpty():
        return labels
    return connected(links.union(more))


def components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the document's own included.
    """
    made = written(described(docs, rule))
    full = made.filter("n > 0")
    classes = written(
        full.filter("doc_id is not null").groupBy("digest", "n").agg(
            F.min("doc_id").alias("doc"), F.any_value("n_leading").alias("n_leading"), F.any_value("shingles").alias("shingles")
        )
    )
    member = full.select("doc_id", "digest", "n").join(classes.select("digest", "n", "doc"), ["digest", "n"])
    labels = linked_classes(docs, classes, rule)
    # An id that stands for several texts links their classes.
    repeated = member.filter("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    several = repeated.join(full.groupBy("doc_id").agg(F.count_distinct("digest").alias("k")).filter("k > 1").select(F.col("doc_id").alias("a")), "a", "left_semi")
    if not several.isEmpty():
        labels = connected(several.union(labels.select("node", "label")))
    label_of = labels.withColumnsRenamed({"node": "doc"})
    named = member.join(label_of, "doc", "left").select("doc_id", "n", F.coalesce("label", "doc").alias("component_id"))
    rest = made.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:
    """``docs`` with only the first document, by id, of each component; all columns are kept."""
    found = components(docs.select("doc_id", "text"), rule)
    gone = unused(docs, "gone")
    later = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(later, F.col("doc_id") == F.col(gone), "left_anti")
