"""Merkle manifest of a table of documents, kept as a content-addressed graph of digests.

A leaf is the digest of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its
value. Leaves of one language stand by id; every eight in a row, the last run fewer, become the digest
of their digests, until one is left, the language's subroot. Subroots, by language, become the root
likewise. Digests are hexadecimal SHA-256 and are hashed as text.

The manifest's records are ``digest -> children``. A proof is found by descent: a request starts at the
root and takes the digits of its rank from the front; at each record it moves on to the child its digit
names and collects the others as a segment ``(before, after)``. The segments, last one first, are the
proof from leaf to root. Requests with the same digits so far are one request, and the eight leaves of
a run share all of theirs, so the root is asked once and no digest draws all rows to one task.

Positions come from a table sorted by ranges and from the counts of each range, so that no task holds a
language. Only small tables, of one row per range and language, are summed in sequence.

Null fields: ``-``. Null language: a language of its own, the first. Empty text: ``0:``. Very long texts:
hashed whole, and never moved. Null id: before all others. Ties of ids and repeated rows: by leaf; equal
leaves take neighbouring places. A single row: its leaf is the root and its proof is of no siblings.
Empty table: no rows. A missing column counts as null; other columns are left out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGIT = 3  # bits
FAN = 1 << DIGIT
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, leaf, forged)``; ``forged`` is the leaf after tampering, null where there is none."""
    have = {c.lower() for c in docs.columns}
    fields = {c: F.col(c) if c in have else F.lit(None) for c in FIELDS}
    forged = {**fields, "text": F.translate(fields["text"], UPPER, LOWER)}
    tampered = F.crc32(fields["doc_id"].cast("string")) % 3 == 0
    return docs.select(
        fields["doc_id"].cast("long").alias("doc_id"),
        fields["lang"].cast("string").alias("lang"),
        leaf(list(fields.values())).alias("leaf"),
        F.when(tampered, leaf(list(forged.values()))).alias("forged"),
    )


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` from 0 in ``order`` within ``group`` (nulls first), and ``n``, the group's size.

    The table is cut into ranges of group and order and written sorted; a row's number in its file
    less that of its group's first row there, plus the group's rows in earlier files, is its rank.
    """
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    at = F.monotonically_increasing_id()
    placed = written(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", at)
        .withColumns({"file": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    )
    earlier = Window.partitionBy(group).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(group, "file")
        .agg(F.count("*").alias("rows"), F.min("at").alias("first"))
        .withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first"))
        .withColumn("n", F.sum("rows").over(Window.partitionBy(group)))
        .select(F.col(group).alias("of"), F.col("file").alias("in"), "start", "n")
    )
    joined = placed.join(starts, (F.col("file") == F.col("in")) & F.col(group).eqNullSafe(F.col("of")))
    return joined.withColumn("rank", F.col("start") + F.col("at")).drop("of", "in", "start", "file", "at")


@dataclass(frozen=True)
class Manifest:
    """``root`` digest (null for no rows), ``records (digest, children)`` and the ``runs`` of leaves.

    ``runs`` has ``lang, idx, n, digest, members``: up to eight leaves with their ids, and the digest of
    their run (a lone leaf's own). ``langs`` has the place ``idx`` of each of the ``lang_count`` languages.
    """

    root: str | None
    records: DataFrame
    runs: DataFrame
    langs: DataFrame
    lang_count: int


def _hashed(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _levels(nodes: DataFrame, group: str, largest: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(group, digest)`` of the last node of each group, and records of every level.

    ``nodes`` has ``group, idx, n, digest``, with ``n`` nodes of a group on the level, at most ``largest``.
    """
    done, records = [nodes.filter("n = 1")], []
    while largest > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
        up = (
            nodes.filter("n > 1")
            .groupBy(group, F.expr(f"idx div {FAN}").alias("up"), "n")
            .agg(run.alias("children"))
            .select(group, F.col("up").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), _hashed(F.col("children")).alias("digest"), "children")
        )
        nodes = written(up)
        records.append(nodes.select("digest", "children"))
        done.append(nodes.filter("n = 1"))
        largest = -(-largest // FAN)
    last = done[0].select(group, "digest")
    for more in done[1:]:
        last = last.union(more.select(group, "digest"))
    return last, records


def manifest(rows: DataFrame) -> Manifest:
    """The graph over ``rows`` of :func:`leaves`."""
    placed = ranked(written(rows), "lang", ["doc_id", "leaf"])
    member = F.struct("rank", "doc_id", "leaf", "forged")
    members = F.array_sort(F.collect_list(member))
    grouped = placed.groupBy("lang", F.expr(f"rank div {FAN}").alias("idx"), "n").agg(members.alias("members"))
    children = F.transform("members", lambda m: m["leaf"])
    run_digest = F.when(F.col("n") == 1, children[0]).otherwise(_hashed(children))
    runs = written(grouped.withColumn("digest", run_digest))
    # The level above the leaves: one node per run.
    above = runs.select("lang", "idx", F.ceil(F.col("n") / FAN).alias("n"), "digest")
    largest = runs.agg(F.max("n")).first()[0] or 0
    subroots, records = _levels(above, "lang", -(-largest // FAN))
    numbered = ranked(subroots.withColumn("all", F.lit(0)), "all", ["lang"])
    tops = written(numbered.select("all", "lang", F.col("rank").alias("idx"), "n", "digest"))
    count = tops.count()
    last, upper = _levels(tops.drop("lang"), "all", count)
    top = last.first()
    graph = tops.select("digest", F.array().cast("array<string>").alias("children")).filter("false")
    for level in [*records, *upper]:
        graph = graph.union(level)
    return Manifest(top["digest"] if top else None, written(graph.distinct()), runs, tops.select("lang", "idx"), count)


def _depth(n: Column) -> Column:
    """Levels between ``n`` nodes and one."""
    depth = F.lit(0)
    for level in range(20):
        depth = depth + F.when(n > FAN**level, 1).otherwise(0)
    return depth


def _steps(n: int) -> int:
    steps = 0
    while FAN**steps < n:
        steps += 1
    return steps


def _digits(rank: Column, depth: Column) -> Column:
    """``depth`` digits of ``rank`` to the base of ``FAN``, the first one leading."""
    places = F.when(depth > 0, F.sequence(depth - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.call_function("shiftright", rank, i * DIGIT).bitwiseAND(F.lit(FAN - 1)).cast("int"))


def descended(made: Manifest, requests: DataFrame) -> DataFrame:
    """``requests (lang, idx, n)`` of runs with ``segments``, from the root down to the run's digest.

    ``reached`` is the digest that the digits lead to. Requests go down together until their digits
    part; a step is one join with the records of the digests in hand.
    """
    lang_digits = made.langs.select(F.col("lang").alias("of"), _digits(F.col("idx"), F.lit(_steps(made.lang_count))).alias("lang_digits"))
    wanted = written(
        requests.select("lang", "idx", "n")
        .join(lang_digits, F.col("lang").eqNullSafe(F.col("of")))
        .withColumn("digits", F.concat("lang_digits", _digits(F.col("idx"), _depth(F.ceil(F.col("n") / FAN)))))
        .select("lang", "idx", "digits")
    )
    deepest = wanted.agg(F.max(F.size("digits"))).first()[0] or 0
    segment = "array<struct<before:string,after:string>>"
    front = requests.sparkSession.range(1).select(
        F.array().cast("array<int>").alias("path"), F.lit(made.root).cast("string").alias("digest"), F.array().cast(segment).alias("segments")
    )
    arrived = wanted.filter(F.size("digits") == 0).select(F.col("digits").alias("path")).distinct().join(front, "path")
    for step in range(1, deepest + 1):
        asked = wanted.filter(F.size("digits") >= step).select(F.slice("digits", 1, step).alias("path")).distinct()
        children = F.transform("children", lambda c, i: F.struct(i.cast("int").alias("digit"), c.alias("child")))
        down = front.join(made.records, "digest").select("path", "segments", "children", F.inline(children))
        others = F.struct(
            F.array_join(F.slice("children", F.lit(1), F.col("digit")), "").alias("before"),
            F.array_join(F.slice("children", F.col("digit") + 2, F.lit(FAN)), "").alias("after"),
        )
        moved = down.select(
            F.concat("path", F.array("digit")).alias("path"), F.col("child").alias("digest"), F.concat("segments", F.array(others)).alias("segments")
        )
        front = written(moved.join(asked, "path", "left_semi"))
        arrived = arrived.union(front)
    ends = arrived.select(F.col("path").alias("digits"), F.col("digest").alias("reached"), "segments")
    return wanted.join(ends, "digits").select("lang", "idx", "reached", "segments")


def proofs(docs: DataFrame) -> DataFrame:
    """Every row's leaf, roots, proof and check, after tampering with a third of the texts."""
    made = manifest(leaves(docs))
    paths = descended(made, made.runs).withColumnsRenamed({"lang": "of", "idx": "at"})
    same = (F.col("idx") == F.col("at")) & F.col("lang").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("reached"))
    held = made.runs.join(paths, same).select("n", "members", F.reverse("segments").alias("segments"), "digest", F.posexplode("members").alias("place", "own"))
    others = lambda begin, length: F.array_join(F.transform(F.slice("members", begin, length), lambda m: m["leaf"]), "")
    lowest = F.struct(others(F.lit(1), F.col("place")).alias("before"), others(F.col("place") + 2, F.lit(FAN)).alias("after"))
    upward = held.withColumn("upward", F.when(F.col("n") > 1, F.concat(F.array(lowest), "segments")).otherwise(F.col("segments")))
    step = lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256)
    given = F.coalesce(F.col("own.forged"), F.col("own.leaf"))
    below = F.slice("upward", F.lit(1), F.size("upward") - _steps(made.lang_count))
    joined = F.array_join(F.transform("upward", lambda s: F.concat(s["before"], s["after"])), "")
    folded = upward.withColumns(
        {
            "subroot": F.aggregate(below, F.col("own.leaf"), step),
            "proof_sha256": F.sha2(joined, 256),
            "folded_root": F.aggregate("upward", given, step),
        }
    )
    return folded.select(
        F.col("own.doc_id").alias("doc_id"), F.col("own.leaf").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"),
        "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(made.root)).alias("verified"),
    )


#: The same in DuckDB SQL. A checksum is made bit by bit, the tree and the folding level by level.
PROOFS_SQL = r"""
    with recursive
    d as (
      select doc_id, lang, text, source, n_chars,
             list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: unicode(c)::ubigint)),
               lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
                 lambda y, z: xor(y >> 1, (y & 1) * 3988292384::ubigint))) as c
      from documents),
    f as (
      select doc_id, lang,
             coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id::varchar, '-')
               || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
               || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars::varchar, '-') as head,
             coalesce(octet_length(encode(text)) || ':' || text, '-') as own,
             case when xor(c, 4294967295::ubigint) % 3 = 0 then coalesce(octet_length(encode(text)) || ':' ||
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') end as forged
      from d),
    leaves as (
      select doc_id, lang, sha256(head || own) as leaf, sha256(head || coalesce(forged, own)) as given,
             row_number() over (partition by lang order by doc_id) - 1 as r, count(*) over (partition by lang) as n
      from f),
    sub as (
      select lang, 0 as lvl, r as i, n, leaf as h from leaves
      union all
      select lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from sub where n > 1 group by lang, lvl, i // 8, n),
    subroots as (
      select lang, h, lvl as depth, row_number() over (order by lang is not null, encode(lang)) - 1 as r, count(*) over () as n from sub where n = 1),
    top as (
      select 0 as lvl, r as i, n, h from subroots
      union all
      select lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from top where n > 1 group by lvl, i // 8, n),
    steps as (
      select l.doc_id, s.lvl, coalesce(string_agg(s.h, '' order by s.i) filter (where s.i < l.r // (8 ** s.lvl)::bigint), '') as before,
             coalesce(string_agg(s.h, '' order by s.i) filter (where s.i > l.r // (8 ** s.lvl)::bigint), '') as after
      from leaves l join sub s on s.lang is not distinct from l.lang and s.n > 1 and s.i // 8 = l.r // (8 ** (s.lvl + 1))::bigint
      group by l.doc_id, s.lvl
      union all
      select l.doc_id, u.depth + t.lvl, coalesce(string_agg(t.h, '' order by t.i) filter (where t.i < u.r // (8 ** t.lvl)::bigint), ''),
             coalesce(string_agg(t.h, '' order by t.i) filter (where t.i > u.r // (8 ** t.lvl)::bigint), '')
      from leaves l join subroots u on u.lang is not distinct from l.lang join top t on t.n > 1 and t.i // 8 = u.r // (8 ** (t.lvl + 1))::bigint
      group by l.doc_id, u.depth, t.lvl),
    folded as (
      select doc_id, 0 as lvl, given as h from leaves
      union all
      select f.doc_id, f.lvl + 1, sha256(before || f.h || after) from folded f join steps s on s.doc_id = f.doc_id and s.lvl = f.lvl),
    ends as (select doc_id, arg_max(h, lvl) as folded_root from folded group by doc_id),
    proof as (select doc_id, sha256(string_agg(before || after, '' order by lvl)) as p from steps group by doc_id),
    root as (select h from top where n = 1)
    select l.doc_id, l.leaf, u.h as subroot, root.h as root, coalesce(proof.p, sha256('')) as proof_sha256, e.folded_root,
           e.folded_root = root.h as verified
    from leaves l join subroots u on u.lang is not distinct from l.lang join ends e on e.doc_id = l.doc_id
    left join proof on proof.doc_id = l.doc_id cross join root"""
