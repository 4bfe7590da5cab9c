"""Vector codes from codebooks fitted over metric trees of the vectors' parts.

Vectors are cut into equal parts, and each part position has a codebook. Each batch of rows builds
one tree of balls per part, middle out: anchors are picked far apart and take the points nearest to
them, every crowded anchor is divided in the same way, and anchors are then joined in pairs, smallest
ball first, up to a root. A ball keeps the number and the sum of its points.

A fitting round walks down each tree. A ball inherits the entries that may still be nearest to some
point of its parent's and strikes those that its nearest entry beats everywhere in the ball; when one
is left, the ball's sum and number go to it without a look at its points. Only points of leaves that
keep several entries are compared one by one, and only with those. All numbers are whole, so sums
and assignments are exact, whatever the batches.

Trees are written once and read in every round. The driver holds the codebooks alone.

Null vector, or one with a null or non-finite component: left out. Vectors of other lengths, the empty
one included: filled with zeros up to the longest length, rounded up to whole parts. Components too
large for exact 64-bit sums of squares: held at that bound (2^30 over the root of the length). Null id:
kept, after all others when the first entries are picked. Ties of ids: by vector. Repeated rows: all
kept. Ties of distance: the lower entry. Fewer rows than entries: smaller codebooks. Equal points make
one ball. Empty table: no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


@dataclass(frozen=True)
class Coding:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    leaf: int = 160  # points of a ball that is not divided


# Trees of one batch and part


@dataclass
class Tree:
    """Balls in arrays; a parent stands before its children. Points of a ball are a run of ``order``."""

    order: np.ndarray  # row of each point, in the tree's order
    points: np.ndarray  # in that order
    first: np.ndarray
    end: np.ndarray
    left: np.ndarray  # -1 for a leaf
    right: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray  # sum of the ball's points


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def _anchors(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` divided among about the root of their number of anchors, each the nearest to its rows.

    The next anchor is the farthest point of the widest one so far. It takes rows from the others:
    only those farther from their anchor than half the way between the two can be nearer to it.
    """
    own = points[rows]
    pivots = [0]
    owner = np.zeros(len(rows), np.int64)
    squared = _square(own, own[0])
    for k in range(1, math.isqrt(len(rows) - 1) + 1):
        far = int(squared.argmax())
        if squared[far] == 0:
            break
        between = _square(own[pivots], own[far])
        maybe = np.flatnonzero(4 * squared.astype(np.float64) > between[owner] * (1 - 1e-9))
        new = _square(own[maybe], own[far])
        nearer = new < squared[maybe]
        taken = maybe[nearer]
        owner[taken], squared[taken] = k, new[nearer]
        pivots.append(far)
    by_owner = np.argsort(owner, kind="stable")
    return [rows[g] for g in np.split(by_owner, np.flatnonzero(np.diff(owner[by_owner])) + 1)]


class _Ball:
    __slots__ = ("rows", "kids", "centre", "radius")

    def __init__(self, rows, kids, centre, radius):
        self.rows, self.kids, self.centre, self.radius = rows, kids, centre, radius


def _leaf(points: np.ndarray, rows: np.ndarray) -> _Ball:
    own = points[rows]
    centre = np.floor(own.mean(axis=0)).astype(np.int64) if len(rows) > 1 else own[0]
    return _Ball(rows, None, centre, math.sqrt(float(_square(own, centre).max())) * (1 + 1e-12))


def _joined(balls: list[_Ball]) -> _Ball:
    """One tree over ``balls``: the two that fit into the smallest ball become one, until one is left."""
    live = dict(enumerate(balls))
    centre = np.array([b.centre for b in balls], np.float64)
    reach = np.array([b.radius for b in balls])
    size = np.array([len(b.rows) for b in balls], np.float64)
    wide = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(-1), 0)) + reach[:, None] + reach[None]
    queue = [(wide[i, j], i, j) for i in live for j in live if i < j]
    heapq.heapify(queue)
    while len(live) > 1:
        _, i, j = heapq.heappop(queue)
        if i not in live or j not in live:
            continue
        a, b = live.pop(i), live.pop(j)
        middle = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        at = np.floor(middle).astype(np.int64)
        radius = max(math.dist(at, a.centre) + a.radius, math.dist(at, b.centre) + b.radius) * (1 + 1e-12)
        new = len(centre)
        keys = list(live)
        centre = np.vstack([centre, middle])
        reach = np.append(reach, radius)
        size = np.append(size, size[i] + size[j])
        live[new] = _Ball(np.concatenate([a.rows, b.rows]), (a, b), at, radius)
        if keys:
            gaps = np.sqrt(((centre[keys] - middle) ** 2).sum(-1)) + reach[keys] + radius
            for key, gap in zip(keys, gaps.tolist()):
                heapq.heappush(queue, (gap, key, new))
    return next(iter(live.values()))


def _grown(points: np.ndarray, rows: np.ndarray, leaf: int) -> _Ball:
    if len(rows) <= leaf:
        return _leaf(points, rows)
    groups = _anchors(points, rows)
    if len(groups) == 1:  # equal points
        return _leaf(points, rows)
    return _joined([_grown(points, g, leaf) for g in groups])


def tree(points: np.ndarray, leaf: int) -> Tree:
    """The tree over all rows of ``points``, of which there is at least one."""
    root = _grown(points, np.arange(len(points)), leaf)
    balls, first, end, left, right, order = [], [], [], [], [], []
    stack = [(root, None)]
    at = 0
    while stack:
        ball, slot = stack.pop()
        k = len(balls)
        if slot is not None:
            slot[0][slot[1]] = k
        balls.append(ball)
        left.append(-1)
        right.append(-1)
        first.append(at)
        end.append(at + len(ball.rows))
        if ball.kids is None:
            order.append(ball.rows)
            at += len(ball.rows)
        else:
            stack.append((ball.kids[1], (right, k)))
            stack.append((ball.kids[0], (left, k)))
    order = np.concatenate(order)
    placed = points[order]
    sums = np.vstack([np.zeros((1, points.shape[1]), np.int64), np.cumsum(placed, axis=0)])
    first, end = np.array(first), np.array(end)
    return Tree(
        order, placed, first, end, np.array(left), np.array(right), np.array([b.centre for b in balls]),
        np.array([b.radius for b in balls]), sums[end] - sums[first],
    )


def owned(grown: Tree, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """The walk: ``(balls, entry of each, None)`` owned whole, then ``(places, None, entry of each)``.

    The second holds the points of the leaves that several entries share.
    """
    k = len(book)
    apart = np.sqrt(_square(book[:, None], book[None]).astype(np.float64))
    repeated = [any(apart[j, i] == 0 for j in range(i)) for i in range(k)]
    balls = np.zeros(1, np.int64)
    open_ = ~np.array([repeated])
    mixed, kept = [], []
    far = np.iinfo(np.int64).max
    while len(balls):
        distance = np.where(open_, _square(grown.pivot[balls][:, None], book[None]), far)
        nearest = distance.argmin(axis=1)
        least = distance[np.arange(len(balls)), nearest]
        radius = grown.radius[balls]
        beaten = (distance - least[:, None]).astype(np.float64) > 2 * radius[:, None] * apart[nearest] * (1 + 1e-9) + 1e-6
        open_ = open_ & ~beaten
        # A ball without radius holds one point, so its nearest entry, the lower one of a tie, has it.
        single = (open_.sum(axis=1) == 1) | (radius == 0)
        yield balls[single], nearest[single], None
        balls, open_ = balls[~single], open_[~single]
        leaf = grown.left[balls] < 0
        mixed.append(balls[leaf])
        kept.append(open_[leaf])
        balls, open_ = balls[~leaf], open_[~leaf]
        balls, open_ = np.concatenate([grown.left[balls], grown.right[balls]]), np.concatenate([open_, open_])
    leaves, open_ = np.concatenate(mixed), np.concatenate(kept)
    size = grown.end[leaves] - grown.first[leaves]
    places = np.repeat(grown.first[leaves] - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum())
    open_ = np.repeat(open_, size, axis=0)
    best, entry = np.full(len(places), far), np.zeros(len(places), np.int64)
    points = grown.points[places]
    for c in range(k):
        some = np.flatnonzero(open_[:, c])
        new = _square(points[some], book[c])
        nearer = new < best[some]
        best[some[nearer]], entry[some[nearer]] = new[nearer], c
    yield places, None, entry


def sums(grown: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(number, sum)`` of the points of each entry."""
    number, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    for at, whole, single in owned(grown, book):
        if single is None:
            np.add.at(number, whole, grown.end[at] - grown.first[at])
            np.add.at(total, whole, grown.total[at])
        else:
            np.add.at(number, single, 1)
            np.add.at(total, single, grown.points[at])
    return number, total


def assigned(grown: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` of each row."""
    entry = np.zeros(len(grown.order), np.int64)
    for at, whole, single in owned(grown, book):
        if single is None:
            for ball, e in zip(at.tolist(), whole.tolist()):
                entry[grown.first[ball] : grown.end[ball]] = e
        else:
            entry[at] = single
    out, squared = np.empty_like(entry), np.empty_like(entry)
    out[grown.order] = entry
    squared[grown.order] = _square(grown.points, book[entry])
    return out, squared


# The job


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of ``width`` whole components, filled up with zeros."""
    bound = math.isqrt((1 << 60) // max(1, width))
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    whole = np.clip(np.floor(flat * scale), -bound, bound).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


def _packed(grown: list[Tree]) -> bytes:
    return pickle.dumps([tuple(vars(one).values()) for one in grown], protocol=5)


def _unpacked(data: pa.Scalar) -> list[Tree]:
    return [Tree(*arrays) for arrays in pickle.loads(data.as_py())]


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite


def _trees(rows: DataFrame, kind: str, width: int, to: Coding) -> DataFrame:
    """``(ids, labels, trees)``: a row per batch of at most 4 MB of components."""
    most = max(64, (4 << 20) // (8 * max(1, width)))
    part = width // to.parts

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, most):
                batch = whole.slice(begin, most)
                x = whole_numbers(batch.column(2), width, to.scale)
                grown = [tree(x[:, p * part : (p + 1) * part], to.leaf) for p in range(to.parts)]
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                data = pa.array([_packed(grown)], pa.binary())
                yield pa.RecordBatch.from_arrays([one(batch.column(0)), one(batch.column(1)), data], ["ids", "labels", "trees"])

    return rows.mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, trees binary")


def _refitted(grown: DataFrame, books: list[np.ndarray], to: Coding) -> list[np.ndarray]:
    """One round: totals of every task, added up by cell; an unused entry stays."""
    k, part = books[0].shape

    def run(batches):
        number, total = np.zeros((to.parts, k), np.int64), np.zeros((to.parts, k, part), np.int64)
        for batch in batches:
            for data in batch.column(0):
                for p, one in enumerate(_unpacked(data)):
                    n, s = sums(one, books[p])
                    number[p] += n
                    total[p] += s
        cells = np.concatenate([number.ravel(), total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    added = grown.select("trees").mapInArrow(run, "cell bigint, value bigint").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = np.zeros(to.parts * k * (1 + part), np.int64)
    for r in added.collect():  # one row per number in the codebooks
        cells[r["cell"]] = r["value"]
    number = cells[: to.parts * k].reshape(to.parts, k)
    total = cells[to.parts * k :].reshape(to.parts, k, part)
    return [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], b) for b, n, s in zip(books, number, total)]


def _first_entries(rows: DataFrame, width: int, to: Coding) -> list[np.ndarray]:
    least = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(to.entries).select("vector").collect()
    x = whole_numbers(pa.array([r["vector"] for r in least], pa.list_(pa.float64())), width, to.scale)
    return [p.copy() for p in np.split(x, to.parts, axis=1)]


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def codes(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", to: Coding = Coding()
) -> DataFrame:
    """``(vec_id, code, error, label, label_error, codebooks_sha256)`` of every usable vector.

    ``error`` is the squared distance to the coded vector, ``label_error`` its sum over equal labels.
    """
    rows = vectors.filter(usable(vector)).select(
        F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    kind = rows.schema["label"].dataType.simpleString()
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        columns = f"vec_id bigint, code string, error bigint, label {kind}, label_error bigint, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], columns)
    width = -(-longest // to.parts) * to.parts
    books = _first_entries(rows, width, to)
    grown = written(_trees(rows, kind, width, to))
    for _ in range(to.rounds):
        books = _refitted(grown, books, to)

    def run(batches):
        pair = np.array([f"{e:02x}" for e in range(256)])
        for batch in batches:
            for i in range(batch.num_rows):
                held = [assigned(one, books[p]) for p, one in enumerate(_unpacked(batch.column(2)[i]))]
                code = ["".join(c) for c in zip(*[pair[entry].tolist() for entry, _ in held])]
                error = np.sum([squared for _, squared in held], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, pa.array(code), pa.array(error), batch.column(1)[i].values],
                    ["vec_id", "code", "error", "label"],
                )

    coded = written(grown.mapInArrow(run, f"vec_id bigint, code string, error bigint, label {kind}"))
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def codes_sql(to: Coding = Coding(), table: str = "embeddings") -> str:
    """The same in DuckDB SQL, for vectors of one length: every part against every entry."""
    rounds = [
        f"""
        a{r} as (
          select v.vec_id, v.p, v.x, b.e,
                 list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
          from cut v join b{r} b on v.p = b.p
          qualify row_number() over (partition by v.vec_id, v.p order by d, b.e) = 1),
        s{r} as (
          select p, e, i, cast(floor(sum(c)::hugeint / count(*)) as bigint) as c
          from (select p, e, unnest(x) as c, generate_subscripts(x, 1) as i from a{r}) group by all),
        b{r + 1} as (
          select b.p, b.e, coalesce(n.x, b.x) as x
          from b{r} b left join (select p, e, list(c order by i) as x from s{r} group by all) n on b.p = n.p and b.e = n.e)"""
        for r in range(to.rounds + 1)
    ]
    return f"""
        with kept as (
          select vec_id, label, list_transform(embedding, lambda x: cast(floor({to.scale} * x::double) as bigint)) as v from {table}
          where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
        cut as (
          select vec_id, p, v[(p * len(v)) // {to.parts} + 1 : ((p + 1) * len(v)) // {to.parts}] as x
          from kept cross join range({to.parts}) t(p)),
        b0 as (
          select p, e, x from cut join (
            select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit {to.entries}) using (vec_id)),
        {",".join(rounds)},
        coded as (
          select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error
          from a{to.rounds} group by vec_id),
        book as (
          select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from b{to.rounds})
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from coded join kept using (vec_id) cross join book"""
