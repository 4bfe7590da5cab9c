"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Learning, from labelled documents whose ids are not held out:

* a sample of at most about ``sample`` documents per class is drawn;
* words and word beginnings that occur in a much larger share of the sampled toxic documents than of
  the others, counted over whole texts, mark the words of toxic documents that carry them as toxic;
  all other words are clean;
* each sampled document gives one window of ``window`` words, around a place of such a word if it has
  one, whatever its class;
* the chain (word features, bias, transitions between two tags) is fitted to those tags;
* a logistic curve over each sampled document's marginals, with the classes weighed as they occur,
  turns marginals into a score.

Scoring reads every whole text: forward and backward ratios give each word's probability of being
toxic; their sum, their maximum and their density give the score, and runs of likely words the spans.

Null or empty text: no words; its score is that of a text without any toxic word. No toxic or no
clean label: no features, and a constant score. Several labels of one id: toxic if one of them is.
Null label: not used. Null id: not held out. Repeated rows: all scored alike. Empty table: no rows.
Other columns are left out by :func:`score` and kept by :func:`clean_documents`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .names import unused

WORD = re.compile(r"\w+")
SAMPLE, WINDOW, FEATURES, LEAST, SHARE, RATIO = 2000, 512, 4096, 3, 0.02, 4.0
LIMIT = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(word: str) -> list[str]:
    low = word.lower()[:32]
    return ["=" + low, *("^" + low[:n] for n in range(3, 7) if len(low) >= n)]


class Chain:
    """Weights of a two-tag chain; all work on 2-D arrays with one text per row.

    Tag 0 has weight 1 everywhere, so a text is described by the odds its words give to tag 1.
    """

    def __init__(self, weights: dict[str, float], bias: float, moves: tuple[float, float, float]) -> None:
        self.weights, self.bias, self.moves = weights, bias, moves

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of tag 1 for each word of each text; texts of like length go together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(emissions[order[end]]) <= 500_000:
                end += 1
            group, at = order[at:end], end
            longest = len(emissions[group[-1]])
            padded = np.full((longest, len(group)), -np.inf)
            for k, i in enumerate(group):
                padded[: len(emissions[i]), k] = emissions[i]
            odds = np.exp(np.clip(padded, None, 30)).T
            ahead, back = self.ratios(odds, [len(emissions[i]) for i in group])
            both = ahead * back
            probability = both / (1 + both)
            for k, i in enumerate(group):
                out[i] = probability[k, : len(emissions[i])]
        return out

    def ratios(self, odds: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds of tag 1; a text's backward odds start at its own last word."""
        m01, m10, m11 = np.exp(self.moves)
        odds = np.asfortranarray(odds)
        n = odds.shape[1]
        ahead, back = np.zeros_like(odds, order="F"), np.ones_like(odds, order="F")
        ends = np.array(lengths)
        if n:
            ahead[:, 0] = odds[:, 0]
        for t in range(1, n):
            r = ahead[:, t - 1]
            ahead[:, t] = odds[:, t] * (m01 + r * m11) / (1 + r * m10)
        for t in range(n - 1, 0, -1):
            s = back[:, t] * odds[:, t]
            back[:, t - 1] = np.where(t < ends, (m10 + s * m11) / (1 + s * m01), 1.0)
        return ahead, back


def telling_features(texts: DataFrame) -> list[str]:
    """At most ``FEATURES`` features that mark a toxic text, of ``(text, _label)``, each text once.

    Documents per feature and class are counted over whole texts.
    """
    size = {r["_label"]: r["count"] for r in texts.groupBy("_label").count().collect()}
    if not size.get(0) or not size.get(1):
        return []

    def run(batches):
        counts = Counter()

        def flushed():
            keys = list(counts)
            made = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(made, ["feature", "label", "n"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                low = set(WORD.findall(text.as_py() or ""))
                counts.update((f, label.as_py()) for f in {f for w in low for f in features(w)})
                if len(counts) > 100_000:
                    yield flushed()
        yield flushed()

    def of(label: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))

    part = texts.select("text", "_label").mapInArrow(run, "feature string, label int, n long")
    seen = part.groupBy("feature").agg(of(1).alias("toxic"), of(0).alias("clean"))
    ratio = F.col("toxic") / size[1] / ((F.col("clean") + 0.5) / size[0])
    # Words that only copies of a few toxic documents share tell nothing.
    kept = seen.filter((F.col("toxic") >= max(LEAST, SHARE * size[1])) & (ratio >= RATIO))
    best = kept.orderBy((F.col("toxic") * F.least(ratio, F.lit(100.0))).desc(), "feature").limit(FEATURES)
    return [r["feature"] for r in best.select("feature").collect()]


def fit_chain(windows: list[tuple[list[str], int]], telling: list[str], steps: int = 60) -> Chain:
    """The chain of labelled windows, by gradient steps on the likelihood of the tags."""
    windows = [(list(words), label) for words, label in sorted({(tuple(w), label) for w, label in windows})]
    if len({label for _, label in windows}) < 2:
        return Chain({}, -5.0, (0.0, 0.0, 0.0))
    number = {f: i for i, f in enumerate(telling)}
    # Windows go through in blocks of like length, so memory is bounded by one block's arrays.
    windows.sort(key=lambda w: (len(w[0]), w))
    blocks = [_block(windows[i : i + 250], number) for i in range(0, len(windows), 250)]
    count = max(1, sum(len(w) for w, _ in windows))
    theta = np.zeros(len(telling) + 4)  # features, bias, log weights of 0-1, 1-0, 1-1
    theta[-4] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gradient = sum(_gradient(theta, *block) for block in blocks) / count - 1e-7 * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
        theta[-3:] = np.clip(theta[-3:], -6, 6)
    return Chain(dict(zip(telling, theta[:-4].tolist())), float(theta[-4]), tuple(theta[-3:].tolist()))


def _block(windows: list[tuple[list[str], int]], number: dict[str, int]) -> tuple[np.ndarray, ...]:
    """``(lengths, tags, places with a feature, the features there)`` of some windows."""
    lengths = np.array([len(w) for w, _ in windows])
    shape = (len(windows), max(1, int(lengths.max())))
    tag, place, which = np.zeros(shape, bool), [], []
    for row, (words, label) in enumerate(windows):
        for col, word in enumerate(words):
            own = [number[f] for f in features(word) if f in number]
            place += [row * shape[1] + col] * len(own)
            which += own
            tag[row, col] = bool(own) and label == 1
    return lengths, tag, np.array(place, np.int64), np.array(which, np.int64)


def _gradient(theta: np.ndarray, lengths: np.ndarray, tag: np.ndarray, place: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Observed minus expected counts of features, toxic words and the three weighted moves."""
    there = np.arange(tag.shape[1])[None, :] < lengths[:, None]
    emission = np.bincount(place, theta[which], tag.size).reshape(tag.shape) + theta[-4]
    odds = np.where(there, np.exp(np.clip(emission, -30, 30)), 0.0)
    ahead, back = Chain({}, 0.0, tuple(theta[-3:])).ratios(odds, lengths.tolist())
    both = ahead * back
    wrong = np.where(there, tag - both / (1 + both), 0.0)
    m01, m10, m11 = np.exp(theta[-3:])
    a, s = ahead[:, :-1], odds[:, 1:] * back[:, 1:]
    e01, e10, e11 = s * m01, a * m10, a * s * m11
    total = 1 + e01 + e10 + e11
    left, right, pair = tag[:, :-1], tag[:, 1:], there[:, 1:]
    moves = [
        np.where(pair, (~left & right) - e01 / total, 0).sum(),
        np.where(pair, (left & ~right) - e10 / total, 0).sum(),
        np.where(pair, (left & right) - e11 / total, 0).sum(),
    ]
    return np.concatenate([np.bincount(which, wrong.ravel()[place], len(theta) - 4), [wrong.sum()], moves])


def summary(p: np.ndarray) -> tuple[float, float]:
    return (float(p.sum()), float(p.max())) if len(p) else (0.0, 0.0)


def curve(expected: float, strongest: float, words: int) -> list[float]:
    """What the score depends on."""
    top = min(max(strongest, 1e-4), 1 - 1e-4)
    return [1.0, np.log(expected + 0.05), np.log(top / (1 - top)), np.log((expected + 0.05) / (words + 25))]


def fit_curve(rows: list[tuple[float, float, int, int]], weight: dict[int, float]) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    if not rows or len({r[3] for r in rows}) < 2:
        return [-5.0, 0.0, 0.0, 0.0]
    x = np.array([curve(*r[:3]) for r in rows])
    y = np.array([r[3] for r in rows], float)
    w = np.array([weight[r[3]] for r in rows])
    w /= w.mean()
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 0.05 * beta)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


SUMMARY = "n_words long, expected double, strongest double, spans array<struct<start: bigint, end: bigint>>"


def tagged(docs: DataFrame, chain: Chain, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words, expected, strongest, spans`` of its ``text``; nothing is shuffled."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = docs.columns
    added = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in T.StructType.fromDDL(SUMMARY)])
    text_at = names.index("text")

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            emissions = []
            for text in texts:
                words = WORD.findall(text)
                for w in set(words).difference(known):
                    known[w] = chain.emission(w)
                emissions.append(np.array([known[w] for w in words]))
                if len(known) > 400_000:
                    known.clear()
            likely = chain.marginals(emissions)
            spans = [_spans(t, p) if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, likely)]
            both = [summary(p) for p in likely]
            made = [
                pa.array([len(p) for p in likely], pa.int64()),
                pa.array([b[0] for b in both], pa.float64()),
                pa.array([b[1] for b in both], pa.float64()),
                pa.array(spans, span),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *added.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *added]))


def _spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    toxic, before = (p >= 0.5).tolist(), -2
    for i, m in enumerate(WORD.finditer(text)):
        if toxic[i]:
            if i == before + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            before = i
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, window: int = WINDOW) -> tuple[Chain, list[float]]:
    """The chain and the curve; only windows and numbers of sampled documents come to the driver."""
    usable = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_label"))
    )
    size = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("_label") == 1, sample / max(1, size.get(1, 0))).otherwise(sample / max(1, size.get(0, 0)))
    # At most about 2 * sample rows of two numbers, by the two shares.
    drawn = F.broadcast(usable.filter(draw < share).withColumnRenamed("doc_id", "_doc"))
    chosen = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "_label")

    chosen = written(chosen)
    once = chosen.groupBy(F.sha2("text", 256), "_label").agg(F.first("text").alias("text"), F.min("doc_id").alias("doc_id"))
    once = written(once.select("doc_id", "text", "_label"))
    telling = telling_features(once)
    marks = frozenset(telling)

    def cut(batches):
        for batch in batches:
            words = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = WORD.findall(text.as_py() or "")
                begin = (i * 2654435761) % max(1, len(own) - window + 1)
                if len(own) > window and (marked := sorted(w for w in set(own) if not marks.isdisjoint(features(w)))):
                    # Each marked word is as likely as any other, however often it occurs.
                    word = marked[(i * 2654435761 >> 7) % len(marked)]
                    places = [at for at, w in enumerate(own) if w == word]
                    middle = places[(i * 2654435761 >> 13) % len(places)]
                    begin = min(max(0, middle - window // 2), len(own) - window)
                words.append(own[begin : begin + window])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(2)], ["words", "label"])

    rows = once.mapInArrow(cut, "words array<string>, label int").collect()
    chain = fit_chain([(r["words"], r["label"]) for r in rows], telling)
    seen = tagged(chosen, chain).select("expected", "strongest", "n_words", "_label")
    numbers = sorted((r["expected"], r["strongest"], r["n_words"], r["_label"]) for r in seen.collect())
    taken = Counter(r[3] for r in numbers)
    return chain, fit_curve(numbers, {k: size.get(k, 1) / max(1, taken[k]) for k in (0, 1)})


def _score(beta: list[float], prefix: str = "") -> Column:
    expected, strongest, words = (F.col(prefix + c) for c in ("expected", "strongest", "n_words"))
    top = F.least(F.greatest(strongest, F.lit(1e-4)), F.lit(1 - 1e-4))
    spread = F.log((expected + 0.05) / (words + 25))
    x = F.lit(beta[0]) + beta[1] * F.log(expected + 0.05) + beta[2] * F.log(top / (1 - top)) + beta[3] * spread
    return 1 / (1 + F.exp(-x))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_words, spans)`` for each row of ``docs``."""
    chain, beta = learn(docs, labels, **options)
    made = tagged(docs.select(F.col("doc_id").cast("long"), "text"), chain).withColumn("score", _score(beta))
    return made.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"),
        "n_words",
        "spans",
    )


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    chain, beta = learn(docs, labels, **options)
    prefix = unused(docs, "tag_")
    return tagged(docs, chain, prefix).filter(_score(beta, prefix) < LIMIT).select(*[F.col(f"`{c}`") for c in docs.columns])
