"""Toxicity by two class-conditional Kneser-Ney models of spelling with shared backoff.

A word is predicted byte by byte from the ``ORDER - 1`` bytes before it; the borders of words count as bytes.
Each class has its own counts of the longest grams. Both back off to one shared Kneser-Ney model: the
pooled counts of the longest grams and, below them, numbers of different continuations in all labelled
texts, so an expression that only one class has, or a new ending of a known stem, has a probability in both.
All grams of the sample take part in these numbers, and the ratios of all of them go to the tasks.

What a class model adds over the other is a log-likelihood ratio per byte; a word's ratio is its sum over
the bytes. Features of a text are its length-normalised ratio (the mean over its words), the greatest
length-normalised ratio of ``SPAN`` words in a row and of one, and the mean scaled by the root of the
words. A logistic regression turns them into a score; it is fitted on labelled texts the models have not seen.

The classifier is fitted on at most ``LABELLED`` labelled texts, those first in the order of a hash of the
id; all other work covers every text.

Defined results: null and empty texts have features 0 and get the score of such a text; without labels
of both classes every score is 0; labels without class are ignored, of several the largest counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.batches import LOWER, Lookup, Words, gather_spans, slices, text_bytes
from lexivec.scratch import Scratch

#: Labelled texts that the classifier is fitted on at most.
LABELLED = 40_000
#: One in so many labelled texts fits the regression and not the models.
FOLDS = 3
#: Bytes of the longest grams.
ORDER = 6
#: Grams whose ratios are found at once; those of more grams, a number that the sample bounds, are found by joins.
GRAMS = 1 << 21
#: Absolute discount of Kneser-Ney smoothing.
DISCOUNT = 0.75
#: Words of the window whose ratio is a feature.
SPAN = 3
#: Features of a text.
FEATURES = 4
#: Score from which a text is predicted to be toxic.
THRESHOLD = 0.3

#: Bytes of a word: letters, digits and every byte beyond ASCII.
MEMBER = np.zeros(256, bool)
MEMBER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_START, _END = 1, 2  # stand before and after a word; bytes that no word has


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest gram that ends at each byte of each word, and the bounds of the words."""
    sizes = ends - starts + 1  # with the end mark
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    body = np.full(bounds[-1], _END, np.uint64)
    inner = np.ones(bounds[-1], bool)
    inner[bounds[1:] - 1] = False
    body[inner], _ = gather_spans(data, starts, ends)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    gram = body.copy()
    for k in range(1, ORDER):
        before = np.full(bounds[-1], _START, np.uint64)
        deep = place >= k
        before[deep] = body[np.flatnonzero(deep) - k]
        gram |= before << np.uint64(8 * k)
    return gram, bounds


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ordinary, toxic) of each slice."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        toxic = batch.column(1).to_numpy()
        for lo, hi in slices(offsets):
            part = offsets[lo : hi + 1]
            words = Words(LOWER[data[part[0] : part[-1]]], part - part[0], MEMBER)
            gram, bounds = _spelled(words.data, words.starts, words.ends)
            label = np.repeat(toxic[lo:hi][words.rows], np.diff(bounds))
            both, n = np.unique(gram * np.uint64(2) + label.astype(np.uint64), return_counts=True)
            label = (both & np.uint64(1)).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array((both >> np.uint64(1)).view(np.int64)), pa.array(np.where(label, 0, n)), pa.array(np.where(label, n, 0))],
                ["gram", "ordinary", "toxic"],
            )


class Ratios(NamedTuple):
    """Log-likelihood ratios, toxic over ordinary: of known grams, and of new grams by their context."""

    grams: np.ndarray
    known: np.ndarray
    contexts: np.ndarray
    new: np.ndarray


def _shared(grams: np.ndarray) -> np.ndarray:
    """Of each different gram the shared probability of its last byte after the ``ORDER - 2`` bytes before.

    Counts are numbers of different bytes before; a context gives its discounts to the next shorter one.
    """
    prob = np.full(len(grams), 1 / 256)
    for order in range(1, ORDER):
        mask = np.uint64((1 << (8 * order)) - 1)
        wider = np.unique(grams & np.uint64((1 << (8 * (order + 1))) - 1))  # one more byte to the left
        short, n = np.unique(wider & mask, return_counts=True)
        context, at, different = np.unique(short >> np.uint64(8), return_inverse=True, return_counts=True)
        total = np.bincount(at, n)
        own = np.searchsorted(short, grams & mask)
        ctx = at[own]
        prob = np.maximum(n[own] - DISCOUNT, 0) / total[ctx] + DISCOUNT * different[ctx] / total[ctx] * prob
    return prob


def ratios(grams: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Ratios:
    """The two models of counted grams, as ratios."""
    order = np.argsort(grams)
    grams, counts = grams[order], (ordinary[order], toxic[order])
    base = _shared(grams)
    context, at = np.unique(grams >> np.uint64(8), return_inverse=True)
    logs, backs = [], []
    for n in (counts[0] + counts[1], *counts):  # the pooled counts first: both classes back off to them
        total = np.bincount(at, n, len(context))
        different = np.bincount(at, n > 0, len(context))
        back = np.where(total > 0, DISCOUNT * different / np.maximum(total, 1), 1.0)
        prob = np.maximum(n - DISCOUNT, 0) / np.maximum(total[at], 1) + back[at] * base
        base = prob if not logs else base
        logs.append(np.log(prob))
        backs.append(np.log(back))
    return Ratios(grams, (logs[2] - logs[1]).astype(np.float32), context, (backs[2] - backs[1]).astype(np.float32))


def shared_ratios(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``ratios`` of (gram, ordinary, toxic, n) as two frames: (gram, known, n) and (context, new, n)."""

    def smoothed(n: Column, total: Column, different: Column, base: Column) -> Column:
        seen = F.greatest(n - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1))
        return seen + F.when(total > 0, DISCOUNT * different / total).otherwise(1.0) * base

    def suffix(order: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1).cast("bigint"))

    context = F.shiftright("gram", 8).alias("context")
    shorts = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # numbers of different bytes before
        short = shorts[order + 1].groupBy(suffix(order).alias("gram")).agg(F.count("*").alias("n"))
        shorts[order] = scratch.write(short, f"short{order}")
    base = None
    for order in range(1, ORDER):
        level = shorts[order].withColumn("context", context).withColumn("less", suffix(order - 1))
        sums = level.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("different"))
        level = level.join(sums, "context")
        level = level.withColumn("base", F.lit(1 / 256)) if base is None else level.join(base, "less")
        prob = smoothed(F.col("n"), F.col("total"), F.col("different"), F.col("base")).alias("base")
        base = scratch.write(level.select(F.col("gram").alias("less"), prob), f"base{order}")
    names = ["n", "ordinary", "toxic"]
    sums = scratch.write(
        counts.groupBy(context).agg(
            *(F.sum(k).alias(f"total_{k}") for k in names), *(F.sum((F.col(k) > 0).cast("int")).alias(f"different_{k}") for k in names)
        ),
        "contexts",
    )
    grams = counts.withColumn("context", context).withColumn("less", suffix(ORDER - 1)).join(sums, "context").join(base, "less")

    def prob(k: str, base: Column) -> Column:
        return smoothed(F.col(k), F.col(f"total_{k}"), F.col(f"different_{k}"), base)

    pooled = prob("n", F.col("base"))
    known = F.log(prob("toxic", pooled)) - F.log(prob("ordinary", pooled))
    back = {k: F.when(F.col(f"total_{k}") > 0, DISCOUNT * F.col(f"different_{k}") / F.col(f"total_{k}")).otherwise(1.0) for k in names}
    new = F.log(back["toxic"]) - F.log(back["ordinary"])
    return grams.select("gram", known.alias("known"), "n"), sums.select("context", new.alias("new"), F.col("total_n").alias("n"))


def _sent(frame: DataFrame, scratch: Scratch, name: str) -> list[np.ndarray]:
    """Two columns, in the order of the first; as many rows as the labelled sample has grams."""
    rows = scratch.write(frame, name).toArrow()
    keys, values = (rows.column(k).to_numpy() for k in range(2))
    order = np.argsort(keys)
    return [keys[order].view(np.uint64), values[order].astype(np.float32)]


def model_ratios(counts: DataFrame, scratch: Scratch) -> Ratios | None:
    """The ratios of counted grams (gram, ordinary, toxic, n); None without grams of both classes."""
    if counts.limit(GRAMS + 1).count() <= GRAMS:
        every = counts.select("gram", "ordinary", "toxic").toArrow()
        grams, ordinary, toxic = (every.column(k).to_numpy() for k in range(3))
        if not (ordinary.any() and toxic.any()):
            return None
        return ratios(grams.view(np.uint64), ordinary.astype(np.float64), toxic.astype(np.float64))
    both = counts.agg(F.max("ordinary"), F.max("toxic")).first()
    if not (both[0] and both[1]):
        return None
    known, new = shared_ratios(counts, scratch)
    return Ratios(*_sent(known.drop("n"), scratch, "known"), *_sent(new.drop("n"), scratch, "new"))


class Scorer:
    """Ratios in lookup tables."""

    def __init__(self, model: Ratios):
        self.model = model
        self.grams, self.contexts = Lookup(model.grams), Lookup(model.contexts)

    def words(self, words: Words) -> np.ndarray:
        """The ratio of each word, found once per different word."""
        if len(words) == 0:
            return np.zeros(0)
        _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        gram, bounds = _spelled(words.data, words.starts[first], words.ends[first])
        place = self.grams.find(gram)
        out = np.where(place >= 0, self.model.known[place] if len(self.model.known) else 0, 0).astype(np.float64)
        new = np.flatnonzero(place < 0)
        context = self.contexts.find(gram[new] >> np.uint64(8))
        out[new] = np.where(context >= 0, self.model.new[context] if len(self.model.new) else 0, 0)
        return np.add.reduceat(out, bounds[:-1])[which]

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: mean ratio, greatest mean of ``SPAN`` words and of one, mean times root of the words."""
        words = Words(LOWER[data], offsets, MEMBER)
        ratio = self.words(words)
        out = np.zeros((len(offsets) - 1, FEATURES))
        full = np.flatnonzero(words.counts)
        if len(full) == 0:
            return out
        n = words.counts[full]
        starts = words.bounds[:-1][full]
        mean = np.add.reduceat(ratio, starts) / n
        sums = ratio.copy()
        for k in range(1, SPAN):  # a window ends with its text
            same = np.zeros(len(ratio), bool)
            same[: len(ratio) - k] = words.rows[k:] == words.rows[: len(ratio) - k] if len(ratio) > k else False
            sums[same] += ratio[np.flatnonzero(same) + k]
        out[full, 0] = mean
        out[full, 1] = np.maximum.reduceat(sums, starts) / SPAN
        out[full, 2] = np.maximum.reduceat(ratio, starts)
        out[full, 3] = mean * np.sqrt(n)
        return out


_scorers: dict[str, Scorer] = {}


def _scorer(name: str, model: Ratios) -> Scorer:
    """The tables of a model, built once per Python worker."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model)
    return _scorers[name]


class Classifier(NamedTuple):
    ratios: Ratios
    weights: np.ndarray  # of the features, the constant last

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights by Newton's method; the constant comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


_FEATURE_NAMES = ["mean", "passage", "word", "scaled", "toxic"]


def _featurer(model):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, model.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                x = scorer.features(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[:, k]) for k in range(FEATURES)), batch.column(1).slice(lo, hi - lo)], _FEATURE_NAMES
                )

    return run


def learn(texts: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Classifier | None:
    """From texts (doc_id, text) and labels (doc_id, toxic); None without both classes."""
    spark = texts.sparkSession
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id")
    chosen = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), place.alias("place"))
    chosen = chosen.orderBy("place", "doc_id").limit(labelled).toArrow()
    if len(chosen) == 0:
        return None
    chosen = spark.createDataFrame(chosen)  # at most LABELLED rows of three numbers
    sample = texts.join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.shiftright("place", 7), F.lit(FOLDS)))
    counts = (
        sample.filter("fold > 0").select("text", "toxic").mapInArrow(_counter, "gram bigint, ordinary bigint, toxic bigint")
        .groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    )
    scratch = Scratch(spark, "toxicity")
    counts = scratch.write(counts.withColumn("n", F.col("ordinary") + F.col("toxic")), "grams")
    model = model_ratios(counts, scratch)
    scratch.drop("")
    if model is None:
        return None
    shared = spark.sparkContext.broadcast(model)
    rows = sample.filter("fold = 0").select("text", "toxic").mapInArrow(_featurer(shared), ", ".join(f"{k} double" for k in _FEATURE_NAMES[:-1]) + ", toxic int").toArrow()
    shared.destroy()
    x = np.column_stack([rows.column(k).to_numpy() for k in range(FEATURES)])
    y = rows.column(FEATURES).to_numpy().astype(np.float64)
    if y.min(initial=1) == y.max(initial=0):
        return None
    return Classifier(model, fit_logistic(x, y))


def _predictor(model):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classifier | None = model.value
        scorer = _scorer(name, m.ratios) if m else None
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                score, mean = np.zeros(hi - lo), np.zeros(hi - lo)
                if scorer:
                    x = scorer.features(data[part[0] : part[-1]], part - part[0])
                    mean, score = x[:, 0], m.score(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score),
                     pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(mean)],
                    ["doc_id", "held_out", "score", "predicted", "log_ratio"],
                )

    return run


def score_texts(
    docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", labelled: int = LABELLED,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, log_ratio) per row; labels of held-out ids are not learned."""
    kind = docs.schema[doc_id].dataType.simpleString()
    held = F.coalesce(held_out, F.lit(False))
    texts = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic"), held.alias("held_out"))
    model = learn(texts.select("doc_id", "text"), known.filter("not held_out").drop("held_out"), labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts.select("doc_id", "held_out", "text").mapInArrow(
        _predictor(shared), f"doc_id {kind}, held_out boolean, score double, predicted int, log_ratio double"
    )


def _sieve(model, place: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose text, at ``place``, is not predicted to be toxic."""
        m: Classifier | None = model.value
        scorer = _scorer(name, m.ratios) if m else None
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            for lo, hi in slices(offsets):
                rows = batch.slice(lo, hi - lo)
                if scorer:
                    part = offsets[lo : hi + 1]
                    x = scorer.features(data[part[0] : part[-1]], part - part[0])
                    rows = rows.filter(pa.array(m.score(x) < THRESHOLD))
                yield rows

    return run


def without_toxic(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = LABELLED
) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, learned from all labels."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = learn(texts, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")), labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_sieve(shared, docs.columns.index(text)), docs.schema)
