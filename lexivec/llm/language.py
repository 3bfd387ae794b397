"""Language identification of mixed texts: expectation-maximisation over the words of a text.

Per language the byte trigrams of all training texts are counted in ``SLOTS`` hashed slots and turned
into log-probabilities; the likelihood of a word in a language is the product over its trigrams, its
borders included. A text is a mixture: each word comes from one language of an unknown set, in
unknown proportions. The set grows from the best single language; the language that expectation-
maximisation over all languages finds most of is added next, and it stays if the log-likelihood of the
text rises by more than ``PENALTY * log(words)``.

Counting covers every training text. The model has ``SLOTS`` numbers per language, at most
``LANGUAGES`` languages, and goes to every task.

Defined results: ``und`` with score 0 for null texts, texts without letters, and when nothing was
learned; ties go to the language first in order; every row gives a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.batches import GRAPHIC, LOWER, Words, gather_spans, mix, slices, text_bytes

#: Hashed slots of trigram counts.
SLOTS = 1 << 15
#: Languages of a model at most; more are refused.
LANGUAGES = 500
#: Added to every count.
PRIOR = 0.1
#: Log-likelihood that another language must bring, times log of the words.
PENALTY = 3.0
#: Rounds of expectation-maximisation.
ROUNDS = 12
#: Steps of least and greatest log-likelihood ratio of one word between two languages.
CLIP = 12.0
#: Answer for texts without a language.
UNKNOWN = "und"


class Grams:
    """Trigram slots of the words of a slice, and the range of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(LOWER[data], offsets, GRAPHIC)
        sizes = self.words.ends - self.words.starts
        # A space before and after each word.
        self.bounds = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=self.bounds[1:])
        body, _ = gather_spans(self.words.data, self.words.starts, self.words.ends)
        before, after = np.empty_like(body), np.empty_like(body)
        before[1:], after[:-1] = body[:-1], body[1:]
        before[self.bounds[:-1]] = 32
        after[self.bounds[1:] - 1] = 32
        code = (before.astype(np.uint64) << np.uint64(16)) | (body.astype(np.uint64) << np.uint64(8)) | after
        self.slots = (_slot_table()[code] if len(code) else np.zeros(0, np.int32))


_slots: list[np.ndarray] = []


def _slot_table() -> np.ndarray:
    """The slot of each of the 2^24 byte trigrams; one table per Python worker."""
    if not _slots:
        table = np.empty(1 << 24, np.uint16)
        for lo in range(0, 1 << 24, 1 << 20):  # in parts, for the memory of the steps between
            table[lo : lo + (1 << 20)] = mix(np.arange(lo + 1, lo + (1 << 20) + 1, dtype=np.uint64)) & np.uint64(SLOTS - 1)
        _slots.append(table)
    return _slots[0]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of a task, slots with a count only."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        langs = batch.column(0).to_pylist()
        for lo, hi in slices(offsets):
            part = offsets[lo : hi + 1]
            grams = Grams(data[part[0] : part[-1]], part - part[0])
            at = grams.bounds[grams.words.bounds]
            names = sorted(set(langs[lo:hi]))
            index = {name: k for k, name in enumerate(names)}
            row = np.repeat(np.array([index[x] for x in langs[lo:hi]]), np.diff(at))
            counts = np.bincount(row * SLOTS + grams.slots, minlength=len(names) * SLOTS).reshape(len(names), SLOTS)
            for name, k in index.items():
                totals[name] = totals.get(name, 0) + counts[k]
    for name, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])],
            ["lang", "slot", "n"],
        )


class Model(NamedTuple):
    languages: list[str]
    logp: np.ndarray  # slots x languages


def learn(texts: DataFrame) -> Model:
    """From (lang, text): counts of every text, summed by language and slot."""
    known = texts.filter("lang is not null and text is not null")
    counts = known.select("lang", "text").mapInArrow(_counter, "lang string, slot int, n bigint")
    sums = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    summed = sums.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("slots")).orderBy("lang")
    rows = summed.limit(LANGUAGES + 1).toArrow()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in the training texts")
    table = np.full((SLOTS, len(rows)), PRIOR)
    for k, slots in enumerate(rows.column("slots")):
        table[slots.values.field("slot").to_numpy(), k] += slots.values.field("n").to_numpy()
    logp = np.log(table) - np.log(table.sum(axis=0))
    return Model(rows.column("lang").to_pylist(), logp.astype(np.float32))


def _totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over the words of each row; every row has a word."""
    return np.add.reduceat(values, bounds[:-1], axis=0)


def mixtures(logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Proportions of the languages of each row, from the log-likelihoods of its words; rows have words."""
    n_rows, n_langs = len(bounds) - 1, logs.shape[1]
    row = np.repeat(np.arange(n_rows), np.diff(bounds))
    logs = np.maximum(logs - logs.max(axis=1, keepdims=True), -CLIP)
    like = np.exp(logs)
    words = np.diff(bounds)

    def fitted(allowed: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions over the allowed languages of some rows, and the log-likelihood."""
        picked = np.isin(row, rows) if len(rows) < n_rows else np.ones(len(row), bool)
        some = like[picked]
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(words[rows], out=at[1:])
        share = allowed / allowed.sum(axis=1, keepdims=True)
        size = words[rows]
        for _ in range(ROUNDS):
            joint = some * np.repeat(share, size, axis=0)
            joint /= joint.sum(axis=1, keepdims=True)
            share = _totals(joint, at) / size[:, None]
        mixed = (some * np.repeat(share, size, axis=0)).sum(axis=1)
        return share, _totals(np.log(np.maximum(mixed, 1e-300)), at)

    every = np.arange(n_rows)
    single = _totals(logs, bounds)
    best = single.argmax(axis=1)
    proportions = np.zeros((n_rows, n_langs))
    proportions[every, best] = 1
    if n_langs == 1 or n_rows == 0:
        return proportions
    score = single[every, best]
    full, top = fitted(np.ones((n_rows, n_langs)), every)
    penalty = PENALTY * np.log(words + 1)
    open_rows = every[top - score > penalty]  # no set is likelier than all languages together
    chosen = proportions > 0
    while len(open_rows):
        wish = np.where(chosen[open_rows], -1, full[open_rows])
        add = wish.argmax(axis=1)
        trial = chosen[open_rows].copy()
        trial[np.arange(len(open_rows)), add] = True
        share, found = fitted(trial.astype(float), open_rows)
        better = found - score[open_rows] > penalty[open_rows]
        rows = open_rows[better]
        chosen[rows], proportions[rows], score[rows] = trial[better], share[better], found[better]
        open_rows = rows[chosen[rows].sum(axis=1) < n_langs]
        open_rows = open_rows[top[open_rows] - score[open_rows] > penalty[open_rows]]
    return proportions


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                best, score = np.full(hi - lo, len(m.languages)), np.zeros(hi - lo)
                shares = np.zeros((hi - lo, max(1, len(m.languages))))
                grams = Grams(data[part[0] : part[-1]], part - part[0])
                full = np.flatnonzero((grams.words.counts > 0) & letters[lo:hi]) if m.languages else np.zeros(0, int)
                if len(full):
                    logs = np.add.reduceat(m.logp[grams.slots], grams.bounds[:-1], axis=0)
                    if len(full) < hi - lo:
                        logs = logs[np.isin(grams.words.rows, full)]
                    bounds = np.zeros(len(full) + 1, np.int64)
                    np.cumsum(grams.words.counts[full], out=bounds[1:])
                    found = mixtures(logs.astype(np.float64), bounds)
                    shares[full] = found
                    best[full], score[full] = found.argmax(axis=1), np.minimum(found.max(axis=1), 1.0)
                row, lang = np.nonzero(shares > 0)
                bounds = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays(
                    [pa.array(names[lang], pa.string()), pa.array(shares[row, lang])], ["lang", "share"]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array(names[best], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(bounds), parts)],
                    ["doc_id", "held_out", "lang_pred", "score", "mixture"],
                )

    return run


def identify(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture) per row; texts held out do not train.

    ``score`` is the proportion of the predicted language, ``mixture`` lists all proportions.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"),
        F.col(lang).alias("lang"),
    )
    model = learn(texts.filter("not held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return texts.select("doc_id", "held_out", "text", letters).mapInArrow(
        _predictor(shared),
        f"doc_id {kind}, held_out boolean, lang_pred string, score double, mixture array<struct<lang:string,share:double>>",
    )
