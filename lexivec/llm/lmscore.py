"""Language-model scores of whole texts by the subword lattice of their words.

The vocabulary of a public tokenizer gives the pieces and, by their scores, first weights. A text is its
lower-cased words, each led by a space, and an end. The probability of a word is the sum over all its
segmentations into pieces, by a forward recursion in log space; every single byte is a piece, so every
text has a probability. The corpus re-estimates the weights: word counts of all training texts are
aggregated, the expected use of every piece over all segmentations is summed over the table of counts,
and its shares are the new weights, ``ROUNDS`` times.

Word counts are kept exactly. The most frequent words, at most ``FREQUENT``, go to every task with their
count and likelihood; each other word of a text is joined with the table of counts.

Defined results: a null text is empty and has only its end; null ids train; without training texts all
counts are 0, the base score is that of its formula (0), and the weights are those of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.batches import GRAPHIC, LOWER, Lookup, Words, binary_column, gather_spans, slices, span_hashes, sums_by_row, text_bytes
from lexivec.llm.lattice import Vocabulary, expected_counts, log_likelihoods
from lexivec.scratch import Scratch

#: A vocabulary with byte pieces, in the file format of sentencepiece.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that every task holds at most.
FREQUENT = 1 << 18
#: Re-estimations of the weights.
ROUNDS = 2
#: Added to the expected count of every single byte and of every other piece.
BYTE_COUNT, PIECE_COUNT = 0.5, 0.001


def pieces_of(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as byte strings with the log of their first weight.

    Pieces with A-Z or an inner space never match and are left out. Scores that are ranks of merges
    (below any log probability) become weights by rank, 1 / (rank + 10).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            continue
        piece = model.id_to_piece(k)
        body = bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()
        if b" " in body[1:] or any(65 <= b <= 90 for b in body) or body == b"":
            continue
        score = model.get_score(k) if not model.is_byte(k) else -np.inf
        scores[body] = max(scores.get(body, -np.inf), score)
    for byte in range(256):
        scores.setdefault(bytes([byte]), -np.inf)
    pieces = sorted(scores, key=lambda p: (-scores[p], p))
    given = np.array([scores[p] for p in pieces])
    known = given[np.isfinite(given)]
    if len(known) and known.min() > -50:
        log = np.where(np.isfinite(given), given, known.min() - 1)
    else:
        log = -np.log(np.arange(len(pieces)) + 10.0)
    return pieces, log - np.logaddexp.reduce(log)


class _Weights(NamedTuple):
    pieces: list[bytes]
    logp: np.ndarray


_built: dict[tuple, Vocabulary] = {}


def _vocabulary(pieces: list[bytes]) -> Vocabulary:
    """The trie of the pieces, built once per Python worker."""
    key = (len(pieces), hash(tuple(pieces)))
    if key not in _built:
        _built.clear()
        _built[key] = Vocabulary(pieces)
    return _built[key]


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every string with a space before it."""
    sizes = np.diff(offsets) + 1
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    out = np.full(at[-1], 0x20, np.uint8)
    body = np.ones(at[-1], bool)
    body[at[:-1]] = False
    out[body] = data[offsets[0] : offsets[-1]]
    return out, at


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of each slice."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for lo, hi in slices(offsets, 4 << 20):
            part = offsets[lo : hi + 1]
            words = Words(LOWER[data[part[0] : part[-1]]], part - part[0], GRAPHIC)
            _, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            body, at = gather_spans(words.data, words.starts[first], words.ends[first])
            yield pa.RecordBatch.from_arrays([binary_column(body, at), pa.array(n)], ["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a table with one text column; words as bytes."""
    return texts.mapInArrow(_counter, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _estimator(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: _Weights = model.value
        vocabulary = _vocabulary(weights.pieces)
        total = np.zeros(len(weights.pieces))
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            c = batch.column(1).to_numpy()
            for lo, hi in slices(offsets, 1 << 20):
                body, at = _spaced(data, offsets[lo : hi + 1])
                total += expected_counts(vocabulary, weights.logp, body, at, c[lo:hi].astype(np.float64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

    return run


def estimated_weights(counts: DataFrame, texts: int, pieces: list[bytes], logp: np.ndarray, rounds: int = ROUNDS):
    """Weights of the pieces, and of the end of a text, after ``rounds`` re-estimations over (word, c).

    Brings one sum per piece to the driver.
    """
    context = counts.sparkSession.sparkContext
    floor = np.array([BYTE_COUNT if len(p) == 1 else PIECE_COUNT for p in pieces])
    end = -np.log(len(pieces))
    for _ in range(rounds if texts else 0):
        model = context.broadcast(_Weights(pieces, logp))
        sums = counts.mapInArrow(_estimator(model), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        expected = floor.copy()
        for piece, n in sums:
            expected[piece] += n
        model.destroy()
        total = expected.sum() + texts
        logp, end = np.log(expected / total), np.log(texts / total)
    return logp, end


class _Model(NamedTuple):
    pieces: list[bytes]
    logp: np.ndarray
    end: float
    hashes: np.ndarray  # of the frequent words
    counts: np.ndarray
    likelihoods: np.ndarray



def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: _Model = model.value
        vocabulary, table = _vocabulary(m.pieces), Lookup(m.hashes)
        base_of = np.log10(m.counts + 1.0)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                words = Words(LOWER[data[part[0] : part[-1]]], part - part[0], GRAPHIC)
                hashed = words.hashes()
                place = table.find(hashed)
                rare = np.flatnonzero(place < 0)
                _, first, which = np.unique(hashed[rare], return_index=True, return_inverse=True)
                first = rare[first]
                body, at = gather_spans(words.data, words.starts[first], words.ends[first])
                rare_logs = log_likelihoods(vocabulary, m.logp, *_spaced(body, at))
                logs = np.empty(len(words))
                seen = place >= 0
                logs[seen] = m.likelihoods[place[seen]]
                logs[rare] = rare_logs[which]
                base = np.zeros(len(words))
                base[seen] = base_of[place[seen]]
                pairs, n = np.unique(words.rows[rare] * max(1, len(first)) + which, return_counts=True)
                row, word = np.divmod(pairs, max(1, len(first)))
                bounds = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                listed = pa.StructArray.from_arrays(
                    [binary_column(body, at).take(pa.array(word)), pa.array(n.astype(np.int64))], ["word", "n"]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array(words.counts + 1), pa.array(sums_by_row(seen.astype(np.float64), words.bounds).astype(np.int64)),
                     pa.array(sums_by_row(base, words.bounds)),
                     pa.array((sums_by_row(logs, words.bounds) + m.end) / np.log(10)),
                     pa.ListArray.from_arrays(pa.array(bounds), listed)],
                    ["doc_id", "held_out", "n_tokens", "n_seen", "seen_base", "score", "rare"],
                )

    return run


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count of the words that every task holds: at most ``most`` have it."""
    level = F.floor(F.log2("c") * 8).alias("level")
    levels = counts.groupBy(level).agg(F.min("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    held, least = 0, None
    for row in levels:  # some hundreds, whatever the corpus
        held += row["n"]
        if held > most:
            break
        least = row["c"]
    return least if least is not None else (1 << 62)


def lattice_scores(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    frequent: int = FREQUENT, rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); texts held out do not train."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lmscore")
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    training = texts.filter("not held_out")
    counts = scratch.write(word_counts(training.select("text")), "counts")
    n_texts = training.count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = tokens + n_texts, distinct + (n_texts > 0)
    pieces, logp = pieces_of(vocabulary)
    logp, end = estimated_weights(counts, n_texts, pieces, logp, rounds)

    least = _frequent(counts, frequent)
    held = counts.filter(F.col("c") >= least).toArrow()
    body, at = text_bytes(held.column("word"))
    known = _Model(
        pieces, logp, end, span_hashes(body, at[:-1], at[1:]), held.column("c").to_numpy(),
        log_likelihoods(_vocabulary(pieces), logp, *_spaced(body, at)),
    )
    model = spark.sparkContext.broadcast(known)
    scored = texts.mapInArrow(
        _scorer(model),
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_seen bigint, seen_base double, score double, "
        "rare array<struct<word:binary,n:bigint>>",
    )
    scored = scratch.write(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n")
    sums = (
        rare.join(counts.filter(F.col("c") < least), "word")
        .groupBy("uid")
        .agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_base"))
    )
    below = float(np.log10(tokens + distinct + 1))
    base = F.col("seen_base") + F.coalesce("rare_base", F.lit(0.0)) + float(np.log10(n_texts + 1))
    result = scored.drop("rare").join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_seen") + F.coalesce("n_rare", F.lit(0)) + (1 if n_texts else 0)).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (base - F.col("n_tokens") * below).alias("base_score"),
        "score",
    )
    return scratch.finish(result)


def one_in(divisor: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether the checksum of the id, as text, leaves this remainder; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == remainder, F.lit(False))
