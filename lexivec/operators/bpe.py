"""Byte-pair merges as Spark jobs over the distinct words of a corpus."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions import symbols as sy
from lexivec.scratch import Scratch

DEFAULT_MERGES = 10  # fixed value: what a request below one merge falls back to
AHEAD = 16  # merges that one pass plans
CHANGES = 1 << 18  # changed pairs that wait on the driver at most
MERGE_SCHEMA = "rank int, a string, b string, freq bigint"


def pair_counts(symbols: DataFrame) -> DataFrame:
    """Neighbouring symbol pairs, each occurrence weighted by the word's frequency."""
    return sy.pair_rows(symbols, "freq").groupBy("pair").agg(F.sum("freq").alias("n"))


def spelled_pairs(pairs: DataFrame, table: Sequence[str]) -> DataFrame:
    """Pair counts with the two symbols in hex."""
    return pairs.select(
        sy.symbol_hex(F.substring("pair", 1, 1), table).alias("a"),
        sy.symbol_hex(F.substring("pair", 2, 1), table).alias("b"),
        "n",
    )


def _in_order(pairs: DataFrame, table: Sequence[str]) -> DataFrame:
    spelling = F.concat(
        sy.symbol_hex(F.substring("pair", 1, 1), table),
        F.lit("20"),
        sy.symbol_hex(F.substring("pair", 2, 1), table),
    )
    return pairs.orderBy(F.desc("n"), spelling)


def best_pair(pairs: DataFrame, table: Sequence[str]) -> DataFrame:
    """The most frequent pair; ties go to the pair whose spelling ``a b`` is first in byte order."""
    return _in_order(pairs, table).limit(1)


def apply_merge(symbols: DataFrame, pair: str, into: str) -> DataFrame:
    """Merge one pair in every word and add up words that became equal."""
    return (
        symbols.select(sy.merged(F.col("syms"), pair, into).alias("syms"), "freq")
        .groupBy("syms")
        .agg(F.sum("freq").alias("freq"))
    )


class _Step(NamedTuple):
    """One planned merge: the pair, the symbol it becomes, and whether that symbol is new."""

    pair: str
    into: str
    whole: str
    is_new: bool


def _changes(words: DataFrame, steps: list[_Step]) -> DataFrame:
    """Net change of every pair count at each of several merges, one after the other.

    Reads only words that contain one of the pairs: a merge leaves no new neighbours of old symbols,
    so the others stay untouched. Only pairs that touch the merged symbols change, so there are at most
    a few per symbol of the vocabulary and step, whatever the size of the corpus.
    """
    touched = words.filter(reduce(Column.__or__, [F.contains("syms", F.lit(s.pair)) for s in steps]))
    touched = touched.select("freq", F.col("syms").alias("w0"))
    rows = []
    for k, step in enumerate(steps):
        touched = touched.withColumn(f"w{k + 1}", sy.merged(F.col(f"w{k}"), step.pair, step.into))
        for word, weight in ((f"w{k}", -F.col("freq")), (f"w{k + 1}", F.col("freq"))):
            hit = F.contains(f"w{k}", F.lit(step.pair))
            rows.append(F.when(hit, F.struct(F.lit(k).alias("step"), F.col(word).alias("syms"), weight.alias("n"))))
    both = touched.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    return sy.pair_rows(both, "n", "step").groupBy("step", "pair").agg(F.sum("n").alias("n")).filter("n <> 0")


class PairTable:
    """The counts of all pairs as a stored table, kept up to date by the changes of merges.

    The words are counted once. A merge subtracts the pairs of the words that it touches and adds those of
    the merged words; these changes are few, are kept until the table is next read, and are then added up with
    it by pair. So the counts after any number of merges cost a pass over the pairs, not over the words.
    """

    def __init__(self, words: DataFrame, scratch: Scratch):
        self.scratch, self.turn = scratch, 0
        self.rows = scratch.write(pair_counts(words), "pairs-0")
        self.changes: dict[str, int] = {}

    def note(self, changes: list) -> None:
        """Take in the ``(pair, n)`` rows of a merge."""
        for row in changes:
            self.changes[row["pair"]] = self.changes.get(row["pair"], 0) + row["n"]
        if len(self.changes) > CHANGES:
            self.counts()

    def counts(self) -> DataFrame:
        """``(pair, n)`` of now."""
        changed = [(p, n) for p, n in self.changes.items() if n]
        if changed:
            more = self.scratch.spark.createDataFrame(changed, "pair string, n bigint")
            now = self.rows.unionByName(more).groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0")
            self.turn += 1
            self.rows = self.scratch.write(now, f"pairs-{self.turn}")
            self.scratch.drop(f"pairs-{self.turn - 1}")
            self.changes = {}
        return self.rows


class _Leaders:
    """The most frequent pairs, kept exact between reads of the pair table.

    A read yields the leading pairs in their final order. Every pair left out is at most as
    frequent as the last leader, and later merges can only lower it unless it contains a symbol
    that a merge produces. So a leader above that mark is the best pair of all; when none is above
    it, or a left-out pair may have grown, the pair table is read again.
    """

    def __init__(self, table: Sequence[str], size: int):
        self.table, self.size = table, size
        self.counts: dict[str, int] = {}
        self.mark, self.first, self.fresh = 0, "", set()

    def recount(self, counts: DataFrame) -> None:
        ordered = _in_order(counts, self.table).limit(self.size).collect()
        self.counts = {r["pair"]: r["n"] for r in ordered}
        self.mark = ordered[-1]["n"] if len(ordered) == self.size else 0
        self.first = ordered[0]["pair"] if ordered else ""
        self.fresh = set()

    def plan(self, most: int) -> list[str]:
        """The best pair and those expected after it: by count, none sharing a symbol with an earlier one."""
        pair = self.best()
        if pair is None:
            return []
        chosen, used = [pair], set(pair)
        order = heapq.nsmallest(4 * most, self.counts, key=lambda p: (-self.counts[p], self.spelling(p)))
        for pair in order:
            if len(chosen) >= most or self.counts[pair] <= self.mark:
                break
            if used.isdisjoint(pair):
                chosen.append(pair)
                used |= set(pair)
        return chosen

    def best(self) -> str | None:
        """The best pair, or None when only a new count can tell."""
        if self.first:
            return self.first
        if not self.counts:
            return None
        pair = min(self.counts, key=lambda p: (-self.counts[p], self.spelling(p)))
        return pair if self.counts[pair] > self.mark else None

    def spelling(self, pair: str) -> str:
        return "20".join(self.table[sy.symbol_index(c)] for c in pair)

    def apply(self, changes: list, into: str, is_new: bool) -> bool:
        """Take in the changes of one merge; False when a new count is needed."""
        self.first = ""
        if is_new:
            self.fresh.add(into)
        for row in changes:
            pair, change = row["pair"], row["n"]
            if pair in self.counts or not self.fresh.isdisjoint(pair) or not self.mark:
                self.counts[pair] = self.counts.get(pair, 0) + change
                if self.counts[pair] <= 0:
                    del self.counts[pair]
            elif change > 0:
                return False
        return True


def _planned(pairs: list[str], table: list[str], known: dict[str, int]) -> list[_Step]:
    """The steps of some pairs; new symbols take the next places of the table."""
    steps, new = [], {}
    for pair in pairs:
        whole = "".join(table[sy.symbol_index(c)] for c in pair)
        place = known.get(whole, new.get(whole))
        if is_new := place is None:
            place = new[whole] = len(table) + len(new)
        steps.append(_Step(pair, sy.symbol_char(place), whole, is_new))
    return steps


def _symbols_of(merges: list) -> tuple[list[str], dict[str, int], dict[str, list[tuple[int, str]]]]:
    """Of ranked merges: content of every symbol, symbol of every merged content, and rank and result of every pair.

    A pair that is ranked twice counts at both ranks; the later one is found when the earlier is passed.
    """
    table, known, ranks = sy.hex_table(), {}, {}
    for rank, a, b in merges:
        pair = "".join(sy.symbol_char(known[x] if x in known else int(x, 16)) for x in (a, b))
        if a + b not in known:
            known[a + b] = len(table)
            table.append(a + b)
        ranks.setdefault(pair, []).append((rank, sy.symbol_char(known[a + b])))
    return table, known, ranks


def replayed(syms: str, ranks: dict[str, list[tuple[int, str]]]) -> str:
    """A word after all merges, one after the other in the order of their ranks."""
    passed = -1
    while len(syms) > 1:
        found = [
            (rank, pair, into)
            for pair in {syms[k : k + 2] for k in range(len(syms) - 1)}
            for rank, into in ranks.get(pair, ())
            if rank > passed
        ]
        if not found:
            break
        passed, pair, into = min(found)
        syms = syms.replace(pair, into)
    return syms


def apply_merges(symbols: DataFrame, learned: DataFrame) -> DataFrame:
    """``(syms, freq)`` with all merges of a table of merges applied; equal results are not added up.

    A projection: the merges, limited by their symbols, go to every task, and a word takes the steps that it has
    pairs for, not one per merge.
    """
    rows = sorted((r["rank"], r["a"], r["b"]) for r in learned.select("rank", "a", "b").collect())
    ranks = symbols.sparkSession.sparkContext.broadcast(_symbols_of(rows)[2])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [replayed(w, ranks.value) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(1)], ["syms", "freq"])

    return symbols.select("syms", "freq").mapInArrow(replay, "syms string, freq bigint")


def bpe_train(
    symbols: DataFrame, merges: int = DEFAULT_MERGES, cut_every: int = 20, leaders: int = 4096, ahead: int = AHEAD,
    trace: list[int] | None = None, learned: DataFrame | None = None,
) -> DataFrame:
    """Learn up to ``merges`` ranked merges from a ``(syms, freq)`` table of distinct words.

    The words stay on the executors, cached and rewritten by a narrow projection per pass. A pass plans
    up to ``ahead`` merges (as many as lately came true) and is one job over the words that contain one of the pairs; it returns the few
    pair counts that change at each merge. The driver replays them: as long as the planned pair is the
    best of all by the counts at its turn (see ``_Leaders``), its merge is taken; the first that is not
    ends the pass. The result is that of one merge at a time. Pair counts are a table that the changes of the
    merges keep up to date (see ``PairTable``); the words are counted once. Every ``cut_every`` passes the words are
    written out, so lineage and plans stay bounded and a lost executor costs a few narrow steps.

    ``learned`` are merges to go on from, ranked from 0: they are applied to the words first, in their order, and
    come first in the result, which has ``merges`` in all. The words may be those of a corpus that has grown since.

    ``trace`` receives the number of merges that each pass took.
    """
    spark = symbols.sparkSession
    merges = merges if merges >= 1 else DEFAULT_MERGES
    if merges > sy.MOST_MERGES:
        raise ValueError(f"at most {sy.MOST_MERGES} merges have a symbol")
    scratch = Scratch(spark, "bpe")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = StorageLevel.MEMORY_AND_DISK
    before = [] if learned is None else [tuple(r) for r in learned.select("rank", "a", "b", "freq").orderBy("rank").collect()]
    if [r[0] for r in before] != list(range(len(before))):
        raise ValueError("the ranks of the learned merges are not 0, 1, 2 ...")
    if len(before) >= merges:
        return spark.createDataFrame(before[:merges], MERGE_SCHEMA)
    table, known, _ = _symbols_of([r[:3] for r in before])
    start = symbols if learned is None else apply_merges(symbols, learned)
    learned: list[tuple[int, str, str, int]] = before
    held: list[DataFrame] = []
    try:
        start = start.filter(F.length("syms") > 1).select("syms", "freq").repartition(spread, "syms")
        words = scratch.write(start, "words-0").persist(level)
        held.append(words)
        passes, cut, most = 0, 0, min(4, ahead)
        lead, counted = _Leaders(table, leaders), PairTable(words, scratch)
        lead.recount(counted.counts())
        while len(learned) < merges:
            pairs = lead.plan(min(most, merges - len(learned)))
            if not pairs and lead.mark:
                lead.recount(counted.counts())
                pairs = lead.plan(min(most, merges - len(learned)))
            if not pairs:
                break
            steps = _planned(pairs, table, known)
            found: dict[int, list] = {}
            if len(learned) + 1 < merges:
                for row in _changes(words, steps).collect():
                    found.setdefault(row["step"], []).append(row)
            taken, exact = 0, True
            for k, step in enumerate(steps):
                if k and (not exact or lead.best() != step.pair):
                    break
                a, b = (table[sy.symbol_index(c)] for c in step.pair)
                learned.append((len(learned), a, b, lead.counts[step.pair]))
                if step.is_new:
                    known[step.whole] = len(table)
                    table.append(step.whole)
                exact = lead.apply(found.get(k, []), step.into, step.is_new)
                counted.note(found.get(k, []))
                taken += 1
            if trace is not None:
                trace.append(taken)
            if taken == most:  # plan as far as plans come true
                most = min(2 * most, ahead)
            elif 2 * taken < most:
                most = max(most // 2, min(2, ahead))
            if len(learned) == merges:
                break
            passes += 1
            merged = reduce(lambda c, s: sy.merged(c, s.pair, s.into), steps[:taken], F.col("syms"))
            words = words.select(merged.alias("syms"), "freq")
            if passes % cut_every == 0:
                cut += 1
                words = scratch.write(words, f"words-{cut}")
                while held:
                    held.pop().unpersist()
                scratch.drop(f"words-{cut - 1}")
            words = words.persist(level)
            held.append(words)
            if len(held) > 2:  # the parent is read while its child is not yet stored
                held.pop(0).unpersist()
            if not exact:
                lead.recount(counted.counts())
    finally:
        for frame in held:
            frame.unpersist()
        scratch.drop("")
    return spark.createDataFrame(learned, MERGE_SCHEMA)


def train_with_saves(
    symbols: DataFrame, merges: int, load: Callable[[], DataFrame | None], save: Callable[[DataFrame], None], every: int = 1000
) -> DataFrame:
    """Training that can be stopped at any time: every ``every`` merges are saved, and a start goes on from the last save.

    ``load`` gives the merges saved so far, or None; ``save`` stores a table of merges (see ``sources.store``).
    """
    learned = load()
    done = 0 if learned is None else learned.count()
    while learned is None or done < merges:
        wanted = min(merges, done + every)
        learned = bpe_train(symbols, wanted, learned=learned)
        found = learned.count()
        if found > done:
            save(learned)
        if found < wanted:  # no pair is left
            return learned
        done = found
    return learned.filter(F.col("rank") < merges)


def merge_log(merges: DataFrame) -> DataFrame:
    """Per step: rank, the two symbols joined by a space, the new token, its frequency."""
    return merges.select(
        "rank", F.concat_ws(" ", "a", "b").alias("pair"), F.concat("a", "b").alias("token"), "freq"
    )
