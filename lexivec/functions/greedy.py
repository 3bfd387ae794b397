"""Greedy merging, used inside tasks by the encode operators: of one byte string, and of an array of texts at once."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

from lexivec.functions.chunks import bytes_read

SCAN_SYMBOLS = 128  # above this many symbols a heap finds the next merge
NO_RANK = 1 << 62
NO_ID = -1  # fixed value: of a byte that no token covers
STRETCH = 1 << 18  # bytes that are merged at a time
MERGED = -1  # in the place of a symbol that went into the one before it


class GreedyEncoder:
    """Encodes bytes with a token table: the best-ranked neighbouring pair merges first."""

    def __init__(self, tokens: list[tuple[int, bytes, int | None]], unknown: bytes | None):
        self.ids = {t: i for i, t, _ in tokens}
        if unknown is None:  # a NUL is in no text and no token
            unknown = b"\0"
            self.ids[unknown] = NO_ID
        self.ranks = {t: r for _, t, r in tokens if r is not None}
        singles = (bytes([b]) for b in range(256))
        self.symbols = [s if s in self.ids else unknown for s in singles]

    def merge(self, data: bytes) -> list[int]:
        """Best rank first, leftmost on ties."""
        symbols = self.symbols
        parts = [symbols[b] for b in data]
        if len(parts) > SCAN_SYMBOLS:
            parts = self.merge_long(parts)
        else:
            rank_of = self.ranks.get
            ranks = [rank_of(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
            while ranks and (best := min(ranks)) != NO_RANK:
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank_of(parts[i - 1] + parts[i], NO_RANK)
                if i < len(ranks):
                    ranks[i] = rank_of(parts[i] + parts[i + 1], NO_RANK)
        ids = self.ids
        return [ids[p] for p in parts]

    def merge_long(self, parts: list[bytes]) -> list[bytes]:
        """The same order of merges over a linked list, with a heap of candidates."""
        end, rank_of = len(parts), self.ranks.get
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        pairs = ((rank_of(parts[i] + parts[i + 1]), i, parts[i], parts[i + 1]) for i in range(end - 1))
        heap = [p for p in pairs if p[0] is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not left or j >= end or parts[j] is not right:
                continue
            parts[i], parts[j] = left + right, b""
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < end:
                    rank = rank_of(parts[k] + parts[after[k]])
                    if rank is not None:
                        heapq.heappush(heap, (rank, k, parts[k], parts[after[k]]))
        return [p for p in parts if p]


class TextEncoder:
    """The ids of ``GreedyEncoder`` for whole arrays of texts, without a Python object per word and without a memo.

    Two bytes that stand side by side in no ranked token never come into one symbol. Cut between such bytes, texts fall into
    runs that stand alone. In each round every run that has a ranked pair merges its best one, the leftmost on ties; runs
    without one drop out. So the work follows the bytes, and the memory is that of a stretch, whatever words the texts hold.
    """

    def __init__(self, tokens: list[tuple[int, bytes, int | None]], unknown: bytes | None):
        self.greedy = greedy = GreedyEncoder(tokens, unknown)
        self.contents = list(dict.fromkeys([*greedy.symbols, *greedy.ranks]))
        self.places = places = {c: k for k, c in enumerate(self.contents)}
        self.ids = np.array([greedy.ids[c] for c in self.contents], np.int32)
        self.of_byte = np.array([places[s] for s in greedy.symbols], np.int32)
        splits = ((t, t[:k], t[k:]) for t in greedy.ranks for k in range(1, len(t)))
        pairs = sorted((self._key(places[a], places[b]), greedy.ranks[t], places[t]) for t, a, b in splits if a in places and b in places)
        self.pairs = np.array([p[0] for p in pairs], np.int64)
        order = np.unique([p[1] for p in pairs], return_inverse=True)[1]
        self.none = len(pairs)  # the pair number of what is no ranked pair
        self.order = np.append(order, len(pairs)).astype(np.int64)
        self.merged = np.array([p[2] for p in pairs], np.int32)
        inside = np.zeros((256, 256), bool)
        for t in greedy.ranks:
            inside[list(t[:-1]), list(t[1:])] = True
        ends, begins = ([s[k] for s in greedy.symbols] for k in (-1, 0))
        self.apart = ~inside[np.ix_(ends, begins)]

    def _key(self, left, right):
        return left * len(self.contents) + right

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """The ids of every text, read up to its first NUL; null for a null."""
        data, ends = bytes_read(texts)
        symbols = self.of_byte[data]
        apart = np.ones(len(data), bool)  # from the next byte
        apart[:-1] = self.apart[data[:-1], data[1:]]
        apart[ends[1:][ends[1:] > 0] - 1] = True
        at = 0
        while at < len(data):
            stop = min(at + STRETCH, len(data))
            stop += int(np.argmax(apart[stop - 1 :]))
            self._merge(symbols[at:stop], apart[at:stop])
            at = stop
        kept = symbols != MERGED
        sizes = np.append(0, np.cumsum(kept, dtype=np.int32))
        missing = pa.array(np.asarray(texts.is_null().to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(sizes[ends]), pa.array(self.ids[symbols[kept]]), mask=missing)

    def _pair(self, symbols: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The pair number of the symbols at some places with the next ones."""
        found = np.full(len(at), self.none)
        some = np.flatnonzero(~last[at])
        if len(some) and self.none:
            key = self._key(symbols[at[some]].astype(np.int64), symbols[at[some] + 1])
            place = np.minimum(np.searchsorted(self.pairs, key), self.none - 1)
            found[some] = np.where(self.pairs[place] == key, place, self.none)
        return found

    def _merge(self, symbols: np.ndarray, apart: np.ndarray) -> None:
        """Merge the symbols of a stretch where they are."""
        grouped = ~apart
        grouped[1:] |= ~apart[:-1]
        where = np.flatnonzero(grouped)  # in runs of two and more
        here, last = symbols[where], apart[where]
        pair = self._pair(here, last, np.arange(len(here)))
        while len(here):
            begins = np.flatnonzero(np.append(True, last[:-1]))
            sizes = np.diff(np.append(begins, len(here)))
            best = np.minimum.reduceat(self.order[pair] * len(here) + np.arange(len(here)), begins)
            rank, left = np.divmod(best, len(here))
            alive = rank < self.none
            long = alive & (sizes > SCAN_SYMBOLS)
            for k in np.flatnonzero(long):
                run = where[begins[k] : begins[k] + sizes[k]]
                parts = self.greedy.merge_long([self.contents[s] for s in symbols[run]])
                symbols[run] = MERGED
                symbols[run[: len(parts)]] = [self.places[p] for p in parts]
            alive &= ~long
            left = left[alive]
            here[left] = self.merged[pair[left]]
            symbols[where[left]] = here[left]
            symbols[where[left + 1]] = MERGED
            last[left] = last[left + 1]
            stays = np.repeat(alive, sizes)
            stays[left + 1] = False
            left = (np.cumsum(stays) - 1)[left]
            where, here, last, pair = where[stays], here[stays], last[stays], pair[stays]
            pair[left] = self._pair(here, last, left)
            before = left[left > 0] - 1
            pair[before] = self._pair(here, last, before)
