"""A run-length index of a small collection of strings, and the matching statistics it streams.

The strings end in separators of their own, so no match crosses them. The Burrows-Wheeler transform is
kept as runs of equal symbols. At the first and last row of every run the text position is sampled with
the length it shares with the row before and after it. Between samples these lengths fall by one per
position, so one walk over the samples in text order gives, for every position, the longest match that
starts anywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols per packed key: nine bits each, 0 beyond the end of a string.
PACK = 7


def _packed(data: np.ndarray, rest: np.ndarray) -> np.ndarray:
    n = len(data)
    wide = np.zeros(n + PACK, np.int64)
    wide[:n] = data
    wide[:n] += 1
    out = np.zeros(n, np.int64)
    for k in range(PACK):
        out <<= 9
        out += np.where(rest > k, wide[k : k + n], 0)
    return out


def suffix_order(packed: np.ndarray, rest: np.ndarray, string: np.ndarray, strings: int) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling; only undecided rows are sorted again."""
    n = len(packed)
    order = np.argsort(packed)
    sorted_keys = packed[order]
    begins = np.ones(n, bool)
    begins[1:] = sorted_keys[1:] != sorted_keys[:-1]
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    known = PACK
    alone = begins & np.append(begins[1:], True)
    open_rows = np.flatnonzero(~alone)
    while len(open_rows):
        at = order[open_rows]
        ended = rest[at] <= known
        second = np.where(ended, string[at], strings + place[np.where(ended, 0, at + known)])
        keys = place[at] * (n + strings + 1) + second
        turn = np.argsort(keys)
        at, keys = at[turn], keys[turn]
        order[open_rows] = at
        begins = np.ones(len(at), bool)
        begins[1:] = keys[1:] != keys[:-1]
        place[at] = np.maximum.accumulate(np.where(begins, open_rows, 0))
        alone = begins & np.append(begins[1:], True)
        open_rows = open_rows[~alone]
        known *= 2
    return order


def shared_lengths(packed: np.ndarray, rest: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``one`` and ``two``."""
    limit = np.minimum(rest[one], rest[two])
    out = limit.copy()
    todo, done = np.arange(len(one)), 0
    while len(todo):
        todo = todo[limit[todo] > done]
        differ = packed[one[todo] + done] ^ packed[two[todo] + done]
        off = differ != 0
        last, gap = todo[off], differ[off]
        equal = np.zeros(len(last), np.int64)
        for k in range(1, PACK):
            equal += (gap >> (9 * (PACK - k))) == 0
        out[last] = np.minimum(limit[last], done + equal)
        todo = todo[~off]
        done += PACK
    return out


@dataclass
class RunIndex:
    """Run-compressed transform with samples at both ends of every run."""

    size: int
    symbols: np.ndarray  # per run; 0 is a separator
    lengths: np.ndarray  # rows per run
    first: np.ndarray  # text position at the first row of a run
    first_shared: np.ndarray  # length shared with the row before
    last: np.ndarray  # text position at the last row of a run
    last_shared: np.ndarray  # length shared with the row after

    @classmethod
    def build(cls, data: np.ndarray, offsets: np.ndarray) -> RunIndex:
        """Index the strings ``data[offsets[i]:offsets[i + 1]]``."""
        n, sizes = len(data), np.diff(offsets)
        string = np.repeat(np.arange(len(sizes)), sizes)
        rest = offsets[1:][string] - np.arange(n)
        packed = _packed(data, rest)
        order = suffix_order(packed, rest, string, len(sizes))
        symbol = np.zeros(n, np.int16)
        inner = order > offsets[:-1][string[order]]
        symbol[inner] = data[order[inner] - 1].astype(np.int16) + 1
        begins = np.ones(n, bool)
        begins[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)  # separators are all different
        heads = np.flatnonzero(begins)
        tails = np.append(heads[1:], n)[: len(heads)] - 1
        first_shared, last_shared = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        inside = heads > 0
        first_shared[inside] = shared_lengths(packed, rest, order[heads[inside]], order[heads[inside] - 1])
        inside = tails < n - 1
        last_shared[inside] = shared_lengths(packed, rest, order[tails[inside]], order[tails[inside] + 1])
        return cls(n, symbol[heads], tails - heads + 1, order[heads], first_shared, order[tails], last_shared)

    def matches(self) -> np.ndarray:
        """For every position the length of the longest match that starts at another position."""
        reach = np.zeros(self.size, np.int64)
        np.maximum.at(reach, self.first, self.first + self.first_shared)
        np.maximum.at(reach, self.last, self.last + self.last_shared)
        return np.maximum.accumulate(reach) - np.arange(self.size) if self.size else reach


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
