"""Words as lattices of subword pieces: forward and backward recursions in log space.

A lattice has a node per byte boundary of a word and an edge per vocabulary piece that matches there.
Words are taken together: step ``s`` pushes the forward value of boundary ``s`` along all edges of all
words that begin there, found by one walk down the vocabulary's trie.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Words up to this many bytes are taken together; a longer one is taken alone, boundary by boundary.
TOGETHER = 64
#: Words per group.
GROUP = 20_000


class Vocabulary:
    """Pieces (byte strings, every single byte among them) in a trie of rows by byte class."""

    def __init__(self, pieces: Sequence[bytes]):
        self.pieces = list(pieces)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, piece in enumerate(self.pieces):
            node = 0
            for byte in piece:
                node = children[node].setdefault(byte, len(children))
                if node == len(children):
                    children.append({})
                    ends.append(-1)
            ends[node] = k
        self.children, self.ends = children, np.array(ends, np.int32)
        inner = [n for n, c in enumerate(children) if c]
        rows = np.zeros(len(children), np.int32)  # row 0 is the row of a node without children
        rows[inner] = np.arange(1, len(inner) + 1)
        used = sorted({b for c in children for b in c})
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(len(used))
        self.width = len(used)
        self.rows = rows
        self.next = np.full((len(inner) + 1) * self.width, -1, np.int32)
        for n in inner:
            for byte, child in children[n].items():
                self.next[rows[n] * self.width + self.classes[byte]] = child

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self.next[self.rows[node] * self.width + self.classes[byte]]


def _grid(data: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked words as columns, padded below."""
    size = offsets[pick + 1] - offsets[pick]
    height = int(size.max(initial=0))
    at = offsets[pick][None, :] + np.arange(height)[:, None]
    return data[np.minimum(at, len(data) - 1)], size


def _edges(vocabulary: Vocabulary, grid: np.ndarray, size: np.ndarray):
    """For every boundary: (length, words, pieces) of the edges that begin there. Words come longest first."""
    for s in range(len(grid)):
        alive = np.arange(np.searchsorted(-size, -s, "left"))  # words with more than s bytes
        node = np.zeros(len(alive), np.int32)
        out, k = [], 0
        while len(alive) and s + k < len(grid):
            node = vocabulary.step(node, grid[s + k, alive])
            k += 1
            fit = node >= 0
            alive, node = alive[fit], node[fit]
            piece = vocabulary.ends[node]
            ends = piece >= 0
            if ends.any():
                out.append((k, alive[ends], piece[ends]))
            more = (vocabulary.rows[node] > 0) & (size[alive] > s + k)
            alive, node = alive[more], node[more]
        yield s, out


def _alone(vocabulary: Vocabulary, logp: np.ndarray, word: bytes) -> tuple[list, list]:
    """Forward values of one long word, and its edges (begin, end, piece)."""
    alpha = [-np.inf] * (len(word) + 1)
    alpha[0], edges = 0.0, []
    for s in range(len(word)):
        node, at = 0, s
        while at < len(word):
            node = vocabulary.children[node].get(word[at])
            if node is None:
                break
            at += 1
            piece = int(vocabulary.ends[node])
            if piece >= 0:
                edges.append((s, at, piece))
                alpha[at] = float(np.logaddexp(alpha[at], alpha[s] + logp[piece]))
    return alpha, edges


def log_likelihoods(vocabulary: Vocabulary, logp: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log of the probability of each word, summed over all its segmentations."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    for k in order[sizes[order] > TOGETHER]:
        out[k] = _alone(vocabulary, logp, data[offsets[k] : offsets[k + 1]].tobytes())[0][-1]
    order = order[sizes[order] <= TOGETHER]
    for lo in range(0, len(order), GROUP):
        pick = order[lo : lo + GROUP]
        grid, size = _grid(data, offsets, pick)
        alpha = np.full((len(grid) + 1, len(pick)), -np.inf)
        alpha[0] = 0
        for s, edges in _edges(vocabulary, grid, size):
            for k, words, pieces in edges:
                alpha[s + k, words] = np.logaddexp(alpha[s + k, words], alpha[s, words] + logp[pieces])
        out[pick] = alpha[size, np.arange(len(pick))]
    return out


def expected_counts(
    vocabulary: Vocabulary, logp: np.ndarray, data: np.ndarray, offsets: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """How often each piece is used, over all segmentations by their posterior, words weighted."""
    total = np.zeros(len(logp))
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    for k in order[sizes[order] > TOGETHER]:
        alpha, edges = _alone(vocabulary, logp, data[offsets[k] : offsets[k + 1]].tobytes())
        beta = [-np.inf] * len(alpha)
        beta[-1] = 0.0
        for s, e, piece in reversed(edges):
            beta[s] = float(np.logaddexp(beta[s], logp[piece] + beta[e]))
        for s, e, piece in edges:
            total[piece] += weights[k] * np.exp(alpha[s] + logp[piece] + beta[e] - alpha[-1])
    order = order[sizes[order] <= TOGETHER]
    for lo in range(0, len(order), GROUP):
        pick = order[lo : lo + GROUP]
        grid, size = _grid(data, offsets, pick)
        alpha = np.full((len(grid) + 1, len(pick)), -np.inf)
        alpha[0] = 0
        kept = []
        for s, edges in _edges(vocabulary, grid, size):
            for k, words, pieces in edges:
                alpha[s + k, words] = np.logaddexp(alpha[s + k, words], alpha[s, words] + logp[pieces])
            kept.append((s, edges))
        beta = np.full_like(alpha, -np.inf)
        beta[size, np.arange(len(pick))] = 0
        scale = alpha[size, np.arange(len(pick))]
        for s, edges in reversed(kept):
            for k, words, pieces in edges:
                step = logp[pieces] + beta[s + k, words]
                beta[s, words] = np.logaddexp(beta[s, words], step)
                share = np.exp(alpha[s, words] + step - scale[words]) * weights[pick[words]]
                total += np.bincount(pieces, share, len(total))
    return total
