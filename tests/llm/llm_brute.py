"""Plain versions of the operators for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
GRAPHIC = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=GRAPHIC):
    return pattern.findall((text or "").translate(LOWER))


def crc(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


def contamination(docs, items, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256) per row."""
    grams = collections.defaultdict(set)
    for item, text in items:
        w = words(text, WORD)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            grams[tuple(w[k : k + window])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        w = words(text, WORD)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                owners = grams.get(tuple(w[k : k + n]))
                if owners:
                    hit.update(range(k, k + n))
                    found |= owners
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return out


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def components(docs, width, percent=80):
    """doc_id: (size of its set, smallest reachable id)."""
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(docs, length):
    """(doc_id, n_bytes, kept bytes, merged ranges) per row."""
    count = collections.Counter()
    bodies = [(i, (t or "").encode()) for i, t in docs]
    for _, b in bodies:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = []
        for k, g in enumerate(gone):
            if g and (k == 0 or not gone[k - 1]):
                spans.append([k, k])
            if g:
                spans[-1][1] = k + 1
        out.append((i, len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g), [tuple(s) for s in spans]))
    return out


def base_scores(docs):
    """doc_id: (n_tokens, n_known, train_tokens, base_score)."""
    count = collections.Counter()
    for i, t in docs:
        if i is None or crc(i, 7) != 2:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t in docs:
        tokens = [*words(t), None]
        score = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        out[i] = (len(tokens), sum(count[w] > 0 for w in tokens), n, score)
    return out


def lattice_log(word, weights):
    """Log of the sum over all segmentations, by enumeration from the left."""
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(end):
            p = weights.get(word[begin:end])
            if p:
                total[end] += total[begin] * p
    return math.log(total[-1])
