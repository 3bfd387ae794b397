"""Plain restatements of the semantics, used to check the Spark jobs on small inputs."""

from collections import Counter

WHITESPACE = b" \t\n\x0b\x0c\r"


def words_of(text):
    data = (text if isinstance(text, bytes) else text.encode()).split(b"\0", 1)[0]
    for b in WHITESPACE:
        data = data.replace(bytes([b]), b" ")
    return [w for w in data.split(b" ") if w]


def train(texts, merges):
    words = [([bytes([b]) for b in w], f) for w, f in Counter(w for t in texts for w in words_of(t)).items()]
    learned = []
    for rank in range(merges):
        pairs = Counter()
        for parts, freq in words:
            for pair in zip(parts, parts[1:]):
                pairs[pair] += freq
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda e: (-e[1], e[0][0] + b" " + e[0][1]))
        learned.append((rank, a.hex().upper(), b.hex().upper(), n))
        words = [(merge_once(parts, a, b), freq) for parts, freq in words]
    return learned


def merge_once(parts, a, b):
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def encode(text, ids, ranks, unknown):
    """Scan the whole text for the best pair, merge it, repeat."""
    parts = [s if s in ids else unknown for s in (bytes([b]) for b in (text if isinstance(text, bytes) else text.encode()).split(b"\0", 1)[0])]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ids[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
