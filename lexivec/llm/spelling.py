"""Spelling variants: words one edit apart, found by dynamic programming over sorted vocabularies.

Words are the runs of Latin letters of the texts, A-Z lower-cased, with their counts. A word's form is its
near word (one code point inserted, deleted or replaced) of largest count, if that is ``RATIO`` times its
own; its root follows the forms to the last.

Near words share one half. Of two words of length m, or m and m + 1, that are one edit apart, either the
first or the last h = ceil((m - 1) / 2) code points are equal. So a word of length L goes to the blocks of L and
of L - 1 by its first h code points, and in reverse order by its last h. A block is scanned as a sorted list,
once for each of its words of length m: three cells around the diagonal of the edit matrix are kept for every
depth of the list's current word, the next word starts at the row of the prefix that it shares with the one
before, and where no cell is below two all words with that prefix are skipped.

Scale: occurrences are counted per task before the shuffle and once after it. Blocks of more than ``BLOCK``
words are cut into parts by a hash, and every two parts meet in one place. A scan gives one row per word and
place (how many near words, the best of them), never the pairs.

Defined results: null and empty texts have no words; equal rows count each; a null id is spelled as an empty
text; ties of counts go to the word that is smallest in code-point order; without words the result is empty;
further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.batches import slices, text_bytes
from lexivec.scratch import Scratch

#: Code points and occurrences of a word at least, and how many times as frequent its form is.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: One occurrence in so many, by a checksum, loses a code point.
DROP = 199
#: Words of a part of a block.
BLOCK = 4096
#: Different words that a task counts before it hands them on.
HELD = 1 << 17

#: [A-Za-zÀ-ÿ]+ in UTF-8, after lower-casing.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def occurrences(doc_id: bytes, text: bytes, drop: int = DROP) -> Counter:
    """The words of one text with their counts; some lose a code point, by the checksum of id and run."""
    seed = zlib.crc32(doc_id + b":")
    out = Counter()
    for run, n in Counter(RUN.findall(text.lower())).items():  # bytes.lower changes A-Z only
        h = zlib.crc32(run, seed)
        if h % drop == 0:
            word = run.decode()
            at = h % len(word)
            run = (word[:at] + word[at + 1 :]).encode()
        out[run] += n
    return out


def _counter(letters: int):
    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                for row in range(lo, hi):
                    name = (ids[row] or "").encode()
                    for word, n in occurrences(name, data[offsets[row] : offsets[row + 1]].tobytes()).items():
                        if len(word) - word.count(b"\xc3") >= letters:
                            held[word] += n
                if len(held) > HELD:
                    yield table(held)
                    held = Counter()
        yield table(held)

    return run


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of enough code points and occurrences."""
    found = docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(_counter(LETTERS), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def adjacent_prefixes(words: list[str]) -> list[int]:
    """How many code points each word of a sorted list shares with the one before it."""
    out = [0] * len(words)
    for k in range(1, len(words)):
        one, two = words[k - 1], words[k]
        depth, top = 0, min(len(one), len(two))
        while depth < top and one[depth] == two[depth]:
            depth += 1
        out[k] = depth
    return out


def near_words(query: str, words: list[str], prefixes: list[int], shared: int) -> list[int]:
    """Places in the sorted list of the words exactly one edit from ``query``; all share ``shared`` code points with it.

    ``rows[p]`` holds the cells D[p][p - 1], D[p][p], D[p][p + 1] of the edit matrix of the current word's first p
    code points against the query's. Where all three exceed one edit, the row before holds no 0 and goes on only
    with the query's code point at a cell of 1; the scan skips to the next word that has one.
    """
    out = []
    padded = query + "\0\0\0"  # no letter
    n, k, end = len(query), 0, len(words)
    rows = [(1, 0, 1)] * (shared + 1)
    depth = shared
    while k < end:
        word = words[k]
        del rows[depth + 1 :]
        left, middle, right = rows[depth]
        for p in range(depth, len(word)):
            c = word[p]
            left = min(left + (c != padded[p - 1]), middle + 1)
            middle = min(middle + (c != padded[p]), right + 1, left + 1)
            right = min(right + (c != padded[p + 1]), middle + 1)
            if left > 1 and middle > 1 and right > 1 or p > n:
                # The row before ends its range, but for words that go on with one of these.
                left, middle, right = rows[p]
                later = [x for cell, x in ((left, padded[p - 1]), (middle, padded[p]), (right, padded[p + 1])) if cell == 1 and x > c]
                goal = word[:p] + (min(later) if later and p <= n else "\U0010ffff")
                k = bisect_left(words, goal, k + 1)
                if k < end:
                    after = words[k]
                    depth = shared
                    while depth < p and depth < len(after) and after[depth] == word[depth]:
                        depth += 1
                break
            rows.append((left, middle, right))
        else:
            gap = n - len(word)
            if -1 <= gap <= 1 and rows[len(word)][gap + 1] == 1:
                out.append(k)
            k += 1
            if k < end:
                depth = max(shared, prefixes[k])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted blocks: (word, n_near, best, best_n) of each word with near words in its block."""

    def rows():
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    names = ["word", "n_near", "form", "form_n"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    out: list[tuple] = []
    for (backward, m, *_), group in groupby(rows(), key=lambda r: r[:5]):
        words, counts, asked = [], [], []
        for *_, word, n, listed, query in group:
            if listed:
                words.append(word)
                counts.append(n)
            if query:
                asked.append((word, n))
        half, prefixes = m // 2, adjacent_prefixes(words)
        best: dict[str, tuple[int, int, str]] = {}

        def note(word: str, other: str, n: int) -> None:
            number, most, form = best.get(word, (0, 0, ""))
            if n > most or n == most and other[:: 1 - 2 * backward] < form[:: 1 - 2 * backward]:
                most, form = n, other
            best[word] = (number + 1, most, form)

        for query, n in asked:
            for k in near_words(query, words, prefixes, half):
                other = words[k]
                if backward and other[-half:] == query[-half:]:
                    continue  # the first halves are equal as well: the forward block has this pair
                note(query, other, counts[k])
                if len(other) > m:  # equal lengths come from both sides
                    note(other, query, n)
        turn = 1 - 2 * backward
        out += [(word[::turn], number, form[::turn], most) for word, (number, most, form) in best.items()]
        if len(out) > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def near_summary(words: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of each word of ``words(word, n)`` with near words; the best of them as form."""
    length = F.length("word")
    sides = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("backward")).select(
        "backward", F.when(F.col("backward") == 1, F.reverse("word")).otherwise(F.col("word")).alias("word"), "n"
    )
    placed = sides.select("*", F.explode(F.array(length, length - 1)).alias("m")).select(
        "backward", "m", F.expr("substring(word, 1, m div 2)").alias("half"), "word", "n", (length == F.col("m")).alias("query")
    )
    key = ["backward", "m", "half"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("all"), F.max("query").alias("asked"))
    sizes = sizes.filter("asked and all > 1").select(*key, F.ceil(F.col("all") / block).cast("int").alias("parts"))
    placed = placed.join(sizes, key).withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    # A place (x, y) has the words of part x as its list and those of part y as queries.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    spread = placed.select(*key, "word", "n", "query", "mine", other)
    lists = spread.select(
        *key, F.col("mine").alias("x"), F.col("other").alias("y"), "word", "n", F.lit(True).alias("listed"),
        (F.col("query") & (F.col("mine") == F.col("other"))).alias("query"),
    )
    queries = spread.filter("query and mine <> other").select(
        *key, F.col("other").alias("x"), F.col("mine").alias("y"), "word", "n", F.lit(False).alias("listed"), "query"
    )
    at = [*key, "x", "y"]
    # Few bytes, much work: as many tasks as the session's setting, not as few as the bytes would need.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = lists.unionByName(queries).repartition(tasks, *at).sortWithinPartitions(*at, "word")
    found = scratch.write(met.mapInArrow(_scan, "word string, n_near bigint, form string, form_n bigint"), "near")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n")
    )


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of ``links(word, form)``: forms are followed to the last, in doubling steps.

    A form is ``RATIO`` times as frequent as its word, so chains are short and have no loops.
    """
    links = scratch.write(links.select("word", F.col("form").alias("root")), "links-0")
    turn = 0
    while True:
        on = links.select(F.col("word").alias("w"), F.col("root").alias("r"))
        if links.join(on, F.col("root") == F.col("w"), "left_semi").isEmpty():
            return links
        turn += 1
        step = links.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"))
        links = scratch.write(step, f"links-{turn}")
        scratch.drop(f"links-{turn - 1}")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of ``docs``."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(vocabulary(docs, doc_id, text), "words")
    near = near_summary(words, scratch)
    joined = words.join(near, "word", "left")
    has = F.col("form_n") >= F.col("n") * RATIO
    table = scratch.write(
        joined.select(
            "word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(table.filter("form is not null"), scratch)
    result = table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return scratch.finish(result)
