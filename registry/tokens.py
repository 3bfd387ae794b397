"""Vocabulary, merges and tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import symbols as sy
from lexivec.operators import bpe, codec, dictionary, tokens, vocab
from lexivec.plans import tokenizer as plan
from lexivec.scratch import Scratch
from lexivec.sources import tables
from registry.common import q6, r6, table, words_sql

MERGES = 10
TOP_WORDS = 50


def merges_of(spark, sf):
    """The merges of the documents, learned anew for every query that starts from a model."""
    return plan.learn_merges(table(spark, sf, "documents"), MERGES)


def tokenizer_of(spark, sf):
    return tokens.tokenizer_build(merges_of(spark, sf))


def symbols_of(spark, sf):
    return vocab.symbol_freq(vocab.word_freq(table(spark, sf, "documents")))


def encoded_docs(spark, sf, model=None):
    return codec.encode_corpus(table(spark, sf, "documents"), tokenizer_of(spark, sf) if model is None else model)


def as_csv(ids):
    return F.array_join(ids.cast("array<string>"), ",")


def word_freq(spark, sf):
    return vocab.word_freq(table(spark, sf, "documents"))


def symbol_freq(spark, sf):
    return symbols_of(spark, sf).select(sy.spelled(F.col("syms"), sy.hex_table()).alias("syms"), "freq")


def vocab_log(spark, sf):
    return vocab.vocab_log(word_freq(spark, sf), TOP_WORDS)


def pair_counts(spark, sf):
    return bpe.spelled_pairs(bpe.pair_counts(symbols_of(spark, sf)), sy.hex_table())


def best_pair(spark, sf):
    best = bpe.best_pair(bpe.pair_counts(symbols_of(spark, sf)), sy.hex_table())
    return bpe.spelled_pairs(best, sy.hex_table())


def apply_merge(spark, sf):
    symbols = symbols_of(spark, sf)
    best = bpe.best_pair(bpe.pair_counts(symbols), sy.hex_table()).collect()[0]["pair"]
    base = sy.hex_table()
    whole = sy.hex_table(["".join(base[sy.symbol_index(c)] for c in best)])
    out = bpe.apply_merge(symbols, best, sy.symbol_char(sy.BYTES))
    return out.select(sy.spelled(F.col("syms"), whole).alias("syms"), "freq")


def bpe_train(spark, sf):
    return merges_of(spark, sf)


def bpe_resume(spark, sf):
    """Half of the merges from the documents, the rest after the conversations were added to the vocabulary."""
    words = vocab.word_freq(table(spark, sf, "documents"))
    learned = bpe.bpe_train(vocab.symbol_freq(words), MERGES // 2)
    grown = vocab.counting_upsert(words, vocab.word_freq(table(spark, sf, "conversations")))
    return bpe.bpe_train(vocab.symbol_freq(grown), MERGES, learned=learned)


def merge_log(spark, sf):
    return bpe.merge_log(merges_of(spark, sf))


def merges_table(spark, sf):
    """The merges written as a versioned table and read back."""
    path = Scratch(spark, "model").path("merges")
    tables.save_table(merges_of(spark, sf), path, "merges")
    return tables.load_table(spark, path, "merges")


def tokenizer_table(spark, sf):
    path = Scratch(spark, "tokenizer").path("table")
    tables.save_table(tokenizer_of(spark, sf), path, "tokenizer")
    return tables.load_table(spark, path, "tokenizer").select(
        "id", "token", "is_special", F.col("rank").cast("double").alias("rank"),
        r6(F.col("score").cast("double")).alias("score"),
    )


def token_set(spark, sf):
    return tokens.token_set(merges_of(spark, sf))


def special_tokens(spark, sf):
    return tokens.special_usage(table(spark, sf, "documents"), merges_of(spark, sf))


def id_to_token(spark, sf):
    return tokens.id_to_token(merges_of(spark, sf))


def token_to_id(spark, sf):
    return tokens.token_to_id(tokens.id_to_token(merges_of(spark, sf)))


def token_rank(spark, sf):
    return tokens.token_rank(merges_of(spark, sf))


def token_score(spark, sf):
    merges = merges_of(spark, sf)
    scored = tokens.token_score(tokens.id_to_token(merges), tokens.token_rank(merges))
    return scored.select("id", "token", r6(F.col("score").cast("double")).alias("score"))


def tokenizer_build(spark, sf):
    built = tokenizer_of(spark, sf).withColumn("score", r6(F.col("score").cast("double")))
    return built.withColumn("rank", F.col("rank").cast("double"))


def encode_corpus(spark, sf):
    return encoded_docs(spark, sf).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), as_csv(F.col("ids")).alias("ids")
    )


def encode_by_dictionary(spark, sf):
    """The rows of ``encode_corpus``, every distinct chunk merged once."""
    return dictionary.encode_by_dictionary(table(spark, sf, "documents"), tokenizer_of(spark, sf)).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), as_csv(F.col("ids")).alias("ids")
    )


def encode_bos_eos(spark, sf):
    turns = codec.encode_corpus(table(spark, sf, "conversations"), tokenizer_of(spark, sf))
    return codec.with_bos_eos(turns).select("conv_id", "turn", as_csv(F.col("ids")).alias("ids"))


def decode_corpus(spark, sf):
    model = tokenizer_of(spark, sf)
    encoded = codec.encode_corpus(table(spark, sf, "documents"), model)
    return codec.decode_corpus(encoded, model, ["doc_id"])


def token_listing(spark, sf):
    model = tokenizer_of(spark, sf)
    return codec.token_listing(encoded_docs(spark, sf, model), model, "lang")


def token_sequences(spark, sf):
    """Position, id and bytes of every token of the documents."""
    model = tokenizer_of(spark, sf)
    return codec.token_sequences(encoded_docs(spark, sf, model), model, ["doc_id"])


def next_token_pairs(spark, sf):
    return codec.next_token_pairs(encoded_docs(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        word_freq, symbol_freq, vocab_log, pair_counts, best_pair, apply_merge, bpe_train, bpe_resume, merge_log, merges_table,
        tokenizer_table, token_set, special_tokens, id_to_token, token_to_id, token_rank, token_score,
        tokenizer_build, encode_corpus, encode_by_dictionary, encode_bos_eos, decode_corpus, token_listing, token_sequences,
        next_token_pairs,
    )
}


def pairs_sql(source: str) -> str:
    return (
        "SELECT a, b, sum(freq)::BIGINT AS n FROM (SELECT unnest(l[1:len(l) - 1]) AS a, unnest(l[2:len(l)]) AS b, freq "
        f"FROM (SELECT string_split(s[2:len(s) - 1], '><') AS l, freq FROM {source})) GROUP BY a, b"
    )


def best_sql(source: str) -> str:
    return f"SELECT a, b, n FROM {source} ORDER BY n DESC, a || '20' || b LIMIT 1"


SYMBOLS = (
    f"words AS MATERIALIZED ({words_sql('documents')}), s0 AS MATERIALIZED "
    r"(SELECT regexp_replace(hex(encode(word)), '(..)', '<\1>', 'g') AS s, freq FROM words)"
)
MERGE = "replace(s, '<' || a || '><' || b || '>', '<' || a || b || '>')"


def trained_sql(steps: int) -> str:
    """Common tables up to ``merges(rank, a, b, freq)``: one unrolled step per merge."""
    parts = [SYMBOLS]
    for k in range(steps):
        parts.append(f"p{k} AS MATERIALIZED ({pairs_sql(f's{k}')})")
        parts.append(f"b{k} AS MATERIALIZED ({best_sql(f'p{k}')})")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT {MERGE} AS s, freq FROM s{k}, b{k})")
    union = " UNION ALL ".join(f"SELECT {k} AS rank, a, b, n AS freq FROM b{k}" for k in range(steps))
    parts.append(f"merges AS MATERIALIZED ({union})")
    return ", ".join(parts)


def resumed_sql(first: int, steps: int) -> str:
    """Merges 0 to first - 1 from the documents (s), applied to the grown words (g) as well, the others from these."""
    grown = f"SELECT word, sum(freq)::BIGINT AS freq FROM ({words_sql('documents')} UNION ALL {words_sql('conversations')}) GROUP BY word"
    parts = [SYMBOLS, f"grown AS MATERIALIZED ({grown})",
             r"g0 AS MATERIALIZED (SELECT regexp_replace(hex(encode(word)), '(..)', '<\1>', 'g') AS s, freq FROM grown)"]
    for k in range(steps):
        source = f"s{k}" if k < first else f"g{k}"
        parts.append(f"p{k} AS MATERIALIZED ({pairs_sql(source)})")
        parts.append(f"b{k} AS MATERIALIZED ({best_sql(f'p{k}')})")
        for name in ("s", "g")[k >= first :]:
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {MERGE} AS s, freq FROM {name}{k}, b{k})")
    union = " UNION ALL ".join(f"SELECT {k} AS rank, a, b, n AS freq FROM b{k}" for k in range(steps))
    return f"WITH {', '.join(parts)} {union}"


TRAINED = trained_sql(MERGES)
SPECIAL_ROWS = "VALUES (0, '<|bos|>'), (1, '<|eos|>'), (2, '<|pad|>'), (3, '<|unk|>')"
TOKENS = (
    f"{TRAINED}, core AS (SELECT hex(i) AS token FROM range(32, 127) r(i) UNION SELECT a || b FROM merges), "
    f"ids AS MATERIALIZED (SELECT i::INT AS id, hex(encode(t)) AS token FROM ({SPECIAL_ROWS}) v(i, t) UNION ALL "
    "SELECT (row_number() OVER (ORDER BY token) + 3)::INT, token FROM core), "
    "ranks AS (SELECT a || b AS token, min(rank)::INT AS rank FROM merges GROUP BY 1)"
)
SCORE = (
    "CASE WHEN rank IS NULL THEN '-inf'::DOUBLE ELSE "
    + q6("(-ln(rank + 1.0))::FLOAT::DOUBLE")
    + " END"
)


def encoded_sql(source: str) -> str:
    """Common tables up to ``enc``: ``source`` with the token list ``l`` of its text.

    Bytes outside the alphabet become the unknown token, then the merges apply in rank order.
    """
    parts = [
        TOKENS,
        "e0 AS MATERIALIZED (SELECT * EXCLUDE (text), array_to_string(list_transform(regexp_extract_all("
        "hex(encode(split_part(text, chr(0), 1))), '..'), lambda h: CASE WHEN h BETWEEN '20' AND '7E' "
        f"THEN '<' || h || '>' ELSE '<3C7C756E6B7C3E>' END), '') AS s FROM {source})",
    ]
    for k in range(MERGES):
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (s, a, b, n), {MERGE} AS s FROM e{k}, b{k})")
    parts.append(
        "enc AS MATERIALIZED (SELECT * EXCLUDE (s), string_split(s[2:len(s) - 1], '><') AS l "
        f"FROM e{MERGES} WHERE s <> '')"
    )
    return ", ".join(parts)


DOCS = encoded_sql("documents")
TURNS = encoded_sql("conversations")
TOKENIZER = f"SELECT id, token, id < 4 AS is_special, rank::DOUBLE AS rank, {SCORE} AS score FROM ids LEFT JOIN ranks USING (token)"

ORACLES = {
    "word_freq": words_sql("documents"),
    "symbol_freq": (
        f"WITH {SYMBOLS} SELECT replace(s[2:len(s) - 1], '><', ' ') AS syms, freq FROM s0"
    ),
    "vocab_log": f"{words_sql('documents')} ORDER BY freq DESC, hex(encode(word)) LIMIT {TOP_WORDS}",
    "pair_counts": f"WITH {SYMBOLS} {pairs_sql('s0')}",
    "best_pair": f"WITH {SYMBOLS}, p0 AS ({pairs_sql('s0')}) {best_sql('p0')}",
    "apply_merge": (
        f"WITH {trained_sql(1)} SELECT replace(s[2:len(s) - 1], '><', ' ') AS syms, sum(freq)::BIGINT AS freq "
        "FROM s1 GROUP BY 1"
    ),
    "bpe_train": f"WITH {TRAINED} SELECT rank, a, b, freq FROM merges",
    "bpe_resume": resumed_sql(MERGES // 2, MERGES),
    "merge_log": f"WITH {TRAINED} SELECT rank, a || ' ' || b AS pair, a || b AS token, freq FROM merges",
    "merges_table": f"WITH {TRAINED} SELECT rank, a, b, freq FROM merges",
    "tokenizer_table": f"WITH {TOKENS} {TOKENIZER}",
    "token_set": f"WITH {TOKENS} SELECT token FROM core",
    "special_tokens": (
        f"WITH {TOKENS} SELECT i::INT AS id, hex(encode(t)) AS token, "
        "(SELECT count(*) FROM documents WHERE contains(split_part(text, chr(0), 1), t)) AS n_docs, "
        f"hex(encode(t)) IN (SELECT token FROM core) AS is_core FROM ({SPECIAL_ROWS}) v(i, t)"
    ),
    "id_to_token": f"WITH {TOKENS} SELECT id, token FROM ids",
    "token_to_id": f"WITH {TOKENS} SELECT token, id FROM ids",
    "token_rank": f"WITH {TOKENS} SELECT token, rank FROM ranks",
    "token_score": f"WITH {TOKENS} SELECT id, token, {SCORE} AS score FROM ids LEFT JOIN ranks USING (token)",
    "tokenizer_build": f"WITH {TOKENS} {TOKENIZER}",
    "encode_corpus": (
        f"WITH {DOCS} SELECT doc_id, count(*) AS n_ids, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids FROM "
        "(SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM enc) JOIN ids USING (token) "
        "GROUP BY doc_id"
    ),
    "encode_bos_eos": (
        f"WITH {TURNS} SELECT conv_id, turn, '0,' || string_agg(id::VARCHAR, ',' ORDER BY pos) || ',1' AS ids FROM "
        "(SELECT conv_id, turn, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM enc) "
        "JOIN ids USING (token) GROUP BY conv_id, turn"
    ),
    "decode_corpus": (
        "SELECT doc_id, array_to_string(list_transform(regexp_extract_all("
        "hex(encode(split_part(text, chr(0), 1))), '..'), lambda h: CASE WHEN h BETWEEN '20' AND '7E' THEN h "
        "ELSE '3C7C756E6B7C3E' END), '') AS decoded FROM documents"
    ),
    "token_listing": (
        f"WITH {DOCS} SELECT lang, id, token, n FROM (SELECT lang, token, count(*) AS n FROM "
        "(SELECT lang, unnest(l) AS token FROM enc) GROUP BY lang, token) JOIN ids USING (token)"
    ),
    "token_sequences": (
        f"WITH {DOCS} SELECT doc_id, (pos - 1)::INT AS pos, id, token FROM (SELECT doc_id, unnest(l) AS token, "
        "generate_subscripts(l, 1) AS pos FROM enc) JOIN ids USING (token)"
    ),
    "next_token_pairs": (
        f"WITH {DOCS} SELECT x.id, y.id AS next_id, n FROM (SELECT a, b, count(*) AS n FROM "
        "(SELECT unnest(l[1:len(l) - 1]) AS a, unnest(l[2:len(l)]) AS b FROM enc) GROUP BY a, b) "
        "JOIN ids x ON x.token = a JOIN ids y ON y.token = b"
    ),
}
ORACLES["encode_by_dictionary"] = ORACLES["encode_corpus"]
