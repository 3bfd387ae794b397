"""From a corpus to a tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexivec.operators import bpe, tokens, vocab
from lexivec.operators.corpus import corpus_scan


def learn_merges(docs: DataFrame, merges: int = bpe.DEFAULT_MERGES, text: str = "text") -> DataFrame:
    """Corpus to word counts to symbols to ranked merges."""
    words = vocab.word_freq(corpus_scan(docs, text), text)
    return bpe.bpe_train(vocab.symbol_freq(words), merges)


def learn_tokenizer(docs: DataFrame, merges: int = bpe.DEFAULT_MERGES, text: str = "text") -> DataFrame:
    """Corpus to a full tokenizer table."""
    return tokens.tokenizer_build(learn_merges(docs, merges, text))
