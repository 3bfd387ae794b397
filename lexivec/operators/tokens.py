"""Token tables built from learned merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.functions import text as tx

# The special tokens in id order.
SPECIALS = ("<|bos|>", "<|eos|>", "<|pad|>", "<|unk|>")


def special_tokens(spark: SparkSession, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """The special tokens with the ids they always hold."""
    rows = [(i, t.encode().hex().upper()) for i, t in enumerate(specials)]
    return spark.createDataFrame(rows, "id int, token string")


def base_alphabet(spark: SparkSession) -> DataFrame:
    """The printable bytes."""
    codes = spark.range(tx.PRINTABLE_FIRST, tx.PRINTABLE_LAST + 1)
    return codes.select(F.hex("id").alias("token"))


def token_set(merges: DataFrame) -> DataFrame:
    """Base alphabet and merged tokens, distinct, in hex."""
    return (
        base_alphabet(merges.sparkSession)
        .union(merges.select(F.concat("a", "b").alias("token")))
        .distinct()
    )


def id_to_token(merges: DataFrame, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """Specials first, then the core tokens in byte order; the id is the position.

    One task numbers the tokens: merges are limited by their symbols (``symbols.MOST_MERGES``).
    """
    core = token_set(merges)
    numbered = core.withColumn("rn", F.row_number().over(Window.orderBy("token")))
    numbered = numbered.select((F.col("rn") - 1 + len(specials)).cast("int").alias("id"), "token")
    return special_tokens(merges.sparkSession, specials).union(numbered)


def token_to_id(tokens: DataFrame) -> DataFrame:
    """The inverse map; a token with two ids fails the build."""
    doubled = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bad = doubled.limit(1).collect()
    if bad:
        raise ValueError(f"token {bad[0]['token']} has more than one id")
    return tokens.select("token", "id")


def token_rank(merges: DataFrame) -> DataFrame:
    """Merged token to the first merge that made it."""
    return merges.groupBy(F.concat("a", "b").alias("token")).agg(F.min("rank").alias("rank"))


def token_score(tokens: DataFrame, ranks: DataFrame) -> DataFrame:
    """Score ``-ln(rank + 1)`` in single precision; unranked tokens score minus infinity."""
    score = F.when(F.col("rank").isNull(), float("-inf")).otherwise(-F.log(F.col("rank") + 1.0))
    return tokens.join(ranks, "token", "left").select(
        "id", "token", "rank", score.cast("float").alias("score")
    )


def tokenizer_build(merges: DataFrame, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """The whole tokenizer as one table ``(id, token, is_special, rank, score)``."""
    tokens = id_to_token(merges, specials)
    token_to_id(tokens)
    return token_score(tokens, token_rank(merges)).select(
        "id", "token", (F.col("id") < len(specials)).alias("is_special"), "rank", "score"
    )


def special_usage(docs: DataFrame, merges: DataFrame, text: str = "text") -> DataFrame:
    """Each special token, how many documents spell it out, and whether it is a core token too."""
    spark = docs.sparkSession
    counts = docs.agg(
        *[F.count_if(F.contains(tx.before_nul(F.col(text)), F.lit(t))).alias(f"s{i}") for i, t in enumerate(SPECIALS)]
    )
    pairs = [F.struct(F.lit(i).alias("id"), F.col(f"s{i}").alias("n_docs")) for i in range(len(SPECIALS))]
    usage = counts.select(F.inline(F.array(*pairs)))
    clash = token_set(merges).withColumn("is_core", F.lit(True))
    return (
        special_tokens(spark)
        .join(usage, "id")
        .join(clash, "token", "left")
        .select("id", "token", "n_docs", F.coalesce("is_core", F.lit(False)).alias("is_core"))
    )
