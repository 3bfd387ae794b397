"""Shared by the registered queries: table access, rounding and SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Six places; Spark's rounding never leaves a negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), 6)


def q6(expression: str) -> str:
    return f"(CASE WHEN abs({expression}) < 5e-7 THEN 0.0::DOUBLE ELSE round({expression}, 6) END)"


def cells(df: DataFrame, key: str, vec: str, value: str = "val", rounded: bool = True) -> DataFrame:
    """A vector column in long form."""
    out = df.select(key, F.posexplode_outer(vec).alias("j", value)).filter("j is not null")
    return out.withColumn(value, r6(value)) if rounded else out


SPLIT_SQL = r"regexp_split_to_array(split_part(text, chr(0), 1), '[ \t\n\x0B\f\r]+')"


def words_sql(source: str) -> str:
    """Word counts of a table with a text column."""
    return (
        f"SELECT word, count(*) AS freq FROM (SELECT unnest({SPLIT_SQL}) AS word FROM {source}) "
        "WHERE word <> '' GROUP BY word"
    )


CELLS_SQL = (
    "cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j, "
    "unnest(embedding)::DOUBLE AS x FROM embeddings)"
)


def lehmer_sql(k: str, seed: int) -> str:
    """Draw ``k`` of the generator, by binary powering."""
    factor, x = 48271, f"{seed}::BIGINT"
    for bit in range(31):
        x = f"({x} * (CASE WHEN (({k}) & {1 << bit}) <> 0 THEN {factor} ELSE 1 END) % 2147483647)"
        factor = factor * factor % 2147483647
    return x


def xavier_sql(name: str, rows: int, cols: int, seed: int) -> str:
    """A CTE ``name(i, j, w)`` with a random matrix."""
    draw = lehmer_sql("k", seed)
    return (
        f"{name} AS MATERIALIZED (SELECT ((k - 1) // {cols})::INT AS i, ((k - 1) % {cols})::INT AS j, "
        f"(2.0 * ({draw} / 2147483647.0::DOUBLE) - 1.0) * sqrt(6.0::DOUBLE / {rows + cols}) AS w "
        f"FROM (SELECT unnest(range(1, {rows * cols + 1})) AS k))"
    )
