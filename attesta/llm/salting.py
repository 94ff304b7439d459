"""Joins in which one key of the left side may hold a great part of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import scratch

#: Rows of one key that one task takes at most, about.
KEY_ROWS = 2048


def hot_keys(counts: DataFrame, key: str, n: str = "n", rows: int = KEY_ROWS) -> DataFrame:
    """(key, parts) of keys with over ``rows`` rows, stored: there are no more of them than the rows of all keys divided by ``rows``."""
    parts = F.ceil(F.col(n) / rows).cast("int").alias("_parts")
    return scratch.save(counts.where(F.col(n) > rows).select(F.col(key).alias("_hot"), parts), "hot")


def spread(rows: DataFrame, hot: DataFrame, key: str, *by: str) -> DataFrame:
    """``rows`` with ``_salt``: which part of its key's rows each belongs to, by a hash of ``by``."""
    joined = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    return joined.withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_hot", "_parts")


def repeated(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``rows``, one for each part of its key's rows, with ``_salt``."""
    joined = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    return joined.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")


def salted_join(left: DataFrame, right: DataFrame, key: str, *by: str, how: str = "left", rows: int = KEY_ROWS) -> DataFrame:
    """``left`` joined with ``right`` (one stored row a key, with ``n``, the rows that the key has on the left) on ``key``; keys with many rows are dealt by a hash of ``by``."""
    hot = hot_keys(right, key, rows=rows)
    if hot.isEmpty():
        return left.join(right, key, how)
    return spread(left, hot, key, *by).join(repeated(right, hot, key), [key, "_salt"], how).drop("_salt")
