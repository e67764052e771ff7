"""Joins of a table with one row a key of another, with hot keys spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys at most; rows that make a key hot at least.
MOST, LEAST = 1 << 16, 64


def spread_join(big: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of big with side, which has one row a key and in column n the number of big's rows with it (total: of all keys); n is dropped.

    A key with more than total / MOST rows (LEAST at least) is hot: its rows of big are dealt to several tasks by a hash of the row and of the
    partition that it comes from (so that equal rows part, too), and its row of side goes to each of them. Big's rows learn it from a broadcast of the hot keys, MOST of them at most. Null keys match nothing.
    """
    limit = max(LEAST, -(-total // MOST))
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) / limit))
    hot = side.where(F.col(n) > limit).select(key, parts.alias("_parts"))
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns], F.spark_partition_id()), F.col("_parts"))).otherwise(0)
    left = big.join(F.broadcast(hot), key, "left").withColumn("_salt", salt.cast("long")).drop("_parts")
    right = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(n)
    return left.join(right, [key, "_salt"]).drop("_salt")
