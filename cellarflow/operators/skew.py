"""Joins that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS_A_TASK = 4_000_000


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """Inner join on ``key``; keys that would give many pairs are cut into parts by the hash of left's ``spread``.

    The number of parts of a key is its pairs over ``pairs_a_task``; the right rows of such a key are repeated for
    each part. Keys are counted by an aggregation that is combined before its shuffle, and the list of hot keys, at
    most (rows / sqrt(pairs_a_task)) of them, is joined back without a broadcast hint. The result has left's columns,
    then right's without ``key``. Null keys join nothing; both sides may be empty.
    """
    counts = (
        left.groupBy(key).agg(F.count("*").alias("__l"))
        .join(right.groupBy(key).agg(F.count("*").alias("__r")), key)
        .where(F.col("__l") * F.col("__r") > pairs_a_task)
        .select(key, F.ceil(F.col("__l") * F.col("__r") / F.lit(float(pairs_a_task))).cast("int").alias("__parts"))
    )
    parts: Column = F.coalesce("__parts", F.lit(1))
    spread_left = left.join(counts, key, "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__parts")
    repeated = right.join(counts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return spread_left.join(repeated, [key, "__part"]).drop("__part")


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: str, rows_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """Left join on ``key`` with a table that has each key once; keys of many left rows are cut by the hash of ``spread``.

    The right row of such a key is repeated for each part. Rows without a match, null keys included, keep nulls. The
    result has left's columns, then right's without ``key``; both sides may be empty.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("__l")).where(F.col("__l") > rows_a_task).select(key, F.ceil(F.col("__l") / F.lit(float(rows_a_task))).cast("int").alias("__parts"))
    parts: Column = F.coalesce("__parts", F.lit(1))
    spread_left = left.join(counts, key, "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__parts")
    repeated = right.join(counts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return spread_left.join(repeated, [key, "__part"], "left").drop("__part")
