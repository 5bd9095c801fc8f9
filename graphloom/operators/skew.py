"""Equi-join of a skewed side with a side of unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import Scratch, shuffle_partitions


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """(key) of the keys with more rows than a quarter of a mean partition, and more than a few thousand."""
    parts = shuffle_partitions(left.sparkSession)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    least = counts.agg((F.sum("__n") / F.lit(4 * parts)).alias("__least"))
    return counts.crossJoin(F.broadcast(least)).where((F.col("__n") >= F.col("__least")) & (F.col("__n") > 10_000)).select(key)  # one row


def join_on_unique(left: DataFrame, unique: DataFrame, key: str, how: str = "left", scratch: Scratch | None = None) -> DataFrame:
    """``left`` joined with ``unique`` (one row per key) where one key of ``left`` may hold any share of its rows.

    Keys with more rows than a quarter of a mean partition are hot; by counting there are at most four times as many of
    them as partitions, so their rows of ``unique`` are broadcast with a proven bound. All other keys are shuffled.
    The counts come from a map-side combined aggregate. Null keys match nothing. ``how`` is left, inner, left_semi or
    left_anti. With ``scratch`` the hot keys are counted at once and kept there, and where there are none the join is a
    plain one; without, they are part of the plan.
    """
    hot = hot_keys(left, key)
    if scratch is not None:
        hot = scratch.put(hot)
        if hot.isEmpty():
            return left.join(unique, key, how)
    hot = F.broadcast(hot)
    hot_left, cold_left = left.join(hot, key, "left_semi"), left.join(hot, key, "left_anti")
    hot_right = F.broadcast(unique.join(hot, key, "left_semi"))
    return hot_left.join(hot_right, key, how).unionByName(cold_left.join(unique, key, how))
