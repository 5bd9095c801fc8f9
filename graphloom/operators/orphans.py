"""References whose key leads nowhere, to a deleted row, or to a row that came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.bloom import KeyFilter
from graphloom.operators.skew import join_on_unique
from graphloom.runtime import Scratch, reference_key


def epoch(col: Column) -> Column:
    """Epoch seconds; 0 means never."""
    return F.when(col != 0, col.cast("long"))


def parent_keys(parents: DataFrame, key: str, created: Column, deleted: Column) -> DataFrame:
    """One row per key: whether any row with it is alive, and the earliest creation among the living."""
    rows = parents.select(reference_key(F.col(key)).alias("key"), created.alias("c"), deleted.alias("d"))
    return (
        rows.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max(F.col("d").isNull()).alias("alive"), F.min(F.when(F.col("d").isNull(), F.col("c"))).alias("born"))
    )


def references(rows: DataFrame, row_id: Column, key: str, created: Column) -> DataFrame:
    """Distinct references (row_id, key, at). Null and blank keys are none."""
    return (
        rows.select(row_id.cast("string").alias("row_id"), reference_key(F.col(key)).alias("key"), created.alias("at"))
        .where(F.col("key").isNotNull())
    )


def orphans(refs: DataFrame, parents: DataFrame, expected_keys: int) -> DataFrame:
    """Rows (row_id, key, at, reason) of the references that lead nowhere.

    A Bloom filter of all parent keys, deleted or not, proves most orphans without moving them; its size follows
    ``expected_keys``. References are normalised and tested once and written with the outcome. Only what the filter lets
    through is joined exactly (hot keys apart, see ``join_on_unique``), which finds its false positives, deleted parents
    and parents that came after the reference. A reference without a time is never late; an undeleted parent without a
    time came first. Repeated references are listed once. Empty tables: no parents makes every reference missing, no
    references gives no rows.
    """
    scratch = Scratch(refs.sparkSession, "orphans")
    known = scratch.put(parents)
    h = F.xxhash64("key")
    path = scratch.write(KeyFilter(known, h, expected_keys).marked(refs.select("row_id", "key", "at"), h, "maybe"), ["maybe"])
    part = lambda maybe: scratch.read(f"{path}/maybe={maybe}", refs.select("row_id", "key", "at").schema) if scratch.exists(f"{path}/maybe={maybe}") else refs.select("row_id", "key", "at").limit(0)
    certain = part("false").withColumn("reason", F.lit("missing"))
    checked = join_on_unique(part("true"), known, "key", scratch=scratch).withColumn(
        "reason",
        F.when(F.col("alive").isNull(), "missing")
        .when(~F.col("alive"), "deleted")
        .when(F.col("born") > F.col("at"), "late"),
    )
    found = checked.where("reason is not null").select("row_id", "key", "at", "reason")
    return certain.unionByName(found).distinct()


def report(refs: DataFrame, found: DataFrame) -> DataFrame:
    """Per month of creation: references and orphans by reason. Month is null where a reference has no time."""
    month = F.date_format(F.timestamp_seconds("at"), "yyyy-MM").alias("month")
    total = refs.distinct().groupBy(month).agg(F.count("*").alias("refs"))
    bad = found.groupBy(month).agg(
        *(F.count_if(F.col("reason") == r).alias(r) for r in ("missing", "deleted", "late"))
    )
    joined = total.alias("t").join(bad.alias("b"), F.col("t.month").eqNullSafe(F.col("b.month")), "left")
    return joined.select(
        "t.month", "refs", *(F.coalesce(F.col(r), F.lit(0)).alias(r) for r in ("missing", "deleted", "late"))
    )
