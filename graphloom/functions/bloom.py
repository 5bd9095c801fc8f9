"""Spark's own Bloom filter as a declarative aggregate and predicate.

Spark plans these two expressions itself for runtime join filters but gives them no SQL name; here they become Columns,
so that a filter is built by a partially merged aggregate, reaches the executors as a scalar subquery of the same plan
and is tested inside generated code. This needs the classic JVM session; there is no form for remote (Connect) sessions.
One filter is bounded: Spark caps it at ``spark.sql.optimizer.runtime.bloomFilter.maxNumBits`` (8 MB by default).
``KeyFilter`` therefore grows with the keys, by one filter for each range of their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 12
MAX_BITS = 1 << 26
#: Filters that one pass over the tested rows holds: 128 MB at most.
AT_ONCE = 16


def _jvm():
    jvm = SparkSession.getActiveSession()._jvm
    return jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.classic.ExpressionUtils


def bloom_agg(hashed: Column, keys: int) -> Column:
    """Aggregate of 64-bit hashes into a filter sized for ``keys`` of them."""
    exprs, utils = _jvm()
    keys = max(1000, min(keys, MAX_BITS // BITS_PER_KEY))
    size = [utils.expression(F.expr(f"{n}L")._jc) for n in (keys, keys * BITS_PER_KEY)]
    agg = exprs.aggregate.BloomFilterAggregate(utils.expression(hashed._jc), *size)
    return Column(utils.column(agg.toAggregateExpression()))


def might_contain(filter_of: DataFrame, hashed: Column) -> Column:
    """Whether the one-row, one-column ``filter_of`` may hold ``hashed``: false is certain, null means an empty filter."""
    exprs, utils = _jvm()
    test = exprs.BloomFilterMightContain(utils.expression(filter_of.scalar()._jc), utils.expression(hashed._jc))
    return F.coalesce(Column(utils.column(test)), F.lit(False))


class KeyFilter:
    """Filters of the hashes of a key column, one of MAX_BITS at most for each range of hashes, so that their density, and
    with it the share of false positives (about 1 in 300), is the same however many keys there are."""

    def __init__(self, keys: DataFrame, hashed: Column, expected: int):
        self.ranges = max(1, -(-expected * BITS_PER_KEY // MAX_BITS))
        self.keys = keys.select(hashed.alias("h"))
        self.each = -(-expected // self.ranges)

    def _range(self, hashed: Column) -> Column:
        return F.pmod(F.hash(hashed), F.lit(self.ranges))

    def marked(self, rows: DataFrame, hashed: Column, name: str) -> DataFrame:
        """``rows`` with a column: false where the key is certainly none of the filter's.

        Of many ranges AT_ONCE are tested in one pass; each pass takes the rows of its ranges, so every row is tested
        once and no row is moved.
        """
        out = None
        for first in range(0, self.ranges, AT_ONCE):
            own, test = range(first, min(first + AT_ONCE, self.ranges)), None
            for r in own:
                keys = self.keys if self.ranges == 1 else self.keys.where(self._range(F.col("h")) == r)
                one = might_contain(keys.select(bloom_agg(F.col("h"), self.each).alias("bloom")), hashed)
                test = one if self.ranges == 1 else (F if test is None else test).when(self._range(hashed) == r, one)
            part = rows if self.ranges <= AT_ONCE else rows.where(self._range(hashed).between(own[0], own[-1]))
            part = part.withColumn(name, F.coalesce(test, F.lit(False)))
            out = part if out is None else out.unionByName(part)
        return out
