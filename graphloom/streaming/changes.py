"""File changes as a stream: coalescing, application to the graph, and windows over events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from graphloom.operators import graph
from graphloom.schema import CHANGES
from graphloom.sources.scan import included


def read_changes(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of change rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(CHANGES).options(**options).parquet(path)


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, type, old_path, content_hash) between two scans (path, content_hash) of a tree, one row each path.

    A new path whose content another path lost is a move from the smallest such path; each lost path moves to at most
    one new one, further new ones are creations. Repeated rows of a scan count once.
    """
    b, a = (df.groupBy("path").agg(F.max("content_hash").alias("content_hash")) for df in (before, after))
    both = b.withColumnRenamed("content_hash", "old_hash").join(a, "path", "full_outer")
    gone = both.where("content_hash is null").select("path", F.col("old_hash").alias("hash"))
    new = both.where("old_hash is null").select("path", F.col("content_hash").alias("hash"))
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("path"))
    moved = new.withColumn("n", rank).alias("a").join(gone.withColumn("n", rank).alias("g"), ["hash", "n"]).select(
        F.col("a.path").alias("path"), F.col("g.path").alias("old_path"), F.col("hash").alias("content_hash")
    )
    null = F.lit(None).cast("string")
    parts = [
        moved.select("path", F.lit("moved").alias("type"), "old_path", "content_hash"),
        new.join(moved.select("path"), "path", "left_anti").select("path", F.lit("created").alias("type"), null.alias("old_path"), F.col("hash").alias("content_hash")),
        gone.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti").select("path", F.lit("deleted").alias("type"), null.alias("old_path"), F.lit("").alias("content_hash")),
        both.where("old_hash <> content_hash").select("path", F.lit("modified").alias("type"), null.alias("old_path"), "content_hash"),
    ]
    return reduce(DataFrame.unionByName, parts)


def exploded_moves(changes: DataFrame) -> DataFrame:
    """A move becomes a deletion of the old path and a creation of the new one, in this order."""
    deleted = F.struct(F.col("old_path").alias("path"), F.lit("deleted").alias("type"), F.lit("").alias("content_hash"), F.lit(0).alias("part"))
    created = F.struct("path", F.lit("created").alias("type"), F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.lit(1).alias("part"))
    own = F.struct("path", "type", F.when(F.col("type") == "deleted", "").otherwise(F.coalesce("content_hash", F.lit(""))).alias("content_hash"), F.lit(0).alias("part"))
    parts = F.when(F.col("type") == "moved", F.array(deleted, created)).otherwise(F.array(own))
    rest = [c for c in changes.columns if c not in ("path", "type", "content_hash", "old_path")]
    return changes.select(*rest, F.explode(parts).alias("__c")).select(*rest, "__c.path", "__c.type", "__c.content_hash", "__c.part")


def coalesced(changes: DataFrame, keys: list[str] | None = None, filtered: bool = True) -> DataFrame:
    """One event per path of a batch: the last one, where a modification with the hash of the event before it is none.

    ``first_seen`` orders the result as the paths were first seen. ``keys`` (such as a batch number) set batches apart.
    """
    keys = keys or []
    rows = exploded_moves(changes).where("path is not null")
    if filtered:
        rows = rows.where(included(F.col("path")))
    w = Window.partitionBy(*keys, "path").orderBy("seq", "part")
    rows = rows.withColumn("before", F.lag("content_hash").over(w))
    same = (F.col("type") == "modified") & F.col("before").isNotNull() & (F.col("before") == F.col("content_hash"))
    at = F.struct("seq", "part")
    last = F.max_by(F.struct("type", "content_hash", "seq"), F.when(~same, at))
    return rows.groupBy(*keys, "path").agg(last.alias("e"), F.min("seq").alias("first_seen")).select(*keys, "path", "e.type", "e.content_hash", "e.seq", "first_seen")


def change_stats(batch: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return batch.groupBy(*(keys or [])).agg(
        F.count_if(F.col("type") != "deleted").alias("updated"), F.count_if(F.col("type") == "deleted").alias("deleted"), F.count("*").alias("total")
    )


def apply_changes(nodes: DataFrame, edges: DataFrame, batch: DataFrame, fresh: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The graph after a batch: what changed files wrote is pruned, then their new nodes and edges are added."""
    kept_nodes, kept_edges = graph.prune(nodes, edges, batch.select(F.col("path").alias("provenance")))
    new_nodes, new_edges = fresh
    return (
        graph.latest(kept_nodes.unionByName(new_nodes), ["id"], F.struct("provenance", "seq")),
        graph.latest(kept_edges.unionByName(new_edges), ["source", "target"], F.struct("provenance", "seq")),
    )


class GraphWriter:
    """Keeps a graph up to date from micro-batches: each writes a version named by its number, so that a batch that runs
    again after a failure replaces its own version and nothing is applied twice."""

    def __init__(self, spark: SparkSession, path: str, read_files: Callable[[DataFrame], tuple[DataFrame, DataFrame]]):
        self.spark, self.path, self.read_files = spark, path.rstrip("/"), read_files

    def version(self, n: int) -> tuple[DataFrame, DataFrame]:
        return self.spark.read.parquet(f"{self.path}/v{n:09d}/nodes"), self.spark.read.parquet(f"{self.path}/v{n:09d}/edges")

    def start(self, nodes: DataFrame, edges: DataFrame) -> None:
        self._write(0, nodes, edges)

    def _write(self, n: int, nodes: DataFrame, edges: DataFrame) -> None:
        nodes.write.mode("overwrite").parquet(f"{self.path}/v{n:09d}/nodes")
        edges.write.mode("overwrite").parquet(f"{self.path}/v{n:09d}/edges")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        nodes, edges = self.version(batch_id)
        changed = coalesced(batch)
        fresh = self.read_files(changed.where("type <> 'deleted'"))
        self._write(batch_id + 1, *apply_changes(nodes, edges, changed, fresh))


def follow(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "300 milliseconds") -> DataStreamWriter:
    """A query that hands each interval's changes to ``sink``."""
    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def isolated(*sinks: Callable[[DataFrame, int], None], on_error: Callable[[Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """One sink out of several; an error of one does not keep the batch from the others."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                try:
                    sink(batch, batch_id)
                except Exception as e:  # noqa: BLE001
                    if on_error:
                        on_error(e)
        finally:
            batch.unpersist()

    return run


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and keys; rows later than ``late`` behind the newest are dropped by a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def unseen(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each content of a path once within the watermark, across batches."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "content_hash"])
