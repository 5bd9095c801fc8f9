"""Work-item ledger: which items still need processing, over runs that may fail, overlap or come late.

An item is a key with a version (a content hash). Its ledger rows are immutable events: ``leased`` (a run took it, until
a deadline, under a fencing token that only grows), ``done`` (the run recorded the version it processed) and
``expired`` (the run failed or stopped). The state of an item is a fold over its events, so replayed, repeated and late
events change nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "item string, token long, event string, version string, deadline long, seq long"


def current_versions(rows: DataFrame, item: str, version: str, order: list[Column]) -> DataFrame:
    """One row (item, version) per item: its version with the greatest ``order``; ties go to the greatest version."""
    return (
        rows.where(F.col(item).isNotNull())
        .groupBy(F.col(item).alias("item"))
        .agg(F.max_by(version, F.struct(*order, F.col(version))).alias("version"))
    )


def fold(events: DataFrame, now: Column | None = None) -> DataFrame:
    """State of each item: (item, state, version, token).

    ``done`` events of a run count only under the item's greatest done token: a writer with a smaller token is stale and
    rejected, whenever its row arrives. Within one token the last row (seq, then version) stands, which absorbs
    retries. A lease newer than that token keeps the item leased until its deadline passes or it is marked expired;
    then the item is pending again. The fold is one aggregate with map-side combination, so an item with very many
    events costs one row a task. No events give no rows.
    """
    done, at = F.col("event") == "done", F.struct("token", "seq", "version")
    ended = F.col("event").isin("done", "expired")
    state = events.groupBy("item").agg(
        F.max_by("version", F.when(done, at)).alias("version"),
        F.max(F.when(done, F.col("token"))).alias("token"),
        F.max(F.when(ended, F.col("token"))).alias("ended"),
        F.max(F.when(F.col("event") == "leased", F.struct("token", "deadline"))).alias("lease"),
    )
    newer = F.col("lease.token") > F.coalesce(F.greatest("token", "ended"), F.lit(-1))
    live = F.lit(True) if now is None else F.coalesce(F.col("lease.deadline") > now, F.lit(True))
    return state.select(
        "item",
        F.when(F.coalesce(newer & live, F.lit(False)), "leased")
        .when(F.col("token").isNotNull(), "done")
        .otherwise("pending")
        .alias("state"),
        "version",
        "token",
    )


def pending(current: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (item, version) of the current items to take up: new, or of another version than the one recorded as done.

    Items under a live lease are left to their holder. A null current version is pending until recorded as such.
    """
    known = state.select("item", "state", F.col("version").alias("seen"), "token")
    same = F.col("token").isNotNull() & F.col("version").eqNullSafe(F.col("seen"))
    held = F.coalesce(F.col("state") == "leased", F.lit(False))
    return current.join(known, "item", "left").where(~same & ~held).select("item", "version")


def run_events(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Ledger events out of a log of runs: log (run_id, file_id, content_hash, log_seq), runs (run_id, status).

    The run's id is its fencing token. Rows of completed runs are done; rows of failed, aborted or unknown runs are
    leases that expired. The runs are few and fixed in number, and their side is checked by Spark's own size limit.
    """
    completed = runs.groupBy("run_id").agg(F.max(F.col("status") == "completed").alias("ok"))
    return (
        log.select("run_id", "file_id", "content_hash", "log_seq")
        .where("file_id is not null and run_id is not null")
        .join(completed, "run_id", "left")
        .select(
            F.col("file_id").alias("item"),
            F.col("run_id").cast("long").alias("token"),
            F.when(F.col("ok"), "done").otherwise("expired").alias("event"),
            F.col("content_hash").alias("version"),
            F.lit(None).cast("long").alias("deadline"),
            F.col("log_seq").alias("seq"),
        )
    )


def essential(events: DataFrame) -> DataFrame:
    """The events that decide the state of each item, three at most: its last done one, the last lease, the last ending.
    Folding them gives what folding all gives, together with any later or repeated event."""
    last = lambda cond: F.max_by(F.struct(*events.columns), F.when(cond, F.struct("token", "seq", "version")))
    kind = F.col("event")
    picked = events.groupBy("item").agg(
        F.array_compact(F.array(last(kind == "done"), last(kind == "leased"), last(kind.isin("done", "expired")))).alias("e")
    )
    return picked.select(F.explode(F.array_distinct("e")).alias("e")).select("e.*").select(*events.columns)


class Ledger:
    """A ledger kept as Parquet below ``path``, one folder for each token and kind of event.

    A token is claimed by creating its file, which only one of several coordinators can do. A folder's name is
    determined by the token, so a retried write replaces its own earlier attempt and nothing else. ``compact`` keeps the
    history that each run reads as small as the number of items.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENTS).option("recursiveFileLookup", True).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], EVENTS)
            raise

    def _write(self, rows: DataFrame, token: int, event: str, deadline: int | None = None) -> None:
        out = rows.select(
            "item", F.lit(token).cast("long").alias("token"), F.lit(event).alias("event"), "version",
            F.lit(deadline).cast("long").alias("deadline"), F.lit(0).cast("long").alias("seq"),
        )
        out.write.mode("overwrite").parquet(f"{self.path}/{event}-{token:012d}")

    def next_token(self) -> int:
        """A token greater than all before, claimed for this caller alone."""
        place, fs = self._place("_tokens")
        claimed = [int(s.getPath().getName()) for s in fs.listStatus(place)] if fs.exists(place) else []
        token = max(claimed, default=0) + 1
        fs.mkdirs(place)
        while not self._claim(fs, f"_tokens/{token:012d}"):
            token += 1
        return token

    def _claim(self, fs, name: str) -> bool:
        """Create a file unless it is there; for local folders by the system's own exclusive open."""
        place, _ = self._place(name)
        uri = fs.makeQualified(place).toUri()
        try:
            if uri.getScheme() == "file":
                os.close(os.open(uri.getPath(), os.O_CREAT | os.O_EXCL))
            else:
                fs.create(place, False).close()
        except FileExistsError:
            return False
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def compact(self) -> None:
        """Write the essential events to one folder, then remove the folders they came from, but for leases that are still
        read by their token. A run that is broken off in between leaves events twice, which changes nothing. Runs beside
        others: what they write meanwhile is in folders that are not touched."""
        place, fs = self._place("")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        held = [n for n in names if not n.startswith("_")]
        if not held:
            return
        rows = self.spark.read.schema(EVENTS).parquet(*(f"{self.path}/{n}" for n in held))
        taken = rows.where("event = 'leased'").select("item", F.col("token").alias("by"))
        live = fold(rows).where("state = 'leased'").join(taken, "item").where(F.col("by") > F.coalesce("token", F.lit(-1)))
        open_tokens = {r.by for r in live.select("by").distinct().collect()}  # one for each run under way
        essential(rows).write.mode("overwrite").parquet(f"{self.path}/state-{self.next_token():012d}")
        for n in held:
            if not (n.startswith("leased-") and int(n.split("-")[1]) in open_tokens):
                fs.delete(self._place(n)[0], True)

    def lease(self, current: DataFrame, now: int, ttl: int) -> tuple[int, DataFrame]:
        """Take up all pending items: their token and rows (item, version)."""
        token = self.next_token()
        self._write(pending(current, fold(self.events(), F.lit(now))), token, "leased", now + ttl)
        return token, self.leased(token)

    def leased(self, token: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/leased-{token:012d}").select("item", "version")

    def output_path(self, base: str, token: int) -> str:
        """Where the run with ``token`` writes its results: the same place at each retry."""
        return f"{base.rstrip('/')}/token={token:012d}"

    def commit(self, token: int) -> None:
        """Record the items of a lease as done, each in the version that was leased.

        Items that a later token has leased or finished meanwhile are kept out: their old holder is fenced off.
        """
        own = self.leased(token)
        later = self.events().where(F.col("token") > token).select("item").distinct()
        self._write(own.join(later, "item", "left_anti"), token, "done")

    def expire(self, token: int) -> None:
        """Give the items of a failed run back."""
        self._write(self.leased(token), token, "expired")
