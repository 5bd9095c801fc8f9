"""Session helpers: table access, shared scratch space, sizes.

Iterative operators cut their lineage by writing Parquet below the folder named by ``spark.checkpoint.dir``; every
executor sees that folder, so a lost executor costs one task and never the state of a loop.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share. Taken from the session; made only in local mode when the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", Path(path).as_uri())
    spark.sparkContext.setCheckpointDir(Path(path).as_uri())
    return Path(path).as_uri()


class Scratch:
    """Named intermediate tables of one operator run, below the shared folder.

    ``put`` writes and reads back (lineage ends there, file statistics are kept for the planner), ``drop`` removes a
    table no later plan reads. What the returned DataFrame still reads is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:05d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def write(self, df: DataFrame, folders: list[str]) -> str:
        """Write with a subfolder for each value of some columns; the path."""
        self.n += 1
        path = f"{self.root}/{self.n:05d}"
        df.write.mode("overwrite").partitionBy(*folders).parquet(path)
        return path

    def read(self, path: str, schema: str) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm, jsc = self.spark._jvm, self.spark._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(col):
    """Without outer white space of any Unicode kind."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def reference_key(col):
    """A key as references are compared: outer white space and letter case do not matter; null when blank."""
    key = F.lower(trimmed(col))
    return F.when(key != "", key)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores, before work in Python.

    A table of few files or row groups would else be worked on by few tasks. Large tables have more partitions than that
    and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
