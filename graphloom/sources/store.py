"""Where graphs, findings and logs are kept."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import latest
from graphloom.schema import EDGES, NODES

#: Tables of the relational store and their columns.
TABLES = {
    "projects": "id string, name string, root_path string, framework string, framework_confidence double, language string, index_status string, last_indexed_at long, created_at long, updated_at long, deleted_at long",
    "endpoints": "id string, project_id string, method string, path string, handler string, file_path string, line_start int, line_end int, framework string, middleware array<string>, decorators array<string>, metadata map<string,string>, status string, last_analyzed_at long, created_at long, updated_at long, deleted_at long",
    "file_index": "id string, project_id string, file_path string, content_hash string, language string, symbols_count int, imports_count int, line_count int, last_parsed_at long, created_at long, updated_at long",
    "analysis_reports": "id string, project_id string, endpoint_id string, type string, goal string, confidence double, latency_ms long, iterations int, status string, created_at long, completed_at long, deleted_at long",
    "token_usage_log": "id string, report_id string, provider string, model string, prompt_tokens int, completion_tokens int, total_tokens int, estimated_cost_usd double, context_size_bytes long, compressed_size_bytes long, compression_ratio double, latency_ms int, created_at long",
}


class Store:
    """Parquet tables below one folder: append for logs, overwrite for the rest, upsert by key as a new version that takes the
    place of the old one when it is complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> None:
        for name, columns in TABLES.items():
            self.write(name, self.spark.createDataFrame([], columns))

    def write(self, name: str, rows: DataFrame, mode: str = "overwrite") -> None:
        rows.write.mode(mode).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        self.write(name, rows, "append")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace those of the same keys, and are added where there are none; of several new ones the greatest stands.

        Null keys are left out of ``rows``. A writer that fails leaves the table as it was.
        """
        new = latest(rows.dropna(subset=keys), keys, F.lit(0))
        old = self.read(name).join(new.select(*keys), keys, "left_anti").select(*rows.columns)
        self._replace(name, old.unionByName(new))

    def delete(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        self._replace(name, self.read(name).join(rows.select(*keys).distinct(), keys, "left_anti"))

    def _replace(self, name: str, rows: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        table, fresh, former = (path(f"{self.path}/{p}{name}") for p in ("", "_fresh_", "_former_"))
        rows.write.mode("overwrite").parquet(fresh.toString())
        fs.delete(former, True)
        fs.rename(table, former)
        fs.rename(fresh, table)
        fs.delete(former, True)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The native form: a Parquet table each."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """None where there is no readable graph."""
    try:
        return spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges")
    except Exception:  # noqa: BLE001
        return None


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One document {nodes, edges, endpoint_registry} for exchange with tools that read such files; for graphs that fit
    one machine."""
    from graphloom.operators.graph import registry

    rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).toLocalIterator()]
    names = {r.name: r.id for r in registry(nodes).toLocalIterator()}
    Path(path).write_text(json.dumps({"nodes": rows(nodes), "edges": rows(edges), "endpoint_registry": names}))


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The graph of such a document; None if it is missing or no JSON."""
    doc = spark.read.option("multiLine", True).schema(f"nodes array<struct<{_struct(NODES)}>>, edges array<struct<{_struct(EDGES)}>>")
    try:
        got = doc.json(path)
        if got.where("nodes is not null").isEmpty():
            return None
    except Exception:  # noqa: BLE001
        return None
    return got.select(F.inline("nodes")), got.select(F.inline("edges"))


def _struct(ddl: str) -> str:
    return ddl.replace(" ", ":").replace(",:", ",")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
