"""Queries p2, p5 and p6: incremental work, hierarchies, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy as tree
from graphloom.operators import ledger, orphans
from graphloom.runtime import table, trimmed


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    events = ledger.run_events(table(spark, sf, "parse_log"), table(spark, sf, "index_runs"))
    current = ledger.current_versions(table(spark, sf, "file_index"), "id", "content_hash", [F.col("updated_at")])
    todo = ledger.pending(current, ledger.fold(events))
    return todo.select(F.col("item").alias("file_id"), F.col("version").alias("content_hash"))


P2 = """
WITH cur AS (
  SELECT id, content_hash FROM (
    SELECT id, content_hash, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, content_hash DESC NULLS LAST) rn
    FROM file_index WHERE id IS NOT NULL) WHERE rn = 1),
seen AS (
  SELECT file_id, content_hash FROM (
    SELECT l.file_id, l.content_hash, row_number() OVER (PARTITION BY l.file_id ORDER BY l.run_id DESC, l.log_seq DESC) rn
    FROM parse_log l WHERE l.run_id IN (SELECT run_id FROM index_runs WHERE status = 'completed')) WHERE rn = 1)
SELECT cur.id AS file_id, cur.content_hash AS content_hash
FROM cur LEFT JOIN seen ON seen.file_id = cur.id
WHERE seen.file_id IS NULL OR seen.content_hash IS DISTINCT FROM cur.content_hash
"""


def _parent_links(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "edges").where(F.lower(trimmed("type")) == "belongs_to")
    return edges.select(F.col("source").alias("child"), F.col("target").alias("parent"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return tree.hierarchy(_parent_links(spark, sf), with_path=False).select("node_id", "root_id", "depth")


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = tree.hierarchy(_parent_links(spark, sf))
    return rows.select("node_id", "root_id", "depth", "subtree_size", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return tree.descendants(tree.hierarchy(_parent_links(spark, sf)))


_TREE = """
WITH RECURSIVE e AS (
  SELECT source AS child, min(target) AS parent FROM edges
  WHERE lower(trim(type, E' \\t\\n\\r')) = 'belongs_to' AND source IS NOT NULL AND target IS NOT NULL GROUP BY source),
n AS (SELECT child AS node FROM e UNION SELECT parent FROM e),
r AS (
  SELECT node, node AS root, 0 AS depth, node AS path FROM n WHERE node NOT IN (SELECT child FROM e)
  UNION ALL
  SELECT e.child, r.root, r.depth + 1, r.path || '/' || e.child FROM r JOIN e ON e.parent = r.node)
"""
P5_FOUND = _TREE + """
SELECT n.node AS node_id, coalesce(r.root, '') AS root_id, CAST(coalesce(r.depth, -1) AS INT) AS depth
FROM n LEFT JOIN r ON r.node = n.node
"""
P5_DESCENDANTS = _TREE.rstrip() + """,
d AS (
  SELECT e.parent AS ancestor_id, e.child AS descendant_id, 1 AS distance FROM e JOIN r ON r.node = e.child
  UNION ALL
  SELECT d.ancestor_id, e.child, d.distance + 1 FROM d JOIN e ON e.parent = d.descendant_id)
SELECT ancestor_id, descendant_id, CAST(distance AS INT) AS distance FROM d
"""

#: table, row id, key, parent table, parent key; epoch: created_at and deleted_at are epoch seconds.
REFERENCES = [
    ("endpoints", "id", "project_id", "projects", "id", True),
    ("analysis_reports", "id", "endpoint_id", "endpoints", "id", True),
    ("token_usage_log", "id", "report_id", "analysis_reports", "id", True),
    ("edges", "seq", "target", "nodes", "id", False),
]


def _at(name: str, epoch: bool):
    """Seconds, with the fraction of timestamps kept."""
    col = F.col(name)
    return orphans.epoch(col).cast("double") if epoch else col.cast("double")


def _orphans(spark: SparkSession, sf: str):
    for name, row_id, key, parent, parent_key, epoch in REFERENCES:
        rows = table(spark, sf, parent)
        parents = orphans.parent_keys(rows, parent_key, _at("created_at", epoch), _at("deleted_at", epoch))
        refs = orphans.references(table(spark, sf, name), F.col(row_id), key, _at("created_at", epoch))
        yield name, refs, orphans.orphans(refs, parents, expected_keys=rows.count())


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        found.select(F.lit(name).alias("source_table"), "row_id", "reason")
        for name, _, found in _orphans(spark, sf)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        orphans.report(refs, found).select(F.lit(name).alias("source_table"), "*")
        for name, refs, found in _orphans(spark, sf)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _p6_sql() -> str:
    parts = []
    for name, row_id, key, parent, parent_key, epoch in REFERENCES:
        norm = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"
        dead = "deleted_at IS NOT NULL AND deleted_at <> 0" if epoch else "deleted_at IS NOT NULL"
        made, when = ("nullif(created_at, 0)",) * 2 if epoch else ("created_at",) * 2
        month = f"strftime(make_timestamp({when} * 1000000), '%Y-%m')" if epoch else f"strftime({when} AT TIME ZONE 'UTC', '%Y-%m')"
        parts.append(
            f"""SELECT '{name}' AS source_table, c.row_id, c.month, CASE WHEN p.key IS NULL THEN 'missing' WHEN NOT p.alive THEN 'deleted'
            WHEN p.born > c.at THEN 'late' END AS reason
            FROM (SELECT DISTINCT CAST({row_id} AS VARCHAR) AS row_id, {norm.format(key)} AS key, {when} AS at, {month} AS month FROM {name}) c
            LEFT JOIN (SELECT {norm.format(parent_key)} AS key, bool_or(NOT coalesce({dead}, false)) AS alive,
              min(CASE WHEN NOT coalesce({dead}, false) THEN {made} END) AS born FROM {parent} GROUP BY 1) p ON p.key = c.key
            WHERE c.key IS NOT NULL"""
        )
    return " UNION ALL ".join(parts)


QUERIES = {
    "p2_found": p2_found,
    "p5_found": p5_found,
    "p5_descendants": p5_descendants,
    "p5_paths": p5_paths,
    "p6_found": p6_found,
    "p6_report": p6_report,
}
ORACLE = {
    "p2_found": P2,
    "p5_found": P5_FOUND,
    "p5_descendants": P5_DESCENDANTS,
    "p5_paths": _TREE.rstrip() + """,
d AS (
  SELECT node AS a, node AS b FROM n
  UNION SELECT d.a, e.child FROM d JOIN e ON e.parent = d.b)
SELECT n.node AS node_id, coalesce(r.root, '') AS root_id, CAST(coalesce(r.depth, -1) AS INT) AS depth,
  CASE WHEN EXISTS (SELECT 1 FROM d JOIN e ON e.child = n.node WHERE d.a = n.node AND d.b = e.parent) THEN NULL
  ELSE (SELECT count(*) FROM d WHERE d.a = n.node) END AS subtree_size, r.path AS path
FROM n LEFT JOIN r ON r.node = n.node
""",
    "p6_found": f"SELECT DISTINCT source_table, row_id, reason FROM ({_p6_sql()}) WHERE reason IS NOT NULL",
    "p6_report": f"""SELECT source_table, month, count(*) AS refs, count(*) FILTER (reason = 'missing') AS missing,
    count(*) FILTER (reason = 'deleted') AS deleted, count(*) FILTER (reason = 'late') AS late FROM ({_p6_sql()}) GROUP BY 1, 2""",
}
