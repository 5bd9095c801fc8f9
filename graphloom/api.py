"""One project's graph and what can be asked of it."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import Settings
from graphloom.operators import context, graph, reports, rules
from graphloom.runtime import Scratch
from graphloom.sources import index, scan, store


class Engine:
    """Index a source tree, keep its graph, run rules, extract context and report. Results are DataFrames or, for the
    ``tool`` methods, JSON documents."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root, settings or Settings()
        self.scratch = Scratch(spark, "engine")
        self.files = self.nodes = self.edges = self.endpoints = None

    def index(self) -> DataFrame:
        """Scan, parse and build; one row of statistics."""
        files = self.scratch.put(scan.scan(self.spark, self.root, known_only=False, ignored=self.settings.ignored))
        tsconfig = files.where("path = 'tsconfig.json'").select("text").first()
        code = files.where("language is not null")
        built = index.index(code, scan.aliases(tsconfig.text if tsconfig else None))
        self.files = code.select(F.col("path").alias("file_path"), "text")
        self.nodes, self.edges, self.endpoints = (self.scratch.put(built[k]) for k in ("nodes", "edges", "endpoints"))
        self.detection = scan.detect(files)
        return index.stats(code, {"nodes": self.nodes, "edges": self.edges, "endpoints": self.endpoints}).crossJoin(
            self.detection.select("framework", "confidence")  # one row each
        )

    def save(self, path: str) -> None:
        store.save_graph(self.nodes, self.edges, path)
        self.files.write.mode("overwrite").parquet(f"{path}/files")
        self.endpoints.write.mode("overwrite").parquet(f"{path}/endpoints")

    def load(self, path: str) -> bool:
        loaded = store.load_graph(self.spark, path)
        if loaded is None:
            return False
        self.nodes, self.edges = loaded
        self.files = self.spark.read.parquet(f"{path}/files")
        self.endpoints = self.spark.read.parquet(f"{path}/endpoints")
        return True

    def registry(self) -> DataFrame:
        return graph.registry(self.nodes)

    def endpoint_id(self, name: str) -> str | None:
        row = self.registry().where(F.col("name") == name).first()
        return row.id if row else None

    def reached(self) -> DataFrame:
        seeds = self.nodes.where("type = 'endpoint'").select("id")
        return self.scratch.put(graph.reach(self.edges, seeds, 5))

    def security(self) -> DataFrame:
        parts = [rules.middleware_rules(self.nodes, self.edges), rules.project_rules(self.nodes)]
        deep = rules.reach_rules(self.nodes, self.edges, self.files, self.reached())
        return rules.ranked(reduce(DataFrame.unionByName, [*parts, deep.where("engine = 'security'")]))

    def performance(self) -> DataFrame:
        found = rules.reach_rules(self.nodes, self.edges, self.files, self.reached())
        return rules.ranked(found.where("engine = 'performance'"))

    def architecture(self) -> DataFrame:
        return rules.ranked(rules.architecture_rules(self.nodes, self.edges))

    def analyze(self, name: str) -> DataFrame:
        """Findings of all engines for one endpoint, by severity; of an unknown one that it is not there."""
        if self.endpoint_id(name) is None:
            names = self.spark.createDataFrame([(name,)], "endpoint string")
            return rules.not_found(self.spark, names, self.nodes)
        scoped = rules.scoped_architecture(self.nodes, self.edges, self.reached())
        found = self.security().unionByName(self.performance()).unionByName(scoped)
        return rules.ranked(found.where(F.col("endpoint") == name))

    def context(self, name: str, goal: str = "full", budget: int | None = None) -> DataFrame:
        names = self.spark.createDataFrame([(name,)], "endpoint string")
        return context.extract(self.nodes, self.edges, self.files, names, goal, budget or self.settings.token_budget)

    def report(self, name: str, goal: str = "full", provider=reports.static_check) -> dict:
        """The plan-execute-evaluate-report loop; static findings with other titles are added."""
        rows = context.rendered(self.context(name, goal)).first()
        done = reports.run(name, goal, rows.text if rows else "", provider, self.settings.confidence_threshold, self.settings.max_iterations)
        seen = {f["title"] for f in done["findings"]}
        done["findings"] += [r.asDict() for r in self.analyze(name).collect() if r.title not in seen]
        done["findings_count"] = len(done["findings"])
        return done

    # tools: JSON documents, errors as documents too

    def tool_context(self, name: str, goal: str = "full", budget: int = 4000) -> str:
        if self.endpoint_id(name) is None:
            return json.dumps({"error": f"no endpoint {name}"})
        return json.dumps({"endpoint": name, "goal": goal, "snippets": [r.asDict() for r in self.context(name, goal, budget).collect()]})

    def tool_endpoint(self, name: str) -> str:
        node = self.endpoint_id(name)
        if node is None:
            return json.dumps({"error": f"no endpoint {name}"})
        row = self.nodes.where(F.col("id") == node).select("id", "qualified_name", "file_path", "line_start", "line_end", "http_method", "http_path").first()
        near = graph.neighbors(self.edges, self.spark.createDataFrame([(node,)], "id string"))
        return json.dumps(row.asDict() | {"neighbors": sorted(r.node for r in near.collect())})

    def tool_graph(self, node: str, depth: int = 2) -> str:
        seeds = self.spark.createDataFrame([(node,)], "id string")
        ids = graph.reach(self.edges, seeds, depth, include_seeds=True).select(F.col("node").alias("id"))
        found = self.nodes.join(ids, "id", "left_semi").select("id", "type", "qualified_name").collect()
        if not found:
            return json.dumps({"error": f"no node {node}"})
        inside = graph.induced(self.edges, ids).select("source", "target", "type").collect()
        return json.dumps({"nodes": [r.asDict() for r in found], "edges": [r.asDict() for r in inside]})

    def tool_endpoints(self) -> str:
        return json.dumps(sorted(r.name for r in self.registry().collect()))

    def tree(self, name: str, depth: int = 3) -> str | None:
        """The dependencies of an endpoint as indented text; None if it is unknown."""
        root = self.endpoint_id(name)
        if root is None:
            return None
        rows = graph.tree(self.edges, root, depth).collect()
        labels = {r.id: f"{r.qualified_name} ({r.type})" for r in self.nodes.select("id", "qualified_name", "type").join(
            self.spark.createDataFrame([(x,) for x in {root, *(r.child for r in rows)}], "id string"), "id", "left_semi").collect()}
        below: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: labels.get(r.child, r.child)):
            below.setdefault(r.parent, []).append(r)
        out = [labels.get(root, root)]

        def walk(node: str, indent: int) -> None:
            for r in below.get(node, []):
                out.append(f"{'  ' * indent}{r.type}: {labels.get(r.child, r.child)}")
                walk(r.child, indent + 1)

        walk(root, 1)
        return "\n".join(out)
