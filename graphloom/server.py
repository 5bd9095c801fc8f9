"""HTTP routes over engines, with the standard library's server."""

from __future__ import annotations

import json
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import SparkSession

from graphloom import __version__
from graphloom.api import Engine
from graphloom.config import Settings


class Routes:
    """What each request answers, as (status, document)."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self.projects: dict[str, dict] = {}
        self.engines: dict[str, Engine] = {}
        self.reports: dict[str, dict] = {}

    def handle(self, method: str, path: str, body: dict) -> tuple[int, object]:
        parts = [unquote(p) for p in path.split("?")[0].strip("/").split("/")]
        match (method, parts):
            case "GET", ["health"] | ["api", "health"]:
                return 200, {"status": "ok", "version": __version__, "projects": len(self.projects)}
            case "POST", ["api", "projects"]:
                return self.create(body)
            case "GET", ["api", "projects", key]:
                return self.found(self.projects.get(key))
            case "GET", ["api", "projects", key, "endpoints"] if key in self.engines:
                rows = self.engines[key].endpoints.orderBy("path", "method").collect()
                return 200, [r.asDict() for r in rows]
            case "POST", ["api", "analysis"]:
                return self.analyse(body)
            case "GET", ["api", "reports", key]:
                return self.found(self.reports.get(key))
            case "GET", ["api", "graph", key, name] if key in self.engines:
                node = self.engines[key].endpoint_id(name)
                return (200, json.loads(self.engines[key].tool_graph(node, 3))) if node else self.found(None)
        return self.found(None)

    @staticmethod
    def found(doc: dict | None) -> tuple[int, object]:
        return (200, doc) if doc is not None else (404, {"error": "not found"})

    def create(self, body: dict) -> tuple[int, object]:
        root = str(body.get("root_path", ""))
        if not root or not Path(root).is_dir():
            return 400, {"error": "root_path is no folder"}
        engine, key = Engine(self.spark, root, self.settings), uuid.uuid4().hex[:8]
        stats = engine.index().first().asDict()
        self.engines[key] = engine
        self.projects[key] = {"id": key, "name": body.get("name") or Path(root).name, "root_path": root, "endpoints_count": stats["endpoints"], **stats}
        return 201, self.projects[key]

    def analyse(self, body: dict) -> tuple[int, object]:
        engine = self.engines.get(str(body.get("project_id")))
        if engine is None:
            return self.found(None)
        start, key = time.time(), uuid.uuid4().hex[:8]
        done = engine.report(str(body.get("endpoint", "")), str(body.get("goal_type", "full")))
        self.reports[key] = done | {"id": key, "latency_ms": int(1000 * (time.time() - start))}
        return 200, self.reports[key]


def serve(spark: SparkSession, settings: Settings, background: bool = False) -> ThreadingHTTPServer:
    routes = Routes(spark, settings)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                status, doc = routes.handle(method, self.path, body)
            except ValueError:
                status, doc = 400, {"error": "the body is no JSON"}
            data = json.dumps(doc, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self.answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self.answer("POST")

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", settings.port), Handler)
    if not background:
        server.serve_forever()
    return server
