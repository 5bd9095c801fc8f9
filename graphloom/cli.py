"""Command line: python -m graphloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from graphloom import __version__
from graphloom.api import Engine
from graphloom.config import load


def session() -> SparkSession:
    return SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def show(findings: DataFrame, form: str) -> None:
    rows = [r.asDict() for r in findings.collect()]
    if form == "json":
        print(json.dumps(rows, indent=2))
        return
    for n, r in enumerate(rows, 1):
        print(f"{n:>3}. [{r['severity']}] {r['title']} - {r['endpoint'] or r['file_path'] or ''} {(r['description'] or '')[:80]}")
    print(", ".join(f"{k}: {v}" for k, v in Counter(r["severity"] for r in rows).items()) or "no findings")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="graphloom")
    sub = ap.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("init", "index", "endpoints", "security", "performance", "analyze", "graph", "serve"):
        p = sub.add_parser(name)
        if name in ("analyze", "graph"):
            p.add_argument("endpoint")
        p.add_argument("root", nargs="?", default=".")
        p.add_argument("--format", choices=["table", "json"], default="table")
        p.add_argument("--depth", type=int, default=3)
        p.add_argument("--port", type=int)
    args = ap.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    settings = load(project_root=args.root, port=args.port)
    spark = spark or session()
    if args.command == "serve":
        from graphloom.server import serve

        serve(spark, settings)
        return 0
    engine = Engine(spark, args.root, settings)
    place = f"{args.root.rstrip('/')}/{settings.data_dir}"
    if args.command in ("init", "index") or not engine.load(place):
        stats = engine.index()
        engine.save(place)
        if args.command in ("init", "index"):
            print(json.dumps(stats.first().asDict()))
            return 0
    if args.command == "endpoints":
        rows = [r.asDict() for r in engine.endpoints.select("method", "path", "handler", "file_path", "line_start").orderBy("path", "method").collect()]
        print(json.dumps(rows, indent=2) if args.format == "json" else "\n".join(f"{n:>3}. {r['method']} {r['path']} -> {r['handler']} ({r['file_path']}:{r['line_start']})" for n, r in enumerate(rows, 1)))
    elif args.command == "graph":
        tree = engine.tree(args.endpoint, args.depth)
        if tree is None:
            print(f"no endpoint {args.endpoint}", file=sys.stderr)
            return 1
        print(tree)
    else:
        show({"security": engine.security, "performance": engine.performance}[args.command]() if args.command != "analyze" else engine.analyze(args.endpoint), args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
