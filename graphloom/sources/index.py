"""From files to the property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ident import endpoint_id, endpoint_name, node_id, role
from graphloom.operators.graph import latest
from graphloom.sources import parse, scan



def _node(rows: DataFrame, kind: Column, node_type: Column, name: Column, path: Column, start: Column, end: Column, stage: int, at: Column, symbol_kind=None, method=None, route=None, metadata=None) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        node_id(kind, name, path).alias("id"),
        node_type.alias("type"),
        name.alias("qualified_name"),
        path.alias("file_path"),
        start.cast("int").alias("line_start"),
        end.cast("int").alias("line_end"),
        path.alias("provenance"),
        (null if symbol_kind is None else symbol_kind).alias("kind"),
        (null if method is None else method).alias("http_method"),
        (null if route is None else route).alias("http_path"),
        (F.lit(None).cast("map<string,string>") if metadata is None else metadata).alias("metadata"),
        _seq(stage, at).alias("seq"),
    )


def _edge(rows: DataFrame, source: Column, target: Column, kind: str, path: Column, stage: int, at: Column, metadata=None) -> DataFrame:
    return rows.select(
        source.alias("source"),
        target.alias("target"),
        F.lit(kind).alias("type"),
        F.lit(1.0).alias("weight"),
        path.alias("provenance"),
        (F.lit(None).cast("map<string,string>") if metadata is None else metadata).alias("metadata"),
        _seq(stage, at).alias("seq"),
    )


def _seq(stage: int, at: Column) -> Column:
    return F.lit(stage << 56) + at.cast("long")


def _place(at: str, within: Column) -> Column:
    """One order of a file's entries and of what is within each: there can be 2 ** 28 of both, more than a file has."""
    return F.shiftleft(F.col(at).cast("long"), 28) + within


def endpoints(parsed: DataFrame) -> DataFrame:
    """All declared routes; equal ones of different files stay apart, repeated declarations too."""
    r = parsed.select("path", F.posexplode("routes").alias("at", "r")).where("r.kind = 'route'")
    file, method, path, handler = F.col("path"), F.col("r.method"), F.col("r.path"), F.col("r.handler")
    return r.select(
        endpoint_id(method, path, handler, file).alias("id"), method.alias("method"), path.alias("path"), handler.alias("handler"),
        file.alias("file_path"), "r.line_start", "r.line_end", F.lit("express").alias("framework"), F.col("r.middleware").alias("middleware"),
        F.array().cast("array<string>").alias("decorators"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def build(parsed: DataFrame, files: DataFrame, prefixes: dict[str, str] | None = None, intended: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed files.

    Nodes: files, symbols by role, endpoints, handlers, middleware, mounts. Edges: belongs_to from symbol to file,
    depends_on between files, calls from methods to ``receiver.method`` in the same file and from endpoints to handlers,
    secured_by from endpoints to their middleware. Where two writes meet, the later stage of the later path stands. A
    file without routes contributes none of its middleware, as the plugin's result is only taken if it has endpoints;
    ``intended`` takes it in any case.
    """
    p, lit = F.col("path"), F.lit
    file_id = node_id(lit("file"), p, p)
    nodes = [_node(parsed, lit("file"), lit("file"), p, p, lit(1), lit(1), 0, lit(0))]
    syms = parsed.select("path", F.posexplode("symbols").alias("at", "s"))
    sid = node_id(F.col("s.kind"), F.col("s.qualified_name"), p)
    nodes.append(
        _node(syms, F.col("s.kind"), role(F.col("s.name"), F.col("s.decorators")), F.col("s.qualified_name"), p, F.col("s.line_start"), F.col("s.line_end"), 1, F.col("at"),
              symbol_kind=F.col("s.kind"), metadata=F.create_map(lit("decorators"), F.to_json("s.decorators"), lit("parameters"), F.to_json("s.parameters")))
    )
    edges = [_edge(syms, sid, file_id, "belongs_to", p, 1, F.col("at"))]
    imports = parsed.select(F.col("path").alias("file_path"), F.posexplode("imports").alias("at", "i")).select("file_path", "at", F.col("i.module").alias("module"))
    resolved = imports.join(scan.resolve_imports(imports.select("file_path", "module").distinct(), files, prefixes), ["file_path", "module"])
    f, t = F.col("file_path"), F.col("resolved")
    edges.append(_edge(resolved, node_id(lit("file"), f, f), node_id(lit("file"), t, t), "depends_on", f, 2, F.col("at"), F.create_map(lit("module"), "module")))
    bodies = syms.where("s.kind in ('method', 'function')")
    calls = bodies.select("path", "at", "s", F.posexplode("s.calls").alias("k", "callee"))
    edges.append(
        _edge(calls, sid, node_id(lit("method"), F.col("callee"), p), "calls", p, 3, _place("at", F.col("k")),
              F.create_map(lit("caller"), F.col("s.qualified_name"), lit("callee"), F.col("callee")))
    )
    with_routes = parsed if intended else parsed.where(F.exists("routes", lambda r: r["kind"] == "route"))
    r = with_routes.select("path", F.posexplode("routes").alias("at", "r"))
    start, end, at = F.col("r.line_start"), F.col("r.line_end"), _place("at", lit(0))
    route = r.where("r.kind = 'route'")
    name = endpoint_name(F.col("r.method"), F.col("r.path"))
    eid, hid = node_id(lit("endpoint"), name, p), node_id(lit("function"), F.col("r.handler"), p)
    nodes.append(_node(route, lit("endpoint"), lit("endpoint"), name, p, start, end, 4, at, method=F.col("r.method"), route=F.col("r.path"),
                       metadata=F.create_map(lit("method"), F.col("r.method"), lit("path"), F.col("r.path"))))
    nodes.append(_node(route, lit("function"), lit("function"), F.col("r.handler"), p, start, end, 4, at + 1))
    edges.append(_edge(route, eid, hid, "calls", p, 4, at))
    guards = route.select("path", "at", "r", F.posexplode("r.middleware").alias("k", "guard"))
    gid = node_id(lit("middleware"), F.col("guard"), p)
    nodes.append(_node(guards, lit("middleware"), lit("middleware"), F.col("guard"), p, start, end, 4, at + 2 + F.col("k")))
    edges.append(_edge(guards, eid, gid, "secured_by", p, 4, at + 1 + F.col("k")))
    general = r.where("r.kind = 'middleware'")
    nodes.append(_node(general, lit("middleware"), lit("middleware"), F.col("r.handler"), p, start, end, 4, at))
    mounts = r.where("r.kind = 'mount'")
    label = F.concat(lit("mount:"), F.col("r.path"), lit("→"), F.col("r.handler"))
    mount = _node(mounts, lit("mount"), lit("module"), label, p, start, end, 4, at, metadata=F.create_map(lit("prefix"), F.col("r.path"), lit("router"), F.col("r.handler")))
    nodes.append(mount.withColumn("id", node_id(lit("mount"), F.element_at("metadata", lit("prefix")), F.col("file_path"))))
    order = F.struct("provenance", "seq")
    return (
        latest(reduce(DataFrame.unionByName, nodes), ["id"], order),
        latest(reduce(DataFrame.unionByName, edges), ["source", "target"], order),
    )


def index(files: DataFrame, prefixes: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Nodes, edges, endpoints, symbols and parse errors of scanned files."""
    done = parse.parsed(files)
    nodes, edges = build(done, files, prefixes)
    return {
        "nodes": nodes,
        "edges": edges,
        "endpoints": endpoints(done),
        "symbols": done.select(F.explode("symbols").alias("s")).select("s.*"),
        "parse_errors": done.select("path", F.explode("errors").alias("e")).select("path", "e.*"),
    }


def stats(files: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """One row: files, endpoints, nodes, edges."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(files, "files").crossJoin(one(graph["endpoints"], "endpoints")).crossJoin(one(graph["nodes"], "nodes")).crossJoin(one(graph["edges"], "edges"))


def graph_of_endpoints(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) out of an endpoints table (method, path, handler, file_path, lines, middleware)."""
    e = endpoints.where("method is not null and path is not null and file_path is not null")
    f, name, lit = F.col("file_path"), endpoint_name(F.col("method"), F.col("path")), F.lit
    eid = node_id(lit("endpoint"), name, f)
    at = F.coalesce("line_start", lit(0)).cast("long")
    guards = e.select("*", F.explode("middleware").alias("guard"))
    handled = e.where("handler is not null")
    nodes = [
        _node(e, lit("endpoint"), lit("endpoint"), name, f, F.col("line_start"), F.col("line_end"), 4, at, method=F.col("method"), route=F.col("path")),
        _node(handled, lit("function"), lit("function"), F.col("handler"), f, F.col("line_start"), F.col("line_end"), 4, at),
        _node(guards, lit("middleware"), lit("middleware"), F.col("guard"), f, F.col("line_start"), F.col("line_end"), 4, at),
    ]
    edges = [
        _edge(handled, eid, node_id(lit("function"), F.col("handler"), f), "calls", f, 4, at),
        _edge(guards, eid, node_id(lit("middleware"), F.col("guard"), f), "secured_by", f, 4, at),
    ]
    order = F.struct("seq", "provenance")
    return latest(reduce(DataFrame.unionByName, nodes), ["id"], order), latest(reduce(DataFrame.unionByName, edges), ["source", "target"], order)


__all__ = ["build", "endpoints", "graph_of_endpoints", "index", "stats"]
