"""Queries of the graph, rule, text, report and change operators over whole tables, with SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import ident, text
from graphloom.operators import context, graph, reports, rules
from graphloom.runtime import Scratch, spread, table
from graphloom.schema import BINARY_EXTENSIONS, GOAL_BOOSTS, GOAL_EDGES, IGNORED, LANGUAGES, LAYERS
from graphloom.sources import index, parse, scan
from graphloom.streaming import changes

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.upsert_nodes(table(spark, sf, "nodes"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.upsert_edges(table(spark, sf, "edges"))


def _kept(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both upserted and written once, for operators that read them again and again."""
    scratch = Scratch(spark, "graph")
    return scratch.put(_nodes(spark, sf)), scratch.put(_edges(spark, sf))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "parse_results").select("file_path", F.regexp_replace("text", "\r\n?", "\n").alias("text"))


def _seeds(nodes: DataFrame) -> DataFrame:
    """All endpoints of the registry."""
    return graph.registry(nodes).select("id")


_N = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"
_E0 = r"e0 AS (SELECT source, target, lower(trim(type, E' \t\n\r')) AS type, weight, provenance, seq FROM edges WHERE source IS NOT NULL AND target IS NOT NULL)"
_E = _E0 + ", e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY seq DESC, type DESC, weight DESC) rn FROM e0) WHERE rn = 1)"
_REG = "reg AS (SELECT name, id FROM (SELECT qualified_name AS name, id, row_number() OVER (PARTITION BY qualified_name ORDER BY seq DESC, id DESC) rn FROM n WHERE type = 'endpoint') WHERE rn = 1)"
_NE = f"WITH RECURSIVE {_N}, {_E}, {_REG}"


# identity, classification, filters


@query("SELECT DISTINCT file_path, substr(sha256('file:' || file_path || ':' || file_path), 1, 16) AS id FROM file_index")
def node_ids(spark, sf):
    p = F.col("file_path")
    return table(spark, sf, "file_index").select("file_path", ident.node_id(F.lit("file"), p, p).alias("id")).distinct()


@query("SELECT DISTINCT method, path, handler, file_path, substr(sha256(method || ':' || path || ':' || handler || ':' || file_path), 1, 16) AS key, method || ' ' || path AS name FROM endpoints")
def endpoint_ids(spark, sf):
    c = [F.col(x) for x in ("method", "path", "handler", "file_path")]
    return table(spark, sf, "endpoints").select(*c, ident.endpoint_id(*c).alias("key"), ident.endpoint_name(c[0], c[1]).alias("name")).distinct()


@query("SELECT DISTINCT qualified_name, regexp_extract(qualified_name, '[^.]*$') AS display, CASE WHEN contains(qualified_name, '.') THEN regexp_replace(qualified_name, '\\.[^.]*$', '') END AS class_name FROM symbols")
def display_names(spark, sf):
    q = F.col("qualified_name")
    return table(spark, sf, "symbols").select(q, ident.display_name(q).alias("display"), ident.class_name(q).alias("class_name")).distinct()


def _role_sql() -> str:
    whens = [f"WHEN regexp_matches(d, '{p}') THEN '{r}'" for p, r in ident.DECORATOR_ROLES] + [f"WHEN regexp_matches(name, '(?i){p}') THEN '{r}'" for r, p in ident.NAME_ROLES]
    return f"SELECT symbol_id, name, CASE {' '.join(whens)} ELSE 'class' END AS role FROM (SELECT DISTINCT symbol_id, name, lower(array_to_string(coalesce(decorators, []), ' ')) AS d FROM symbols)"


@query(_role_sql())
def role_classify(spark, sf):
    return table(spark, sf, "symbols").select("symbol_id", "name", ident.role(F.col("name"), F.col("decorators")).alias("role")).distinct()


@query("SELECT DISTINCT file_path, CASE " + " ".join(f"WHEN lower(regexp_extract(file_path, '[^/]\\.([^./]+)$', 1)) = '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " END AS language FROM file_index")
def file_languages(spark, sf):
    return table(spark, sf, "file_index").select("file_path", ident.language(F.col("file_path")).alias("language")).distinct()


_HIDDEN = "|".join(p.replace(".", "\\.").replace("*", "\\*") for p in IGNORED)
_GLOBS = "|".join(p.replace(".", "\\.").replace("*", ".*") for p in IGNORED)


@query(
    f"""SELECT DISTINCT file_path, NOT coalesce(lower(regexp_extract(file_path, '[^/]\\.([^./]+)$', 1)) IN ({", ".join(f"'{b}'" for b in BINARY_EXTENSIONS)}), false)
    AND len(list_filter(string_split(file_path, '/'), lambda p: regexp_full_match(p, '{_GLOBS}') OR (starts_with(p, '.') AND p NOT IN ('.env', '.env.example') AND regexp_matches(p, '^(?:{_HIDDEN})')))) = 0 AS included FROM file_index"""
)
def file_filter(spark, sf):
    return table(spark, sf, "file_index").select("file_path", scan.included(F.col("file_path")).alias("included")).distinct()


# the graph


@query(f"WITH {_N} SELECT id, type, qualified_name, seq FROM n")
def node_upsert(spark, sf):
    return _nodes(spark, sf).select("id", "type", "qualified_name", "seq")


@query(f"WITH {_E} SELECT source, target, type, weight, seq FROM e")
def edge_upsert_last_wins(spark, sf):
    return _edges(spark, sf).select("source", "target", "type", "weight", "seq")


@query(f"WITH {_E0} SELECT source, target, type, max(seq) AS seq FROM e0 GROUP BY ALL")
def edge_upsert_multi(spark, sf):
    return graph.upsert_edges(table(spark, sf, "edges"), multi=True).select("source", "target", "type", "seq")


@query("SELECT DISTINCT id FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM nodes WHERE id IS NOT NULL)")
def phantom_nodes(spark, sf):
    return graph.phantoms(table(spark, sf, "nodes"), table(spark, sf, "edges"))


@query(f"WITH {_N}, {_REG} SELECT reg.name, reg.id, n.file_path, n.http_method, n.http_path FROM reg JOIN n ON n.id = reg.id")
def endpoint_registry(spark, sf):
    nodes = _nodes(spark, sf)
    return graph.registry(nodes).join(nodes.select("id", "file_path", "http_method", "http_path"), "id").select("name", "id", "file_path", "http_method", "http_path")


@query(f"WITH {_N}, {_E} SELECT (SELECT count(*) FROM (SELECT id FROM n UNION SELECT source FROM e UNION SELECT target FROM e)) AS node_count, (SELECT count(*) FROM e) AS edge_count")
def graph_counts(spark, sf):
    return graph.counts(_nodes(spark, sf), _edges(spark, sf))


@query(f"WITH {_N} SELECT type, count(*) AS n FROM n GROUP BY 1")
def nodes_by_type(spark, sf):
    return _nodes(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_N}, {_E} SELECT DISTINCT n.id AS seed, e.target AS node FROM n JOIN e ON e.source = n.id WHERE n.type = 'endpoint' AND e.type IN ('maps_to', 'calls')")
def neighbors_1hop(spark, sf):
    return graph.neighbors(_edges(spark, sf), _nodes(spark, sf).where("type = 'endpoint'").select("id"), ["maps_to", "calls"])


_REACH = """, w AS (SELECT n.id AS seed, n.id AS node, 0 AS hops FROM n WHERE n.type = 'endpoint'
  UNION SELECT w.seed, e.target, w.hops + 1 FROM w JOIN e ON e.source = w.node WHERE w.hops < {depth}),
reach AS (SELECT seed, node, min(hops) AS hops FROM w GROUP BY 1, 2)"""


@query(_NE + _REACH.format(depth=4) + " SELECT seed, node, CAST(hops AS INT) AS hops FROM reach WHERE hops > 0")
def neighbors_khop(spark, sf):
    nodes, edges = _kept(spark, sf)
    return graph.reach(edges, nodes.where("type = 'endpoint'").select("id"), 4)


def _bfs_sql(goal: str, depth: int = 5, seeds: str = "SELECT id FROM reg") -> str:
    types = GOAL_EDGES[goal]
    some = "" if types is None else " WHERE type IN (" + ", ".join(f"'{t}'" for t in types) + ")"
    return f""", both_ways AS (SELECT source AS a, target AS b FROM e{some} UNION SELECT target, source FROM e{some}),
b AS (SELECT id AS seed, id AS node, 0 AS hops FROM ({seeds}) UNION SELECT b.seed, y.b, b.hops + 1 FROM b JOIN both_ways y ON y.a = b.node WHERE b.hops < {depth}),
m AS (SELECT seed, node, min(hops) AS hops FROM b GROUP BY 1, 2)"""


def _bfs(spark, sf, goal):
    nodes, edges = _kept(spark, sf)
    return graph.goal_subgraph(edges, _seeds(nodes), goal)


@query(_NE + _bfs_sql("full") + " SELECT seed, node, CAST(hops AS INT) AS hops FROM m")
def goal_bfs(spark, sf):
    return _bfs(spark, sf, "full")


@query(_NE + _bfs_sql("security") + " SELECT seed, node, CAST(hops AS INT) AS hops FROM m")
def goal_bfs_security(spark, sf):
    return _bfs(spark, sf, "security")


@query(_NE + _bfs_sql("architecture", seeds="SELECT id FROM n WHERE type IN ('controller', 'service', 'repository')") + " SELECT seed, node, CAST(hops AS INT) AS hops FROM m")
def goal_bfs_architecture(spark, sf):
    """Of all controllers, services and repositories, along the edges of the goal."""
    nodes, edges = _kept(spark, sf)
    return graph.goal_subgraph(edges, nodes.where("type in ('controller', 'service', 'repository')").select("id"), "architecture")


def _ppr_sql(k: int) -> str:
    parts = [
        ", inside AS (SELECT a.seed, e.source, e.target, coalesce(e.weight, 1) AS w FROM e JOIN m a ON a.node = e.source JOIN m b ON b.node = e.target AND b.seed = a.seed WHERE coalesce(e.weight, 1) > 0)",
        "walk AS (SELECT seed, source, target, w / sum(w) OVER (PARTITION BY seed, source) AS share FROM inside)",
        "ends AS (SELECT m.seed, m.node FROM m WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.seed = m.seed AND w.source = m.node))",
        "r0 AS (SELECT seed, node, 1.0 / count(*) OVER (PARTITION BY seed) AS score FROM m)",
    ]
    for i in range(1, k + 1):
        p = f"r{i - 1}"
        parts.append(
            f"r{i} AS (SELECT m.seed, m.node, coalesce(f.v, 0) + CASE WHEN m.node = m.seed THEN 0.15 + 0.85 * coalesce(d.v, 0) ELSE 0 END AS score FROM m "
            f"LEFT JOIN (SELECT w.seed, w.target AS node, sum(0.85 * x.score * w.share) AS v FROM walk w JOIN {p} x ON x.node = w.source AND x.seed = w.seed GROUP BY 1, 2) f ON f.node = m.node AND f.seed = m.seed "
            f"LEFT JOIN (SELECT x.seed, sum(x.score) AS v FROM {p} x JOIN ends USING (seed, node) GROUP BY 1) d ON d.seed = m.seed)"
        )
    return ", ".join(parts)


def _ranked(spark, sf, boost=None):
    nodes, edges = _kept(spark, sf)
    scores = context.relevance(nodes, edges, _seeds(nodes), "full", boost, iterations=6, tolerance=None)
    # as round in SQL: a half goes up; F.round works on decimals and takes longer than all else
    y = F.col("score") * 1e8
    down = F.rint(y)
    return scores.select("seed", "node", (F.when(y - down == 0.5, down + 1).otherwise(down) / 1e8).alias("score"))


@query(_NE + _bfs_sql("full") + _ppr_sql(6) + " SELECT seed, node, round(score, 8) AS score FROM r6")
def ppr_fixed_k(spark, sf):
    return _ranked(spark, sf)


_BOOST = "CASE " + " ".join(f"WHEN n.type = '{t}' THEN {b}" for t, b in GOAL_BOOSTS["security"].items()) + " ELSE 1.0 END"


@query(_NE + _bfs_sql("full") + _ppr_sql(6) + f" SELECT r6.seed, r6.node, round(score * {_BOOST}, 8) AS score FROM r6 LEFT JOIN n ON n.id = r6.node")
def boosted_scores(spark, sf):
    return _ranked(spark, sf, "security")


@query(
    """WITH RECURSIVE c AS (SELECT DISTINCT file_path, snippet_id, relevance_score, token_count FROM snippets WHERE token_count IS NOT NULL AND token_count <= 300 AND file_path IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY relevance_score DESC, snippet_id) AS rn FROM c),
f AS (SELECT file_path, 0 AS rn, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS taken FROM (SELECT DISTINCT file_path FROM o)
  UNION ALL SELECT o.file_path, o.rn, CASE WHEN f.used + o.token_count <= 300 THEN f.used + o.token_count ELSE f.used END, CASE WHEN f.used + o.token_count <= 300 THEN o.snippet_id END
  FROM f JOIN o ON o.file_path = f.file_path AND o.rn = f.rn + 1)
SELECT file_path, taken AS snippet_id FROM f WHERE taken IS NOT NULL"""
)
def greedy_budget(spark, sf):
    rows = table(spark, sf, "snippets").select("file_path", "snippet_id", "relevance_score", "token_count").where("file_path is not null").distinct()
    return context.greedy_budget(rows, "file_path", [-F.col("relevance_score"), F.col("snippet_id")], "token_count", 300, "snippet_id").select("file_path", "snippet_id")


@query(f"WITH {_N}, {_E} SELECT source, target, e.type FROM e WHERE source IN (SELECT id FROM n WHERE type IN ('class', 'file')) AND target IN (SELECT id FROM n WHERE type IN ('class', 'file'))")
def induced_subgraph(spark, sf):
    ids = _nodes(spark, sf).where("type in ('class', 'file')").select("id")
    return graph.induced(_edges(spark, sf), ids).select("source", "target", "type")


_GONE = ", gone AS (SELECT id FROM n WHERE provenance IN (SELECT file_path FROM parse_results WHERE text IS NULL OR text = ''))"


@query(f"WITH {_N}, {_E}{_GONE} SELECT id FROM n WHERE id NOT IN (SELECT id FROM gone)")
def prune_nodes(spark, sf):
    empty = table(spark, sf, "parse_results").where("text is null or text = ''").select(F.col("file_path").alias("provenance"))
    return graph.prune(_nodes(spark, sf), _edges(spark, sf), empty)[0].select("id")


@query(f"WITH {_N}, {_E}{_GONE} SELECT source, target FROM e WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)")
def prune_edges(spark, sf):
    empty = table(spark, sf, "parse_results").where("text is null or text = ''").select(F.col("file_path").alias("provenance"))
    return graph.prune(_nodes(spark, sf), _edges(spark, sf), empty)[1].select("source", "target")


@query(
    f"""WITH RECURSIVE {_N}, {_E}, d AS (SELECT DISTINCT source, target FROM e WHERE type = 'depends_on'),
p AS (SELECT source AS first, target AS last, [source, target] AS path FROM d WHERE source < target
  UNION ALL SELECT p.first, d.target, list_append(p.path, d.target) FROM p JOIN d ON d.source = p.last WHERE d.target > p.first AND NOT list_contains(p.path, d.target))
SELECT array_to_string(path, '>') AS cycle FROM p JOIN d ON d.source = p.last AND d.target = p.first
UNION ALL SELECT source FROM d WHERE source = target"""
)
def import_cycles(spark, sf):
    d = _edges(spark, sf).where("type = 'depends_on'")
    return graph.cycles(d, None).select(F.array_join("cycle", ">").alias("cycle"))


@query(
    f"""WITH RECURSIVE {_N}, {_E}, d AS (SELECT DISTINCT source, target FROM e WHERE type = 'belongs_to'),
p AS (SELECT source AS first, target AS last, [source, target] AS path FROM d WHERE source < target
  UNION ALL SELECT p.first, d.target, list_append(p.path, d.target) FROM p JOIN d ON d.source = p.last WHERE d.target > p.first AND NOT list_contains(p.path, d.target))
SELECT array_to_string(path, '>') AS cycle FROM p JOIN d ON d.source = p.last AND d.target = p.first
UNION ALL SELECT source FROM d WHERE source = target"""
)
def parent_cycles(spark, sf):
    d = _edges(spark, sf).where("type = 'belongs_to'")
    return graph.cycles(d, None).select(F.array_join("cycle", ">").alias("cycle"))


@query(
    f"""{_NE}, t AS (SELECT id AS root, id AS node, 0 AS hops FROM reg UNION SELECT t.root, e.target, t.hops + 1 FROM t JOIN e ON e.source = t.node WHERE t.hops < 5),
l AS (SELECT root, node, min(hops) AS hops FROM t GROUP BY 1, 2)
SELECT a.root, min(e.source) AS parent, e.target AS child, CAST(b.hops AS INT) AS level, arg_min(e.type, e.source) AS type FROM e JOIN l a ON a.node = e.source JOIN l b ON b.node = e.target AND b.root = a.root
WHERE b.hops = a.hops + 1 GROUP BY a.root, e.target, b.hops"""
)
def dependency_tree(spark, sf):
    nodes, edges = _kept(spark, sf)
    return graph.trees(edges, _seeds(nodes), 5)


# rules

_EP_NODES = """ep AS (SELECT DISTINCT method, path, handler, file_path, line_start, line_end, middleware FROM endpoints WHERE method IS NOT NULL AND path IS NOT NULL AND file_path IS NOT NULL),
named AS (SELECT *, method || ' ' || path AS name, substr(sha256('endpoint:' || method || ' ' || path || ':' || file_path), 1, 16) AS eid FROM ep),
en AS (SELECT * FROM (SELECT eid AS id, name, method, path, file_path, line_start, row_number() OVER (PARTITION BY eid ORDER BY coalesce(line_start, 0) DESC, line_end DESC NULLS LAST) rn FROM named) WHERE rn = 1),
er AS (SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY coalesce(line_start, 0) DESC, id DESC) rn FROM en) WHERE rn = 1),
reg AS (SELECT en.* FROM en JOIN er USING (id)),
g AS (SELECT DISTINCT eid AS id, lower(unnest(middleware)) AS guard FROM named),
has AS (SELECT reg.id, coalesce(bool_or(regexp_matches(guard, 'auth|jwt|token|session')), false) AS auth, coalesce(bool_or(regexp_matches(guard, 'valid|schema|dto|sanitize')), false) AS valid,
  coalesce(bool_or(regexp_matches(guard, 'rate|throttl|limit')), false) AS rate FROM reg LEFT JOIN g ON g.id = reg.id GROUP BY 1)"""


def _endpoint_graph(spark, sf):
    scratch = Scratch(spark, "endpoints")
    return tuple(map(scratch.put, index.graph_of_endpoints(table(spark, sf, "endpoints"))))


@query(
    """WITH ep AS (SELECT DISTINCT method, path, handler, file_path, middleware FROM endpoints WHERE method IS NOT NULL AND path IS NOT NULL AND file_path IS NOT NULL),
g AS (SELECT file_path, unnest(middleware) AS guard FROM ep)
SELECT DISTINCT substr(sha256('endpoint:' || method || ' ' || path || ':' || file_path), 1, 16) AS id, 'endpoint' AS type, method || ' ' || path AS qualified_name FROM ep
UNION SELECT substr(sha256('function:' || handler || ':' || file_path), 1, 16), 'function', handler FROM ep WHERE handler IS NOT NULL
UNION SELECT substr(sha256('middleware:' || guard || ':' || file_path), 1, 16), 'middleware', guard FROM g WHERE guard IS NOT NULL"""
)
def build_nodes(spark, sf):
    return index.graph_of_endpoints(table(spark, sf, "endpoints"))[0].select("id", "type", "qualified_name").where("qualified_name is not null")


@query(
    """WITH ep AS (SELECT DISTINCT method, path, handler, file_path, middleware FROM endpoints WHERE method IS NOT NULL AND path IS NOT NULL AND file_path IS NOT NULL),
x AS (SELECT *, substr(sha256('endpoint:' || method || ' ' || path || ':' || file_path), 1, 16) AS eid FROM ep), g AS (SELECT eid, file_path, unnest(middleware) AS guard FROM x)
SELECT DISTINCT eid AS source, substr(sha256('function:' || handler || ':' || file_path), 1, 16) AS target, 'calls' AS type FROM x WHERE handler IS NOT NULL
UNION SELECT eid, substr(sha256('middleware:' || guard || ':' || file_path), 1, 16), 'secured_by' FROM g WHERE guard IS NOT NULL"""
)
def build_edges(spark, sf):
    return index.graph_of_endpoints(table(spark, sf, "endpoints"))[1].select("source", "target", "type")


_SHOWN = ["endpoint", "rule", "severity", "title", "file_path", "line_number"]


@query(
    f"""WITH {_EP_NODES}, j AS (SELECT reg.*, has.auth, has.valid, has.rate FROM reg JOIN has USING (id)), m AS (SELECT *, method IN ('POST', 'PUT', 'DELETE', 'PATCH') AS mut FROM j)
SELECT name AS endpoint, 'R1a' AS rule, 'critical' AS severity, 'Missing Authentication on Mutation Endpoint' AS title, file_path, line_start AS line_number FROM m WHERE NOT auth AND mut
UNION ALL SELECT name, 'R1b', 'medium', 'No Authentication on GET Endpoint', file_path, line_start FROM m WHERE NOT auth AND NOT mut
UNION ALL SELECT name, 'R1c', 'info', 'Authentication Present', file_path, line_start FROM m WHERE auth
UNION ALL SELECT name, 'R2', 'high', 'Missing Input Validation', file_path, line_start FROM m WHERE NOT valid AND method IN ('POST', 'PUT', 'PATCH')
UNION ALL SELECT name, 'R4', 'medium', 'Missing Rate Limiting', file_path, line_start FROM m WHERE NOT rate AND mut"""
)
def missing_middleware(spark, sf):
    return rules.middleware_rules(*_endpoint_graph(spark, sf)).select(*_SHOWN)


@query(
    f"""WITH {_N}, {_REG}, seen AS (SELECT coalesce(bool_or(contains(lower(qualified_name), 'helmet')), false) AS helmet, coalesce(bool_or(contains(lower(qualified_name), 'cors')), false) AS cors FROM n WHERE type = 'middleware')
SELECT reg.name AS endpoint, 'R5' AS rule FROM reg, seen WHERE NOT helmet UNION ALL SELECT reg.name, 'R6' FROM reg, seen WHERE NOT cors"""
)
def global_missing(spark, sf):
    return rules.project_rules(_nodes(spark, sf)).select("endpoint", "rule")


_SOURCES = r""", f AS (SELECT file_path, replace(replace(text, E'\r\n', E'\n'), E'\r', E'\n') AS text FROM parse_results WHERE text IS NOT NULL),
src AS (SELECT n.id, n.type, n.file_path, n.line_start, array_to_string(list_slice(string_split(f.text, E'\n'), greatest(coalesce(n.line_start, 1), 1), coalesce(n.line_end, n.line_start + 30, 0)), E'\n') AS source
  FROM n JOIN f ON f.file_path = n.file_path)"""
_RX = {"r3": r"query\s*\(\s*[`\"''].*?\$\{", "r7": r"(?s)(?:for\s*\(|\.forEach\s*\(|\.map\s*\().*?(?:\.find|\.query|\.get|\.fetch|\.select)", "pg": "(?i)limit|offset|page|skip|take|cursor", "r10": r"(?i)SELECT\s+\*"}


@query(
    _NE + _REACH.format(depth=4) + _SOURCES + f""", ep AS (SELECT n.id, reg.name, coalesce(n.http_method, 'GET') AS method, coalesce(n.http_path, reg.name) AS path FROM n JOIN reg ON reg.id = n.id),
h AS (SELECT ep.id, ep.name, src.id AS node, src.type, src.source FROM ep JOIN reach ON reach.seed = ep.id AND reach.hops BETWEEN 1 AND 4 JOIN src ON src.id = reach.node WHERE src.source <> ''),
db AS (SELECT DISTINCT reach.seed FROM reach JOIN n ON n.id = reach.node WHERE n.type = 'repository' AND reach.hops BETWEEN 1 AND 4),
pg AS (SELECT DISTINCT reach.seed FROM reach JOIN src ON src.id = reach.node WHERE reach.hops BETWEEN 1 AND 3 AND regexp_matches(src.source, '{_RX["pg"]}'))
SELECT name AS endpoint, 'R3' AS rule FROM h WHERE type IN ('service', 'repository') AND regexp_matches(source, '{_RX["r3"]}')
UNION ALL SELECT name, 'R7' FROM h WHERE type IN ('service', 'repository') AND regexp_matches(source, '{_RX["r7"]}')
UNION ALL SELECT name, 'R8' FROM ep WHERE method = 'GET' AND id IN (SELECT seed FROM db)
UNION ALL SELECT name, 'R9' FROM ep WHERE method = 'GET' AND (NOT regexp_matches(path, '/:\\w+') OR ends_with(path, '/')) AND id NOT IN (SELECT seed FROM pg)
UNION ALL SELECT name, 'R10' FROM h WHERE type = 'repository' AND regexp_matches(source, '{_RX["r10"]}')"""
)
def reach_pattern_rules(spark, sf):
    nodes, edges = _kept(spark, sf)
    reached = Scratch(spark, "reached").put(graph.reach(edges, nodes.where("type = 'endpoint'").select("id"), 5))
    return rules.reach_rules(nodes, edges, _files(spark, sf), reached).select("endpoint", "rule")


_LAYER = "CASE {t} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LAYERS.items()) + " END"


_LIFTED = """, up AS (SELECT e.source, min(e.target) AS owner FROM e JOIN n ON n.id = e.source WHERE e.type = 'belongs_to' AND n.type = 'function' GROUP BY 1),
lifted AS (SELECT DISTINCT coalesce(a.owner, e.source) AS source, coalesce(b.owner, e.target) AS target FROM e LEFT JOIN up a ON a.source = e.source LEFT JOIN up b ON b.source = e.target WHERE e.type = 'calls')"""


@query(f"WITH {_N}, {_E}{_LIFTED} SELECT l.source, l.target, {_LAYER.format(t='b.type')} - {_LAYER.format(t='a.type')} AS gap FROM lifted l JOIN n a ON a.id = l.source JOIN n b ON b.id = l.target WHERE {_LAYER.format(t='b.type')} - {_LAYER.format(t='a.type')} > 0")
def layer_violations(spark, sf):
    """Calls between the classes that functions belong to, which go down by a layer or more."""
    nodes, edges = _nodes(spark, sf), _edges(spark, sf)
    return rules.layer_violations(nodes, graph.lifted(nodes, edges), 0).select("source", "target", "gap")


@query(f"WITH {_N}, {_E} SELECT d.source, d.out_degree FROM (SELECT source, count(DISTINCT target) AS out_degree FROM e GROUP BY 1) d LEFT JOIN n ON n.id = d.source WHERE d.out_degree > 2 AND coalesce(n.type, '') <> 'file'")
def high_coupling(spark, sf):
    return rules.coupled(_nodes(spark, sf), _edges(spark, sf), 2).select("source", "out_degree")


@query(f"WITH {_N} SELECT id, CAST(greatest(coalesce(line_end - line_start, 0), 0) AS INT) AS span FROM n WHERE type IN ('controller', 'service', 'repository', 'class') AND coalesce(line_end - line_start, 0) > 20")
def god_class_size(spark, sf):
    return rules.oversized(_nodes(spark, sf), 20).select("id", "span")


@query(f"WITH {_N} SELECT regexp_replace(qualified_name, '\\.[^.]*$', '') AS class_name, count(*) AS methods FROM n WHERE kind = 'method' AND contains(qualified_name, '.') GROUP BY 1 HAVING count(*) > 1")
def god_class_methods(spark, sf):
    return rules.crowded(_nodes(spark, sf), 1).select("class_name", "methods")


_TRADE = """supply AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)"""


def _trade(spark, sf):
    """A graph that meets the limits of the rules: suppliers as controllers of the parts they supply, which are their methods
    and repositories; spans are account balances; nations form rings."""
    supply = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    suppliers = table(spark, sf, "supplier")
    names = suppliers.select(F.col("s_suppkey").alias("s"), "s_name")
    null, no_map, one = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>"), F.lit(1)
    make = lambda df, i, kind, name, end, symbol=null: df.select(
        i.alias("id"), F.lit(kind).alias("type"), name.alias("qualified_name"), F.lit("trade").alias("file_path"), one.alias("line_start"), end.cast("int").alias("line_end"),
        null.alias("provenance"), symbol.alias("kind"), null.alias("http_method"), null.alias("http_path"), no_map.alias("metadata"), F.lit(1).cast("long").alias("seq"),
    )
    of = lambda kind, c: F.concat(F.lit(kind), c)
    nation = table(spark, sf, "nation")
    nodes = [
        make(suppliers, of("s", F.col("s_suppkey")), "controller", F.col("s_name"), 1 + F.floor(F.abs("s_acctbal"))),
        make(supply.join(names, "s"), F.concat_ws("m", "s", "p"), "function", F.concat_ws(".", "s_name", "p"), one, F.lit("method")),
        make(table(spark, sf, "part"), of("p", F.col("p_partkey")), "repository", F.col("p_name"), one),
        make(nation, of("n", F.col("n_nationkey")), "file", F.format_string("%02d", "n_nationkey"), one),
    ]
    edge = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight"), null.alias("provenance"), no_map.alias("metadata"), F.lit(1).cast("long").alias("seq"))
    k = F.col("n_nationkey")
    ring = F.when(k < 9, (k + 1) % 9).otherwise(9 + (k - 8) % 16)
    edges = [edge(supply, of("s", F.col("s")), of("p", F.col("p")), "calls"), edge(nation, of("n", k), of("n", ring), "depends_on")]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


@query(
    f"""WITH {_TRADE}, x AS (SELECT generate_series AS k FROM generate_series(0, 24))
SELECT 'R11' AS rule, 'Controller ' || s_name || ' calls Repository ' || p_name || ' past a layer.' AS description FROM supply JOIN supplier ON s_suppkey = s JOIN part ON p_partkey = p
UNION ALL SELECT 'R12', string_agg(printf('%02d', k), ' → ' ORDER BY k) || ' → ' || printf('%02d', min(k)) FROM x GROUP BY k < 9
UNION ALL SELECT 'R13', 'Controller ' || s_name || ' has ' || count(*) || ' outbound edges.' FROM supply JOIN supplier ON s_suppkey = s GROUP BY s, s_name HAVING count(*) > 10
UNION ALL SELECT 'R14', 'Class ' || s_name || ' has ' || CAST(floor(abs(s_acctbal)) AS INT) || ' lines.' FROM supplier WHERE floor(abs(s_acctbal)) > 500
UNION ALL SELECT 'R15', 'Class ' || s_name || ' has ' || count(*) || ' methods.' FROM supply JOIN supplier ON s_suppkey = s GROUP BY s_name HAVING count(*) > 15"""
)
def architecture_limits(spark, sf):
    """R11 to R15 at their own limits, with rings of nine and sixteen files."""
    scratch = Scratch(spark, "trade")
    return rules.architecture_rules(*map(scratch.put, _trade(spark, sf))).select("rule", "description")


@query()
def architecture_findings(spark, sf):
    return rules.architecture_rules(*_kept(spark, sf))


@query(_NE + _REACH.format(depth=5) + f""", lv AS (SELECT e.source FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.type = 'calls' AND {_LAYER.format(t='b.type')} - {_LAYER.format(t='a.type')} > 1)
SELECT reg.name AS endpoint, 'R11' AS rule FROM reach JOIN reg ON reg.id = reach.seed JOIN lv ON lv.source = reach.node
UNION ALL SELECT reg.name, 'R13' FROM reach JOIN reg ON reg.id = reach.seed JOIN (SELECT source FROM e GROUP BY 1 HAVING count(DISTINCT target) > 2) c ON c.source = reach.node JOIN n ON n.id = c.source WHERE n.type <> 'file'""")
def scoped_architecture(spark, sf):
    nodes, edges = _kept(spark, sf)
    reached = graph.reach(edges, nodes.where("type = 'endpoint'").select("id"), 5)
    return rules.scoped_architecture(nodes, edges, reached, 2).select("endpoint", "rule")


@query(f"WITH {_N}, {_REG} SELECT DISTINCT endpoint, 'Endpoint Not Found' AS title FROM findings WHERE endpoint IS NOT NULL AND endpoint NOT IN (SELECT name FROM reg)")
def endpoint_not_found(spark, sf):
    return rules.not_found(spark, table(spark, sf, "findings").where("endpoint is not null"), _nodes(spark, sf)).select("endpoint", "title")


# source text

_CALLS = r"(?:this\.)?(\w+)\.(\w+)\s*\("


@query(f"WITH {_N}{_SOURCES} SELECT id, source FROM src")
def line_slice(spark, sf):
    return rules.node_sources(_nodes(spark, sf), _files(spark, sf), 30).select("id", "source")


@query("SELECT DISTINCT symbol_id, CAST(len(regexp_extract_all(source_code, '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+|[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\s\\x{85}\\p{Z}]')) AS INT) AS tokens FROM symbols WHERE source_code IS NOT NULL")
def token_counts(spark, sf):
    return table(spark, sf, "symbols").where("source_code is not null").select("symbol_id", text.token_count(F.col("source_code")).alias("tokens")).distinct()


@query(
    r"""SELECT DISTINCT symbol_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(source_code, E'\r\n', E'\n'), E'\r', E'\n'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '\n{3,}', E'\n\n', 'g'), '^\n+', ''), '\n+$', '') AS source_code FROM symbols"""
)
def normalize_whitespace(spark, sf):
    return table(spark, sf, "symbols").select("symbol_id", text.normalize_whitespace(F.col("source_code")).alias("source_code")).distinct()


_TAIL = r"""^((?:"(?:\\.|[^"\\])*(?:"|$)|''(?:\\.|[^''\\])*(?:''|$)|`(?:\\.|[^`\\])*(?:`|$)|\\.|[^"''`\\])*?)//"""


@query(
    rf"""WITH s AS (SELECT DISTINCT symbol_id, source_code FROM symbols),
l AS (SELECT symbol_id, source_code, list_filter(string_split(regexp_replace(source_code, '/\*[^*](?s:.*?)\*/', '', 'g'), E'\n'), lambda x: NOT regexp_matches(x, '^\s*(?://(?:[^/]|$)|#(?:[^!]|$))')) AS ls FROM s)
SELECT symbol_id, array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '{_TAIL}') THEN rtrim(regexp_extract(x, '{_TAIL}', 1)) ELSE x END), E'\n') AS source_code FROM l"""
)
def strip_comments(spark, sf):
    return table(spark, sf, "symbols").select("symbol_id", text.strip_comments(F.col("source_code")).alias("source_code")).distinct()


@query()
def prune_imports(spark, sf):
    return spread(_files(spark, sf)).select("file_path", text.prune_imports(F.col("text")).alias("text"))


@query()
def summarize_methods(spark, sf):
    return spread(_files(spark, sf)).select("file_path", text.summarize_methods(F.col("text"), {"constructor"}).alias("text"))


@query()
def compressed_sources(spark, sf):
    rows = spread(_files(spark, sf)).select("file_path", "text", text.compress(F.col("text"), 200, set()).alias("short"))
    before, after = text.token_count(F.col("text")), text.token_count(F.col("short"))
    return rows.select("file_path", before.alias("tokens_before"), after.alias("tokens_after"), "short")




@query(
    f"""SELECT symbol_id, callee, count(*) AS n FROM (SELECT symbol_id, unnest(list_transform(list_zip(regexp_extract_all(source_code, '{_CALLS}', 1), regexp_extract_all(source_code, '{_CALLS}', 2)), lambda p: p[1] || '.' || p[2])) AS callee
    FROM (SELECT DISTINCT symbol_id, source_code FROM symbols WHERE kind = 'method')) GROUP BY 1, 2"""
)
def call_sites(spark, sf):
    rows = table(spark, sf, "symbols").where("kind = 'method'").select("symbol_id", "source_code").distinct()
    return rows.select("symbol_id", F.explode(text.call_sites(F.col("source_code"))).alias("callee")).groupBy("symbol_id", "callee").agg(F.count("*").alias("n"))


def _parsed(spark, sf):
    files = table(spark, sf, "parse_results").select(F.col("file_path").alias("path"), F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    files = files.withColumn("language", ident.language(F.col("path")))
    return files, Scratch(spark, "parsed").put(parse.parsed(files))


@query()
def parsed_symbols(spark, sf):
    return _parsed(spark, sf)[1].select("language", F.explode("symbols").alias("s")).select("language", "s.*")


@query()
def parsed_imports(spark, sf):
    return _parsed(spark, sf)[1].select("path", F.explode("imports").alias("i")).select("path", "i.module", "i.line")


@query()
def parsed_exports(spark, sf):
    return _parsed(spark, sf)[1].select("path", F.explode("exports").alias("x")).select("path", "x.*")


@query()
def parsed_errors(spark, sf):
    return _parsed(spark, sf)[1].select("path", F.explode("errors").alias("e")).select("path", "e.*")


@query()
def resolved_imports(spark, sf):
    files, done = _parsed(spark, sf)
    found = done.select(F.col("path").alias("file_path"), F.explode("imports.module").alias("module")).distinct()
    return scan.resolve_imports(found, files)


_IMPORTED = r"""i AS (SELECT DISTINCT file_path, kind, CASE kind WHEN 0 THEN './' || regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]*$', '') WHEN 1 THEN '../' || regexp_extract(file_path, '([^/]*)/[^/]*$', 1) || '/./' || regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]*$', '') ELSE '@/' || regexp_replace(file_path, '\.[^.]*$', '') END AS module
  FROM parse_results, (SELECT unnest([0, 1, 2]) AS kind) WHERE contains(file_path, '/'))"""


@query(
    f"""WITH {_IMPORTED}, t AS (SELECT file_path, module, s.rank, regexp_replace(file_path, '\\.[^./]*$', '') || s.suffix AS path FROM i, (SELECT unnest(range(7)) AS rank, unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.js']) AS suffix) s)
SELECT file_path, module, arg_min(path, rank) AS resolved FROM t WHERE path IN (SELECT file_path FROM parse_results) GROUP BY 1, 2"""
)
def import_resolution(spark, sf):
    """Each file's own name, written as imports from its folder, from the folder above and by an alias."""
    p = F.col("file_path")
    base = F.regexp_replace(F.regexp_extract(p, "[^/]*$", 0), r"\.[^.]*$", "")
    ways = [F.concat(F.lit("./"), base), F.concat(F.lit("../"), F.regexp_extract(p, "([^/]*)/[^/]*$", 1), F.lit("/./"), base), F.concat(F.lit("@/"), F.regexp_replace(p, r"\.[^.]*$", ""))]
    files = table(spark, sf, "parse_results").select("file_path", p.alias("path"))
    imports = files.where(p.contains("/")).select("file_path", F.explode(F.array(*ways)).alias("module")).distinct()
    return scan.resolve_imports(imports, files, {"@": ""})


_ROLE = _role_sql().split("CASE ", 1)[1].split(" END AS role", 1)[0]
_TABLED = f"""s AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY symbol_id) AS place FROM (SELECT DISTINCT symbol_id, file_path, name, qualified_name, kind, line_start, line_end, decorators, source_code FROM symbols WHERE file_path IS NOT NULL AND qualified_name IS NOT NULL AND kind IS NOT NULL)),
f AS (SELECT DISTINCT file_path FROM s), fid AS (SELECT file_path, substr(sha256('file:' || file_path || ':' || file_path), 1, 16) AS file_id FROM f),
w AS (SELECT *, substr(sha256(kind || ':' || qualified_name || ':' || file_path), 1, 16) AS id, lower(array_to_string(coalesce(decorators, []), ' ')) AS d FROM s)"""


def _tabled(spark, sf):
    """The symbols table in the form the parsers give: a row for each file."""
    s = table(spark, sf, "symbols").where("file_path is not null and qualified_name is not null and kind is not null")
    s = s.select("symbol_id", "file_path", "name", "qualified_name", "kind", "line_start", "line_end", "decorators", "source_code").distinct()
    own = F.struct(
        "symbol_id", "name", "qualified_name", "kind", "file_path", "line_start", "line_end", "decorators", F.array().cast("array<string>").alias("parameters"),
        F.lit(None).cast("string").alias("parent"), F.coalesce(text.call_sites(F.col("source_code")), F.array().cast("array<string>")).alias("calls"),
    )
    empty = {"imports": parse.IMPORT, "exports": parse.EXPORT, "errors": parse.PARSE_ERROR, "routes": parse.ROUTE}
    rows = s.groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(own)).alias("symbols"))  # of one file
    return rows.select("path", "symbols", *(F.array().cast(f"array<{t}>").alias(c) for c, t in empty.items()))


@query(
    f"""WITH {_TABLED} SELECT id, type, qualified_name, line_start FROM (SELECT id, CASE {_ROLE} END AS type, qualified_name, line_start, row_number() OVER (PARTITION BY id ORDER BY place DESC) AS rn FROM w) WHERE rn = 1
UNION ALL SELECT file_id, 'file', file_path, 1 FROM fid"""
)
def built_nodes(spark, sf):
    """The index's own builder over the symbols table."""
    done = _tabled(spark, sf)
    return index.build(done, done)[0].select("id", "type", "qualified_name", "line_start")


@query(
    f"""WITH {_TABLED}, c AS (SELECT DISTINCT id AS source, substr(sha256('method:' || callee || ':' || file_path), 1, 16) AS target, 'calls' AS type FROM (
  SELECT id, file_path, unnest(list_transform(list_zip(regexp_extract_all(source_code, '{_CALLS}', 1), regexp_extract_all(source_code, '{_CALLS}', 2)), lambda p: p[1] || '.' || p[2])) AS callee FROM w WHERE kind IN ('method', 'function')))
SELECT * FROM c UNION SELECT id, file_id, 'belongs_to' FROM w JOIN fid USING (file_path)"""
)
def built_edges(spark, sf):
    done = _tabled(spark, sf)
    return index.build(done, done)[1].select("source", "target", "type")


@query()
def indexed_nodes(spark, sf):
    files, done = _parsed(spark, sf)
    return index.build(done, files)[0].drop("metadata")


@query()
def indexed_edges(spark, sf):
    files, done = _parsed(spark, sf)
    return index.build(done, files)[1].drop("metadata")


# context


@query()
def context_snippets(spark, sf):
    """Of every endpoint of the registry, within the operator's own depth."""
    nodes, edges = _kept(spark, sf)
    return context.snippets(nodes, edges, _files(spark, sf), _seeds(nodes), "full", 4000)


_CHOSEN = "c AS (SELECT DISTINCT file_path AS seed, snippet_id, node_id, node_type, qualified_name, file_path, line_start, line_end, source_code, relevance_score, token_count FROM snippets WHERE file_path IS NOT NULL)"


def _chosen(spark, sf):
    return table(spark, sf, "snippets").where("file_path is not null").withColumn("seed", F.col("file_path")).distinct()


@query(
    f"""WITH {_CHOSEN}, m AS (SELECT seed, count(*) AS total_nodes FROM (SELECT DISTINCT file_path AS seed, qualified_name FROM symbols WHERE file_path IS NOT NULL) GROUP BY 1),
k AS (SELECT seed, count(*) AS n, sum(token_count) AS tokens, sum(octet_length(encode(source_code))) AS bytes FROM c GROUP BY 1)
SELECT m.seed, m.total_nodes, coalesce(k.n, 0) AS selected_nodes, CAST(coalesce(k.tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(k.bytes, 0) AS BIGINT) AS bytes, 1 - coalesce(k.n, 0) / m.total_nodes AS compression_ratio FROM m LEFT JOIN k USING (seed)"""
)
def context_summary(spark, sf):
    """Of the snippets of each file against its symbols."""
    members = table(spark, sf, "symbols").where("file_path is not null").select(F.col("file_path").alias("seed"), F.col("qualified_name").alias("node")).distinct()
    return context.summary(_chosen(spark, sf), members)


@query(
    f"""WITH {_CHOSEN} SELECT seed, string_agg('// === ' || qualified_name || ' (' || coalesce(node_type, 'null') || ') - ' || file_path || ':' || line_start || '-' || line_end || E' ===\n' || source_code || E'\n', E'\n' ORDER BY relevance_score DESC, node_id, snippet_id) AS text
FROM c WHERE source_code IS NOT NULL AND relevance_score IS NOT NULL GROUP BY 1"""
)
def rendered_context(spark, sf):
    rows = _chosen(spark, sf).where("source_code is not null and relevance_score is not null")
    order = F.concat_ws(" ", "node_id", F.format_string("%020d", "snippet_id"))
    return context.rendered(rows.withColumn("node_id", order))


@query(
    "SELECT model, sum(context_size_bytes) AS before_bytes, sum(compressed_size_bytes) AS after_bytes, round(CASE WHEN sum(context_size_bytes) > 0 THEN 1 - sum(compressed_size_bytes) / sum(context_size_bytes) ELSE 0 END, 9) AS ratio, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens FROM (SELECT DISTINCT * FROM token_usage_log) GROUP BY 1"
)
def compression_ratio(spark, sf):
    rows = table(spark, sf, "token_usage_log").distinct().groupBy("model").agg(
        F.sum("context_size_bytes").alias("before_bytes"), F.sum("compressed_size_bytes").alias("after_bytes"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )
    ratio = F.when(F.col("before_bytes") > 0, 1 - F.col("after_bytes") / F.col("before_bytes")).otherwise(0.0)
    return rows.select("model", "before_bytes", "after_bytes", F.round(ratio, 9).alias("ratio"), "prompt_tokens", "completion_tokens")


# reports

_RANK = "CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"


@query(f"SELECT engine, severity, CAST({_RANK} AS INT) AS rank, count(*) AS n FROM findings GROUP BY ALL")
def severity_report(spark, sf):
    return table(spark, sf, "findings").groupBy("engine", "severity", ident.severity_rank(F.col("severity")).alias("rank")).agg(F.count("*").alias("n"))


@query("SELECT engine, severity, count(*) AS n FROM findings GROUP BY ROLLUP (engine, severity)")
def severity_rollup(spark, sf):
    return reports.severity_rollup(table(spark, sf, "findings"), ["engine", "severity"])


@query("SELECT endpoint, title, arg_min(severity, finding_id) AS severity, min(finding_id) AS finding_id FROM findings GROUP BY 1, 2")
def first_by_title(spark, sf):
    return reports.first_by_title(table(spark, sf, "findings").select("endpoint", "title", "severity", "finding_id"), ["endpoint"], ["finding_id"])


@query(
    "SELECT finding_id, endpoint, title FROM findings WHERE engine = 'security' UNION ALL SELECT f.finding_id, f.endpoint, f.title FROM findings f WHERE f.engine <> 'security' AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.engine = 'security' AND g.endpoint = f.endpoint AND g.title = f.title)"
)
def merge_static(spark, sf):
    f = table(spark, sf, "findings").select("finding_id", "endpoint", "title", "engine")
    return reports.merge_static(f.where("engine = 'security'").drop("engine"), f.where("engine <> 'security'").drop("engine"), ["endpoint"])


@query(
    """WITH r AS (SELECT endpoint, engine, count(*) > 0 AS has_finding, bool_or(coalesce(file_path, '') <> '') AS p, bool_or(coalesce(recommendation, '') <> '') AS rec, bool_or(coalesce(description, '') <> '') AS s FROM findings GROUP BY 1, 2),
k AS (SELECT endpoint, count(*) AS n, bool_or(p) AS p, bool_or(rec) AS rec, bool_and(engine IS NOT NULL) AS st, bool_and(has_finding OR s) AS ne FROM r GROUP BY 1)
SELECT endpoint, round(CASE WHEN n >= 3 THEN 0.3 ELSE 0 END + CASE WHEN p THEN 0.2 ELSE 0 END + CASE WHEN rec THEN 0.2 ELSE 0 END + CASE WHEN st THEN 0.2 ELSE 0 END + CASE WHEN ne THEN 0.1 ELSE 0 END, 6) AS confidence,
CAST((NOT n >= 3)::INT + (NOT p)::INT + (NOT rec)::INT + (NOT ne)::INT AS INT) AS gaps FROM k WHERE endpoint IS NOT NULL"""
)
def confidence_score(spark, sf):
    filled = lambda c: F.bool_or(F.coalesce(F.col(c), F.lit("")) != "")
    results = table(spark, sf, "findings").where("endpoint is not null").groupBy("endpoint", F.col("engine").alias("check")).agg(
        F.lit(True).alias("has_finding"), filled("file_path").alias("has_path"), filled("recommendation").alias("has_recommendation"), filled("description").alias("has_summary")
    )
    planned = results.select("endpoint").distinct().withColumn("steps", F.lit(3))
    return reports.conditions(results, "endpoint", planned).select("endpoint", "confidence", F.size("gaps").alias("gaps"))


@query()
def endpoint_reports(spark, sf):
    f = table(spark, sf, "findings").where("endpoint is not null").withColumn("seq", F.col("finding_id"))
    return reports.nested(f.select("endpoint", "title", "severity", "description", "file_path", "line_number", "recommendation", "seq"), "endpoint")


@query("SELECT language, arg_max(name, (framework_confidence, name)) AS name, max(framework_confidence) AS confidence FROM projects WHERE framework_confidence > 0.5 GROUP BY 1")
def plugin_arbitration(spark, sf):
    order = F.row_number().over(Window.orderBy(F.col("name").desc()))  # few projects
    p = table(spark, sf, "projects").select("language", "name", F.col("framework_confidence").alias("confidence"), order.alias("order"))
    return scan.arbitrate(p, "language").select("language", "name", "confidence")


# changes and events

_CHANGES = """c AS (SELECT DISTINCT run_id, log_seq AS seq, file_id AS path, content_hash FROM parse_log),
l AS (SELECT *, lag(content_hash) OVER (PARTITION BY run_id, path ORDER BY seq) AS before FROM c),
b AS (SELECT run_id, path, max(CASE WHEN before IS NULL OR before <> content_hash THEN seq END) AS seq, min(seq) AS first_seen FROM l GROUP BY 1, 2)"""


def _log_changes(spark, sf):
    log = table(spark, sf, "parse_log").select("run_id", F.col("log_seq").alias("seq"), F.col("file_id").alias("path"), "content_hash").distinct()
    return log.withColumn("type", F.lit("modified")).withColumn("old_path", F.lit(None).cast("string"))


@query(f"WITH {_CHANGES} SELECT b.run_id, b.path, 'modified' AS type, c.content_hash, b.first_seen FROM b JOIN c ON c.run_id = b.run_id AND c.path = b.path AND c.seq = b.seq")
def change_batches(spark, sf):
    return changes.coalesced(_log_changes(spark, sf), ["run_id"], filtered=False).select("run_id", "path", "type", "content_hash", "first_seen")


@query(f"WITH {_CHANGES} SELECT run_id, count(*) AS updated, CAST(0 AS BIGINT) AS deleted, count(*) AS total FROM b GROUP BY 1")
def change_stats(spark, sf):
    return changes.change_stats(changes.coalesced(_log_changes(spark, sf), ["run_id"], filtered=False), ["run_id"])


@query("SELECT DISTINCT 'old/' || file_path AS path, 'deleted' AS type, '' AS content_hash FROM file_index UNION ALL SELECT DISTINCT file_path, 'created', content_hash FROM file_index")
def move_explode(spark, sf):
    f = table(spark, sf, "file_index").select(F.lit("moved").alias("type"), F.col("file_path").alias("path"), F.concat(F.lit("old/"), "file_path").alias("old_path"), "content_hash")
    return changes.exploded_moves(f).select("path", "type", "content_hash").distinct()


_VERSIONS = """v AS (SELECT file_path AS path, arg_min(content_hash, (updated_at, content_hash)) AS was, arg_max(content_hash, (updated_at, content_hash)) AS is_now, count(DISTINCT updated_at) AS n, max(updated_at) AS t FROM file_index GROUP BY 1)"""


@query(f"WITH {_VERSIONS} SELECT path, CASE WHEN n > 1 THEN 'modified' ELSE 'created' END AS type, CAST(NULL AS VARCHAR) AS old_path, is_now AS content_hash FROM v WHERE n = 1 OR was <> is_now")
def snapshot_changes(spark, sf):
    """Files as first listed, of those with several versions, against files as they are."""
    at = F.struct("updated_at", "content_hash")
    v = table(spark, sf, "file_index").groupBy(F.col("file_path").alias("path")).agg(
        F.min_by("content_hash", at).alias("was"), F.max_by("content_hash", at).alias("now"), F.countDistinct("updated_at").alias("n")
    )
    before = v.where("n > 1").select("path", F.col("was").alias("content_hash"))
    return changes.snapshot_changes(before, v.select("path", F.col("now").alias("content_hash")))


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    w = changes.tumbling(table(spark, sf, "events"), "ts", ["event_type"])
    return w.select("event_type", F.unix_timestamp("window.start").alias("start"), "n", F.round("total", 6).alias("total"))


@query(
    """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, sf):
    s = changes.sessions(table(spark, sf, "events"), "ts", "user_id")
    return s.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n", F.round("total", 6).alias("total"))


@query("SELECT language, count(*) AS files, sum(symbols_count) AS symbols, sum(imports_count) AS imports FROM (SELECT DISTINCT * FROM file_index) GROUP BY 1")
def index_stats(spark, sf):
    return table(spark, sf, "file_index").distinct().groupBy("language").agg(F.count("*").alias("files"), F.sum("symbols_count").alias("symbols"), F.sum("imports_count").alias("imports"))


@query(f"WITH {_N}, {_E} SELECT (SELECT count(*) FROM (SELECT DISTINCT file_path FROM file_index)) AS files, (SELECT count(*) FROM (SELECT DISTINCT id FROM endpoints)) AS endpoints, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def index_totals(spark, sf):
    files, eps = table(spark, sf, "file_index").select("file_path").distinct(), table(spark, sf, "endpoints").select("id").distinct()
    return index.stats(files, {"endpoints": eps, "nodes": _nodes(spark, sf), "edges": _edges(spark, sf)})


def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of all engines over the graph tables, ranked."""
    nodes, edges = _kept(spark, sf)
    reached = Scratch(spark, "reached").put(graph.reach(edges, nodes.where("type = 'endpoint'").select("id"), 5))
    parts = [rules.middleware_rules(nodes, edges), rules.project_rules(nodes), rules.reach_rules(nodes, edges, _files(spark, sf), reached), rules.architecture_rules(nodes, edges)]
    return rules.ranked(reduce(DataFrame.unionByName, parts))


QUERIES["all_findings"] = all_findings
