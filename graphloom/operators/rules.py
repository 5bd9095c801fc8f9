"""Rule checks of all endpoints at once, as semi and anti joins over one reachability table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.ident import class_name, severity_rank, title_case
from graphloom.operators import graph
from graphloom.schema import LAYERS

# What counts as a sign of each kind of middleware in its lower-case name.
AUTH, VALIDATION, RATE, CACHE = "auth|jwt|token|session", "valid|schema|dto|sanitize", "rate|throttl|limit", "cache|redis|memo"
MUTATIONS, WITH_BODY = ["POST", "PUT", "DELETE", "PATCH"], ["POST", "PUT", "PATCH"]
COUPLING, METHODS, SPAN, CYCLES = 10, 15, 500, 5
#: Order of the checks among findings of one severity.
RULES = ["R1", "R2", "R3", "R4", "R5", "R6", "R7", "R8", "R9", "R10", "R11", "R12", "R13", "R14", "R15"]

# Engine, severity and title of each rule.
TITLES = {
    "R1a": ("security", "critical", "Missing Authentication on Mutation Endpoint"),
    "R1b": ("security", "medium", "No Authentication on GET Endpoint"),
    "R1c": ("security", "info", "Authentication Present"),
    "R2": ("security", "high", "Missing Input Validation"),
    "R3": ("security", "critical", "Potential SQL Injection"),
    "R4": ("security", "medium", "Missing Rate Limiting"),
    "R5": ("security", "low", "Missing Security Headers (Helmet)"),
    "R6": ("security", "low", "Missing CORS Configuration"),
    "R7": ("performance", "high", "N+1 Query Pattern Detected"),
    "R8": ("performance", "medium", "Missing Cache on DB-Backed GET Endpoint"),
    "R9": ("performance", "medium", "Missing Pagination on List Endpoint"),
    "R10": ("performance", "medium", "SELECT * Query Pattern"),
    "R11": ("architecture", "high", "Layer Violation Detected"),
    "R12": ("architecture", "medium", "Circular Dependency Detected"),
    "R13": ("architecture", "medium", "High Coupling Detected"),
    "R14": ("architecture", "low", "God Class: Excessive Size"),
    "R15": ("architecture", "low", "God Class: Too Many Methods"),
}
ADVICE = {
    "R1a": "Put an authentication middleware before the handler.",
    "R1b": "Authenticate callers if the data is sensitive.",
    "R1c": "Check how tokens are verified and when they expire.",
    "R2": "Validate the request body against a schema before the handler.",
    "R3": "Pass values as query parameters.",
    "R4": "Limit the rate of calls.",
    "R5": "Set security headers for all routes.",
    "R6": "State which origins may call.",
    "R7": "Load the related rows in one query.",
    "R8": "Cache answers, with a lifetime and a rule for dropping them.",
    "R9": "Return pages by limit and offset or by cursor.",
    "R10": "Name the columns that are needed.",
    "R11": "Go through the layer between.",
    "R12": "Move what both need into a module of its own.",
    "R13": "Split the module or put a facade before its parts.",
    "R14": "Split the class by responsibility.",
    "R15": "Split the class by responsibility.",
}


def endpoints(nodes: DataFrame) -> DataFrame:
    """(id, endpoint, method, path, file_path, line_start) of the registered endpoints: GET and the name where unknown."""
    reg = graph.registry(nodes)
    return nodes.join(reg, "id").select(
        "id", F.col("name").alias("endpoint"), F.coalesce("http_method", F.lit("GET")).alias("method"),
        F.coalesce("http_path", "name").alias("path"), "file_path", "line_start",
    )


def _finding(rows: DataFrame, rule: str, description: Column, endpoint=None, file_path=None, line=None) -> DataFrame:
    engine, severity, title = TITLES[rule]
    return rows.select(
        (F.lit(None).cast("string") if endpoint is None else endpoint).alias("endpoint"),
        F.lit(engine).alias("engine"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        F.lit(title).alias("title"),
        description.alias("description"),
        (F.lit(None).cast("string") if file_path is None else file_path).alias("file_path"),
        (F.lit(None).cast("int") if line is None else line).alias("line_number"),
        F.lit(ADVICE[rule]).alias("recommendation"),
        F.lit(RULES.index(rule.rstrip("abc"))).alias("seq"),
    )


def _endpoint_finding(rows: DataFrame, rule: str, text: str) -> DataFrame:
    what = F.concat_ws(" ", F.lit("Endpoint"), "method", "path", F.lit(text))
    return _finding(rows, rule, what, F.col("endpoint"), F.col("file_path"), F.col("line_start"))


def middleware_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """R1, R2 and R4: one aggregate over the middleware of each endpoint tells which kinds it has."""
    eps = endpoints(nodes)
    guards = edges.where("type = 'secured_by'").select(F.col("source").alias("id"), "target").join(
        nodes.select(F.col("id").alias("target"), F.lower("qualified_name").alias("guard")), "target"
    )
    kinds = guards.groupBy("id").agg(
        *(F.max(F.col("guard").rlike(p)).alias(k) for k, p in (("auth", AUTH), ("valid", VALIDATION), ("rate", RATE), ("cache", CACHE)))
    )
    has = lambda k: F.coalesce(F.col(k), F.lit(False))
    e = eps.join(kinds, "id", "left")
    mutation = F.col("method").isin(MUTATIONS)
    return reduce(
        DataFrame.unionByName,
        [
            _endpoint_finding(e.where(~has("auth") & mutation), "R1a", "changes data without authentication."),
            _endpoint_finding(e.where(~has("auth") & ~mutation), "R1b", "has no authentication."),
            _endpoint_finding(e.where(has("auth")), "R1c", "has authentication."),
            _endpoint_finding(e.where(~has("valid") & F.col("method").isin(WITH_BODY)), "R2", "takes input that nothing validates."),
            _endpoint_finding(e.where(~has("rate") & mutation), "R4", "has no limit of rate."),
        ],
    )


def project_rules(nodes: DataFrame) -> DataFrame:
    """R5 and R6 for every endpoint: no middleware of the project has the word in its name."""
    eps = endpoints(nodes)
    seen = nodes.where("type = 'middleware'").agg(
        F.coalesce(F.max(F.lower("qualified_name").contains("helmet")), F.lit(False)).alias("helmet"),
        F.coalesce(F.max(F.lower("qualified_name").contains("cors")), F.lit(False)).alias("cors"),
    )
    e = eps.crossJoin(F.broadcast(seen))  # one row
    return _finding(e.where("not helmet"), "R5", F.lit("No middleware sets security headers."), F.col("endpoint")).unionByName(
        _finding(e.where("not cors"), "R6", F.lit("No middleware handles other origins."), F.col("endpoint"))
    )


def node_sources(nodes: DataFrame, files: DataFrame, window: int) -> DataFrame:
    """(id, type, file_path, line_start, source): the lines of each node in ``files`` (file_path, text).

    A node without an end reaches ``window`` lines on.
    """
    end = F.coalesce("line_end", F.col("line_start") + window)
    spans = nodes.select("id", "type", "file_path", "line_start", F.col("line_start").alias("lo"), end.alias("hi"))
    return T.slices(spans, files).select("id", "type", "file_path", "line_start", "source")


def reach_rules(nodes: DataFrame, edges: DataFrame, files: DataFrame, reached: DataFrame) -> DataFrame:
    """R3, R7, R8, R9 and R10 over ``reached`` (seed, node, hops), computed once to four hops or more.

    Patterns are tested once per node, not per endpoint; only the few nodes that match meet the reachability rows.
    """
    eps = endpoints(nodes)
    near = reached.where("hops <= 4").select(F.col("seed").alias("id"), "node", "hops")
    service, repo = F.col("type") == "service", F.col("type") == "repository"
    code = node_sources(nodes, files, 30).where("source <> ''").select(
        F.col("id").alias("node"), "type", F.col("file_path").alias("n_file"), F.col("line_start").alias("n_line"),
        ((service | repo) & F.col("source").rlike(T.INTERPOLATED_SQL)).alias("r3"),
        ((service | repo) & F.col("source").rlike(T.LOOPED_QUERY)).alias("r7"),
        F.col("source").rlike(T.PAGINATION).alias("pages"),
        (repo & F.col("source").rlike(T.SELECT_STAR)).alias("r10"),
    ).where("r3 or r7 or pages or r10")
    hits = near.join(code, "node").join(eps.select("id", "endpoint"), "id")
    each = lambda flag, rule, text: _finding(
        hits.where(flag), rule, F.concat_ws(" ", F.lit(text), "n_file"), F.col("endpoint"), F.col("n_file"), F.col("n_line")
    )
    get = eps.where("method = 'GET'")
    db = near.join(nodes.where(repo).select(F.col("id").alias("node")), "node", "left_semi").select("id").distinct()
    cached = (
        edges.where("type = 'secured_by'")
        .select(F.col("source").alias("id"), F.col("target").alias("node"))
        .join(nodes.where(F.lower("qualified_name").rlike(CACHE)).select(F.col("id").alias("node")), "node", "left_semi")
        .select("id")
        .distinct()
    )
    lists = get.where(~F.col("path").rlike(r"/:\w+") | F.col("path").endswith("/"))
    paged = near.where("hops <= 3").join(code.where("pages").select("node"), "node", "left_semi").select("id").distinct()
    return reduce(
        DataFrame.unionByName,
        [
            each("r3", "R3", "A query takes text by interpolation in"),
            each("r7", "R7", "A loop runs a query for each item in"),
            _endpoint_finding(get.join(db, "id", "left_semi").join(cached, "id", "left_anti"), "R8", "reads the database each time."),
            _endpoint_finding(lists.join(paged, "id", "left_anti"), "R9", "returns a list without pages."),
            each("r10", "R10", "A query fetches all columns in"),
        ],
    )


def layer_violations(nodes: DataFrame, edges: DataFrame, allowed: int = 1) -> DataFrame:
    """(source, target, gap, ...) of calls that go down by more layers than allowed; calls upwards are none."""
    ranks = F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv))
    both = graph.with_ends(edges.where("type = 'calls'"), nodes)
    gap = F.try_element_at(ranks, F.col("tgt_type")) - F.try_element_at(ranks, F.col("src_type"))
    return both.withColumn("gap", gap).where(F.col("gap") > allowed)


def oversized(nodes: DataFrame, least: int = SPAN) -> DataFrame:
    """Nodes of classes, controllers, services and repositories that span more lines than ``least``."""
    span = F.greatest(F.coalesce(F.col("line_end") - F.col("line_start"), F.lit(0)), F.lit(0))
    kinds = F.col("type").isin("controller", "service", "repository", "class")
    return nodes.where(kinds).withColumn("span", span).where(F.col("span") > least)


def crowded(nodes: DataFrame, least: int = METHODS) -> DataFrame:
    """(class_name, methods) of classes, by name over all files, with more methods than ``least``."""
    methods = nodes.where("kind = 'method'").select(class_name(F.col("qualified_name")).alias("class_name"))
    return methods.where("class_name is not null").groupBy("class_name").agg(F.count("*").alias("methods")).where(F.col("methods") > least)


def coupled(nodes: DataFrame, edges: DataFrame, least: int = COUPLING) -> DataFrame:
    """Nodes other than files, phantoms among them, with more distinct targets than ``least``."""
    many = graph.out_degree(edges).where(F.col("out_degree") > least)
    joined = many.join(nodes.withColumnRenamed("id", "source"), "source", "left")
    return joined.where("coalesce(type, '') <> 'file'")


def architecture_rules(nodes: DataFrame, edges: DataFrame, longest_cycle: int | None = None) -> DataFrame:
    """R11 to R15 over the whole project; rings of imports may have any length unless one is given."""
    calls = layer_violations(nodes, edges)
    r11 = _finding(
        calls, "R11",
        F.concat_ws(" ", title_case(F.col("src_type")), "src_qualified_name", F.lit("calls"), title_case(F.col("tgt_type")), "tgt_qualified_name", F.lit("past a layer.")),
        file_path=F.col("src_file_path"), line=F.col("src_line_start"),
    )
    file = nodes.where("type = 'file'").select("id", "qualified_name")
    imports = (
        edges.where("type = 'depends_on'").select(F.col("source"), F.col("target"))
        .join(file.select(F.col("id").alias("source"), F.col("qualified_name").alias("a")), "source")
        .join(file.select(F.col("id").alias("target"), F.col("qualified_name").alias("b")), "target")
        .select(F.col("a").alias("source"), F.col("b").alias("target"))
    )
    rings = graph.cycles(imports, longest_cycle, CYCLES)
    r12 = _finding(rings, "R12", F.concat_ws(" → ", "cycle", F.col("cycle")[0]), file_path=F.col("cycle")[0], line=F.lit(0))
    many = coupled(nodes, edges)
    r13 = _finding(
        many, "R13", F.concat_ws(" ", title_case(F.coalesce("type", F.lit(""))), "qualified_name", F.lit("has"), "out_degree", F.lit("outbound edges.")),
        file_path=F.col("file_path"), line=F.col("line_start"),
    )
    big = oversized(nodes)
    r14 = _finding(big, "R14", F.concat_ws(" ", F.lit("Class"), "qualified_name", F.lit("has"), "span", F.lit("lines.")), file_path=F.col("file_path"), line=F.col("line_start"))
    full = crowded(nodes)
    r15 = _finding(full, "R15", F.concat_ws(" ", F.lit("Class"), "class_name", F.lit("has"), "methods", F.lit("methods.")))
    return reduce(DataFrame.unionByName, [r11, r12, r13, r14, r15])


def scoped_architecture(nodes: DataFrame, edges: DataFrame, reached: DataFrame, coupling: int = COUPLING) -> DataFrame:
    """R11 and R13 for each endpoint over what it reaches (seed, node, hops), itself included."""
    eps = endpoints(nodes).select("id", "endpoint")
    scope = reached.where("hops <= 5").select(F.col("seed").alias("id"), F.col("node").alias("source")).unionByName(
        eps.select("id", F.col("id").alias("source"))
    ).distinct().join(eps, "id")
    calls = scope.join(layer_violations(nodes, edges), "source")
    many = scope.join(coupled(nodes, edges, coupling), "source")
    return _finding(calls, "R11", F.concat_ws(" ", "src_qualified_name", F.lit("calls"), "tgt_qualified_name"), F.col("endpoint"), F.col("src_file_path"), F.col("src_line_start")).unionByName(
        _finding(many, "R13", F.concat_ws(" ", "qualified_name", "out_degree"), F.col("endpoint"), F.col("file_path"), F.col("line_start"))
    )


def not_found(spark, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """R0: asked-for endpoints (endpoint) that the registry lacks."""
    known = graph.registry(nodes).select(F.col("name").alias("endpoint"))
    return names.select("endpoint").distinct().join(known, "endpoint", "left_anti").select(
        "endpoint", F.lit("security").alias("engine"), F.lit("R0").alias("rule"), F.lit("info").alias("severity"),
        F.lit("Endpoint Not Found").alias("title"), F.concat(F.lit("The graph has no endpoint "), "endpoint").alias("description"),
        F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"),
        F.lit("Index the project again.").alias("recommendation"), F.lit(0).alias("seq"),
    )


def ranked(findings: DataFrame) -> DataFrame:
    """In order of severity, then of the checks, then of place: a total order, as Spark's sort keeps none."""
    return findings.orderBy(severity_rank(F.col("severity")), "seq", "endpoint", "file_path", "line_number", "title", "description")
