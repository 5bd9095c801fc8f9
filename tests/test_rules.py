"""A positive and a negative case for every rule, and the ranking of findings."""

import pytest

from graphloom.operators import graph, reports, rules
from graphloom.schema import EDGES, NODES


def world(spark, extra_edges=()):
    n = lambda i, t, name, f="f.ts", a=1, b=1, kind=None, m=None, p=None: (i, t, name, f, a, b, f, kind, m, p, None, 1)
    rows = [
        n("e1", "endpoint", "POST /a", m="POST", p="/a"), n("e2", "endpoint", "GET /b", m="GET", p="/b"), n("e3", "endpoint", "GET /c/:id", m="GET", p="/c/:id"),
        n("g1", "middleware", "jwtGuard"), n("g2", "middleware", "validateBody"), n("g3", "middleware", "rateLimit"), n("g4", "middleware", "redisCache"),
        n("s1", "service", "Svc.bad", "s.ts", 1, 2), n("r1", "repository", "Repo.all", "r.ts", 1, 3), n("r2", "repository", "Repo.paged", "r.ts", 4, 4),
        n("c1", "controller", "Ctl", a=1, b=600), n("c2", "controller", "Small", a=1, b=501), n("h", "function", "hub"), n("h2", "function", "edge"), n("x", "file", "x.ts"), n("y", "file", "y.ts"),
    ]
    rows += [n(f"m{i}", "class", f"Big.m{i}", kind="method") for i in range(16)] + [n(f"k{i}", "class", f"Ok.m{i}", kind="method") for i in range(15)]
    pairs = [
        ("e1", "s1", "calls"), ("s1", "r1", "calls"), ("e2", "r1", "calls"), ("e3", "r2", "calls"), ("e3", "g4", "secured_by"), ("e2", "g1", "secured_by"),
        ("c1", "r1", "calls"), ("c1", "s1", "calls"), ("s1", "c1", "calls"), ("x", "y", "depends_on"), ("y", "x", "depends_on"), ("c1", "nowhere", "calls"),
    ]
    pairs += [("h", f"m{i}", "calls") for i in range(11)] + [("h2", f"m{i}", "calls") for i in range(10)] + list(extra_edges)
    nodes = spark.createDataFrame(rows, NODES)
    edges = spark.createDataFrame([(a, b, t, 1.0, None, None, i) for i, (a, b, t) in enumerate(pairs)], EDGES)
    files = spark.createDataFrame(
        [("s.ts", "for (const u of us) { repo.find(u) }\nquery(`select ${x}`)"), ("r.ts", "db.run('SELECT  * FROM t')\nb\nc\npage(limit)"), ("f.ts", None)], "file_path string, text string"
    )
    return nodes, edges, files


def found(df):
    return {(r.endpoint, r.rule) for r in df.collect()}


def test_middleware_rules(spark):
    nodes, edges, _ = world(spark)
    assert found(rules.middleware_rules(nodes, edges)) == {
        ("POST /a", "R1a"), ("POST /a", "R2"), ("POST /a", "R4"), ("GET /b", "R1c"), ("GET /c/:id", "R1b"),
    }
    guarded = world(spark, [("e1", g, "secured_by") for g in ("g1", "g2", "g3")])
    assert found(rules.middleware_rules(guarded[0], guarded[1])) == {("POST /a", "R1c"), ("GET /b", "R1c"), ("GET /c/:id", "R1b")}


def test_project_rules(spark):
    nodes, _, _ = world(spark)
    assert {r for _, r in found(rules.project_rules(nodes))} == {"R5", "R6"}
    helmet = nodes.unionByName(nodes.where("id = 'g1'").withColumn("qualified_name", nodes.type.substr(1, 0)).replace("", "Helmet", "qualified_name"))
    assert {r for _, r in found(rules.project_rules(helmet))} == {"R6"}


def test_reach_rules(spark):
    nodes, edges, files = world(spark)
    reached = graph.reach(edges, nodes.where("type = 'endpoint'").select("id"), 5)
    assert found(rules.reach_rules(nodes, edges, files, reached)) == {
        ("POST /a", "R3"), ("POST /a", "R7"), ("POST /a", "R10"), ("GET /b", "R10"), ("GET /b", "R8"), ("GET /b", "R9"),
    }


def test_architecture_rules(spark):
    nodes, edges, _ = world(spark)
    got = rules.architecture_rules(nodes, edges).collect()
    by = {}
    for r in got:
        by.setdefault(r.rule, []).append(r.description)
    # controller to repository and endpoint to repository skip layers; upward calls do not count
    assert len(by["R11"]) == 4 and len(by["R12"]) == 1 and len(by["R14"]) == 1 and len(by["R15"]) == 1
    assert [d for d in by["R13"] if "hub" in d] and not [d for d in by["R13"] if "Function edge " in d]
    assert "x.ts → y.ts → x.ts" in by["R12"][0] and "16" in by["R15"][0]
    reached = graph.reach(edges, nodes.where("type = 'endpoint'").select("id"), 5)
    assert ("POST /a", "R11") in found(rules.scoped_architecture(nodes, edges, reached))


def test_import_ring_of_nine_files(spark):
    nodes = spark.createDataFrame([(f"f{i}", "file", f"{i}.ts", f"{i}.ts", 1, 1, "f", None, None, None, None, 1) for i in range(9)], NODES)
    edges = spark.createDataFrame([(f"f{i}", f"f{(i + 1) % 9}", "depends_on", 1.0, None, None, i) for i in range(9)], EDGES)
    assert found(rules.architecture_rules(nodes, edges)) == {(None, "R12")}


def test_not_found_and_ranking(spark):
    nodes, edges, _ = world(spark)
    names = spark.createDataFrame([("GET /b",), ("GET /zzz",)], "endpoint string")
    assert found(rules.not_found(spark, names, nodes)) == {("GET /zzz", "R0")}
    order = [r.severity for r in rules.ranked(rules.middleware_rules(nodes, edges)).collect()]
    assert order == sorted(order, key=["critical", "high", "medium", "low", "info"].index)


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    files = spark.createDataFrame([], "file_path string, text string")
    reached = graph.reach(edges, nodes.select("id"), 5)
    for df in (rules.middleware_rules(nodes, edges), rules.project_rules(nodes), rules.reach_rules(nodes, edges, files, reached), rules.architecture_rules(nodes, edges)):
        assert df.count() == 0


def test_reports(spark):
    rows = [("e", "security", "T1", "low", 3), ("e", "security", "T1", "high", 1), ("e", "architecture", "T2", "INFO", 2), ("f", "security", "T1", "weird", 4)]
    df = spark.createDataFrame(rows, "endpoint string, engine string, title string, severity string, seq int")
    assert {(r.endpoint, r.title): r.severity for r in reports.first_by_title(df, ["endpoint"], ["seq"]).collect()} == {("e", "T1"): "high", ("e", "T2"): "INFO", ("f", "T1"): "weird"}
    assert {(r.endpoint, r.severity): r.n for r in reports.severity_counts(df, ["endpoint"]).collect()}[("e", "info")] == 1
    assert reports.severity_rollup(df, ["endpoint", "engine"]).where("endpoint is null").first().n == 4
    merged = reports.merge_static(df.where("engine = 'security'"), df.where("engine <> 'security'"), ["endpoint"])
    assert merged.count() == 4


def test_conditions(spark):
    results = spark.createDataFrame([("a", "c1", True, True, True, True), ("a", "c2", False, False, False, False), ("b", "c1", True, False, True, False)], "k string, check string, has_finding boolean, has_path boolean, has_recommendation boolean, has_summary boolean")
    planned = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "k string, steps int")
    got = {r.k: (r.confidence, len(r.gaps)) for r in reports.conditions(results, "k", planned).collect()}
    assert got == {"a": (0.9, 1), "b": (0.5, 2), "c": (0.3, 3)}


@pytest.mark.parametrize("goal,steps", [("security", 4), ("performance", 3), ("architecture", 3), ("full", 3), ("odd", 3)])
def test_plan(goal, steps):
    assert len(reports.plan(goal)) == steps and len(reports.plan(goal, 2, ["x", "y"])) == steps + 2
    assert len(reports.plan(goal, 1, ["x"])) == steps


def test_loop_and_answers():
    done = reports.run("POST /a", "security", "app.post('/a', handler)")
    assert done["findings"][0]["title"] == "Missing Authentication" and done["confidence"] == 0.8 and done["iterations"] == 1
    assert reports.run("x", "full", "", lambda *a: {"check": a[0], "findings": []})["iterations"] == 3
    assert reports.parse_findings('{"findings": [1]}') == [1] and reports.parse_findings("so:\n```json\n[2]\n```") == [2]
    assert reports.parse_findings("plain")[0]["severity"] == "info"


def test_batch_of_static_checks_equals_single_ones(spark):
    contexts = ["", None, "app.use(AuthGuard)", "db.query(x); repo.find(1)", "validateBody(); findAll()"]
    df = spark.createDataFrame([(f"k{i}", c, "x") for i, c in enumerate(contexts)], "k string, context string, findings string")
    for goal in ("security", "performance", "architecture", "full"):
        steps = reports.static_checks(reports.planned(df.select("k", "context"), "k", goal)).collect()
        assert len(steps) == len(contexts) * len(reports.plan(goal))
        for r in steps:
            assert [f.asDict() for f in r.findings] == reports.static_check(r.check, r.description, r.context or "")["findings"]
        for r in reports.analysed(df, "k", goal).collect():
            one = reports.run("e", goal, contexts[int(r.k[1:])] or "")
            assert (r.confidence, r.iterations) == (one["confidence"], one["iterations"])
            assert {f.title for f in r.findings} == {f["title"] for f in one["findings"]}
    assert reports.analysed(df.limit(0), "k", "full").count() == 0
