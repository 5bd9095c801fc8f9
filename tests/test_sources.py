"""Scan, parse, index and the surfaces over them, on a small source tree."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.api import Engine
from graphloom.config import Settings, load
from graphloom.events import EventBus
from graphloom.server import Routes
from graphloom.sources import index, parse, scan, store

APP = """import express from 'express';
import { users } from './routes/users';
const app = express();
app.use(cors());
app.use('/users', users);
app.get('/health', (req, res) => res.send('it is // fine'));
"""
USERS = """import { Service } from '@/service';
import { auth } from '../auth';
const router = Router();
router.get('/', ctl.list);
router.all("/any", ctl.any);
router.post('/', auth, validate(schema, {a: 1}), ctl.create);
other.get('/no', x.y);
router.delete(path, ctl.remove);
@Controller('users')
export class UserController {
  constructor(private readonly service: Service) {}
  // get fake() { }
  async list(req: Request, limit = 10): Promise<User[]> {
    for (const u of users) { await this.service.find(u.id); }
    return "not { a brace";
  }
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "package.json": json.dumps({"main": "src/app.ts", "dependencies": {"express": "^4.1"}, "devDependencies": {"express": "^4.2", "typescript": "5"}}),
        "tsconfig.json": json.dumps({"compilerOptions": {"paths": {"@/*": ["src/*", "lib/*"]}}}),
        "src/app.ts": APP, "src/routes/users.ts": USERS, "src/service.ts": "export default class Service { find(id) { return 1; } }\n",
        "src/auth/index.ts": "export function auth(req, res, next) { next(); }\n", "tool.py": "import os\nfrom a.b import c\n@deco(1)\nclass K:\n    def m(self):\n        pass\n",
        "A.java": "package p;\npublic class A {\n    public int f(int x) {\n        return g(x);\n    }\n}\n", "m.go": "package m\n", "broken.ts": "class X {\n  f() {\n",
        "node_modules/x/i.js": "x()", ".git/HEAD": "ref", "logo.png": "x", "notes.txt": "n", ".env": "A=1", "dist/a.js": "x", "pkg/__init__.py": "x = 1\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree):
    e = Engine(spark, str(tree))
    e.stats = e.index().first()
    return e


def test_scan(spark, tree):
    got = {r.path: r.language for r in scan.scan(spark, str(tree), known_only=False).collect()}
    assert got["src/app.ts"] == "typescript" and got[".env"] is None and got["notes.txt"] is None
    assert got["pkg/__init__.py"] == "python"
    assert not {"node_modules/x/i.js", ".git/HEAD", "logo.png", "dist/a.js"} & set(got)
    assert scan.scan(spark, str(tree)).where("language is null").count() == 0


def test_detection(spark, tree):
    row = scan.detect(scan.scan(spark, str(tree), known_only=False)).first()
    assert (row.confidence, row.version, row.language) == (0.95, "^4.2", "typescript")
    assert row.entry_files == ["src/app.ts", "src/app.ts"]
    none = scan.detect(spark.createDataFrame([], "path string, text string")).first()
    assert none.confidence == 0.0 and none.version is None
    d = spark.createDataFrame([("a", 0.9, 1), ("b", 0.9, 0), ("c", 0.5, 2)], "framework string, confidence double, `order` int")
    assert scan.arbitrate(d).first().framework == "b"
    assert scan.arbitrate(d.where("confidence < 0.6")).count() == 0


def test_parse_script():
    got = parse.parse(USERS, "typescript", "u.ts")
    assert [(s["qualified_name"], s["kind"], s["line_start"], s["line_end"]) for s in got["symbols"]] == [
        ("UserController", "class", 10, 17), ("UserController.constructor", "method", 11, 11), ("UserController.list", "method", 13, 16),
    ]
    assert got["symbols"][2]["parameters"] == ["req", "limit"] and got["symbols"][0]["decorators"] == ["Controller('users')"]
    assert [i["module"] for i in got["imports"]] == ["@/service", "../auth"] and got["exports"][0]["name"] == "UserController"
    assert [(r["method"], r["path"], r["handler"], r["middleware"]) for r in got["routes"]] == [
        ("GET", "/", "ctl.list", []), ("GET", "/any", "ctl.any", []), ("POST", "/", "ctl.create", ["auth", "validate(schema, {a: 1})"]),
    ]
    assert got["errors"] == [] and len(parse.parse("f( {", "javascript", "x.js")["errors"]) == 2
    assert [r["kind"] for r in parse.parse(APP, "typescript", "a.ts")["routes"]] == ["middleware", "mount", "route"]


def test_parse_others():
    py = parse.parse("import os.path, sys\nfrom a.b import c\n@deco(1)\nclass K:\n    def m(self): pass\ndef f(): pass\n", "python", "t.py")
    assert [(s["qualified_name"], s["kind"]) for s in py["symbols"]] == [("K", "class"), ("K.m", "method"), ("f", "function")]
    assert py["symbols"][0]["decorators"] == ["deco"] and [i["module"] for i in py["imports"]] == ["os.path", "a.b"]
    assert parse.parse("def f(:", "python", "t.py")["errors"][0]["line"] == 1
    java = parse.parse("public class A {\n  public int f(int x) {\n    return new B(x).g();\n  }\n}", "java", "A.java")
    assert [s["qualified_name"] for s in java["symbols"]] == ["A", "A.f"]
    assert parse.parse("package m", "go", "m.go") == parse.NOTHING == parse.parse(None, "python", "x.py")


def test_imports_resolve(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("src/a.js",)], "path string")
    imps = spark.createDataFrame([("src/x.ts", "./a"), ("src/y/z.ts", "../b"), ("x.ts", "@/a"), ("x.ts", "express"), ("src/x.ts", "./none"), ("src/x.ts", None)], "file_path string, module string")
    got = {(r.file_path, r.module): r.resolved for r in scan.resolve_imports(imps, files, {"@": "src"}).collect()}
    assert got == {("src/x.ts", "./a"): "src/a.ts", ("src/y/z.ts", "../b"): "src/b/index.ts", ("x.ts", "@/a"): "src/a.ts"}
    assert scan.aliases("no json") == {} and scan.aliases('{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}}') == {"@": "src"}


def test_index(engine):
    assert engine.stats.endpoints == 4 and engine.stats.framework == "express"
    names = {(r.type, r.qualified_name) for r in engine.nodes.collect()}
    assert {("middleware", "cors"), ("module", "mount:/users→users"), ("controller", "UserController"), ("endpoint", "POST /"), ("service", "Service")} <= names
    kinds = {r.type for r in engine.edges.select("type").distinct().collect()}
    assert kinds == {"belongs_to", "depends_on", "calls", "secured_by"}
    assert engine.edges.where("type = 'depends_on'").count() == 3


def test_whole_source(spark):
    files = spark.createDataFrame([("b.ts", "2"), ("a.ts", "1"), ("c.md", "3")], "path string, text string")
    assert scan.whole_source(files, ["ts"]).first().text == "// === a.ts ===\n1\n\n// === b.ts ===\n2"


def test_engine_answers(engine):
    assert {r.title for r in engine.analyze("POST /").collect()} >= {"Authentication Present", "Missing Rate Limiting"}
    assert [r.title for r in engine.analyze("GET /none").collect()] == ["Endpoint Not Found"]
    assert json.loads(engine.tool_endpoints()) == ["GET /", "GET /any", "GET /health", "POST /"]
    assert "error" in json.loads(engine.tool_endpoint("GET /none")) and "error" in json.loads(engine.tool_graph("none"))
    assert json.loads(engine.tool_endpoint("POST /"))["http_method"] == "POST"
    assert "secured_by: auth (middleware)" in engine.tree("POST /") and engine.tree("GET /none") is None
    snippets = json.loads(engine.tool_context("POST /", "security"))["snippets"]
    assert snippets and all(s["token_count"] > 0 for s in snippets)


def test_stores(spark, engine, tmp_path):
    path = tmp_path.as_uri()
    store.save_graph(engine.nodes, engine.edges, f"{path}/g")
    nodes, edges = store.load_graph(spark, f"{path}/g")
    assert nodes.count() == engine.nodes.count() and store.load_graph(spark, f"{path}/none") is None
    store.export_json(nodes, edges, str(tmp_path / "g.json"))
    back = store.import_json(spark, f"{path}/g.json")
    assert back[0].count() == nodes.count() and back[1].count() == edges.count()
    assert store.import_json(spark, f"{path}/none.json") is None
    (tmp_path / "bad.json").write_text("{")
    assert store.import_json(spark, f"{path}/bad.json") is None
    s = store.Store(spark, f"{path}/store")
    s.create()
    s.append("projects", spark.createDataFrame([("p", "n")], "id string, name string"))
    assert s.read("projects").where("id = 'p'").count() == 1
    store.write_json(nodes.select("id"), f"{path}/json")


def test_cli(spark, tree, capsys):
    for argv in (["version"], ["index", str(tree)], ["endpoints", str(tree), "--format", "json"], ["security", str(tree)], ["analyze", "POST /", str(tree), "--format", "json"], ["graph", "POST /", str(tree)]):
        assert cli.main(argv, spark) == 0
    assert cli.main(["graph", "GET /none", str(tree)], spark) == 1
    assert "POST /" in capsys.readouterr().out


def test_server(spark, tree):
    r = Routes(spark, Settings())
    assert r.handle("GET", "/health", {})[0] == 200
    assert r.handle("POST", "/api/projects", {"root_path": "/none"})[0] == 400
    status, doc = r.handle("POST", "/api/projects", {"root_path": str(tree)})
    assert status == 201 and doc["endpoints_count"] == 4
    key = doc["id"]
    assert len(r.handle("GET", f"/api/projects/{key}/endpoints", {})[1]) == 4
    status, done = r.handle("POST", "/api/analysis", {"project_id": key, "endpoint": "POST /", "goal_type": "security"})
    assert status == 200 and r.handle("GET", f"/api/reports/{done['id']}", {})[0] == 200
    assert r.handle("GET", f"/api/graph/{key}/POST%20%2F", {})[0] == 200
    for path in ("/api/projects/none", "/api/reports/none", f"/api/graph/{key}/none", "/what"):
        assert r.handle("GET", path, {})[0] == 404


def test_events_and_settings(tmp_path, monkeypatch):
    bus, seen = EventBus(), []
    bus.on("a", seen.append)
    bus.on("a", lambda _: 1 / 0)
    bus.emit("a", 1)
    bus.emit("b", 2)
    assert seen == [1] and bus.emitted == {"a": 1}
    bus.off("a", seen.append)
    bus.clear()
    assert bus.handlers("a") == 0
    (tmp_path / ".env").write_text("GRAPHLOOM_PORT=9\nGRAPHLOOM_TOKEN_BUDGET=5\n# x\n")
    monkeypatch.setenv("GRAPHLOOM_TOKEN_BUDGET", "7")
    got = load(str(tmp_path / ".env"), max_iterations=1)
    assert (got.port, got.token_budget, got.max_iterations) == (9, 7, 1)
    with pytest.raises(TypeError):
        load(nope=1)


def test_endpoints_table_to_graph(spark):
    cols = "method string, path string, handler string, file_path string, line_start int, line_end int, middleware array<string>, id string"
    df = spark.createDataFrame([("GET", "/", "h", "f", 1, 2, ["a", "b"], "x"), ("GET", "/", "h", "f", 1, 2, None, "x"), ("GET", None, "h", "f", 1, 2, None, "y"), ("PUT", "/", None, "f", None, None, [], "z")], cols)
    nodes, edges = index.graph_of_endpoints(df)
    assert nodes.count() == 5 and edges.where(F.col("type") == "secured_by").count() == 2 and edges.count() == 3


def test_listing_in_small_steps(spark, tmp_path, monkeypatch):
    from graphloom.sources import scan as S

    monkeypatch.setattr(S, "FOLDERS_A_TASK", 1)
    want = set()
    for p in ("a.ts", "src/b.ts", "src/x/y/c.js", "_under/d.py", ".env", "src/.github/e.ts", "node_modules/m/f.ts", "dist/g.ts", "src/node_modules/h.ts", "img/i.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1")
    got = {r.path for r in S.listing(spark, str(tmp_path)).collect()}
    assert {"a.ts", "src/b.ts", "src/x/y/c.js", "_under/d.py", ".env"} <= got and not {p for p in got if "node_modules" in p or "dist" in p or p.endswith("png")}
    assert {r.path for r in S.scan(spark, str(tmp_path)).collect()} == {p for p in got if p.endswith((".ts", ".js", ".py"))}
    assert S.listing(spark, str(tmp_path / "none")).count() == 0 and not want


def test_more_calls_than_a_thousand(spark):
    from graphloom.sources import index, parse

    body = "class A {\n" + "".join(f"  m{i}() {{ a{i}.b{i}(); }}\n" for i in range(1_200)) + "  many() {\n" + "".join(f"    c{i}.d();\n" for i in range(1_100)) + "  }\n}\n"
    files = spark.createDataFrame([("a.ts", "typescript", body)], "path string, language string, text string")
    nodes, edges = index.build(parse.parsed(files), files)
    assert edges.where("type = 'calls'").count() == 2_300 and edges.where("type = 'belongs_to'").count() == nodes.where("type <> 'file'").count() == 1_202
    assert edges.select("seq").distinct().count() > 2_300


def test_upserts(spark, tmp_path):
    from graphloom.sources.store import Store

    store = Store(spark, tmp_path.as_uri())
    store.create()
    row = lambda i, name: (i, name) + (None,) * 9
    make = lambda *rows: spark.createDataFrame(rows, store.read("projects").schema)
    store.upsert("projects", make(row("1", "a"), row("2", "b"), row(None, "z")), ["id"])
    store.upsert("projects", make(row("2", "c"), row("3", "d"), row("3", "e")), ["id"])
    assert {(r.id, r.name) for r in store.read("projects").collect()} == {("1", "a"), ("2", "c"), ("3", "e")}
    store.delete("projects", make(row("1", "")), ["id"])
    assert {r.id for r in store.read("projects").collect()} == {"2", "3"}


def test_arrow_functions_are_named_by_a_bare_parameter():
    from graphloom.sources import parse

    names = [s["name"] for s in parse.parse("const f = x => x + 1;\nconst g = (a, b) => a;\nconst h = (c) => { return c; };\n", "typescript", "a.ts")["symbols"]]
    assert names == ["x"]
