"""Plugins, SQL functions, snapshots, model providers and checkpoints."""

from pyspark.sql import functions as F

from graphloom.functions import ident, text
from graphloom.operators import reports
from graphloom.sources import parse, plugins
from graphloom.streaming import changes


class Odd(plugins.FrameworkPlugin):
    name, languages = "odd", ()

    def __init__(self, confidence):
        self.confidence = confidence

    def detect(self, files):
        return files.limit(1).select(F.lit("odd").alias("framework"), F.lit(1 / self.confidence).alias("confidence"))

    def endpoints(self, parsed):
        return plugins.Express().endpoints(parsed).limit(0)


def test_plugins(spark):
    files = spark.createDataFrame([("package.json", None, '{"dependencies": {"express": "4"}}'), ("a.ts", "typescript", "app.get('/', h);")], "path string, language string, text string")
    known = plugins.Plugins()
    known.register(Odd(0))  # fails
    plugin, found = known.detect(files)
    assert plugin.name == "express" and found["confidence"] == 0.95
    known.register(Odd(1))
    assert known.detect(files)[0].name == "odd"
    assert [r.path for r in known.endpoints(parse.parsed(files)).collect()] == ["/"]
    assert plugins.Plugins(Odd(10)).detect(files) is None


def test_sql_functions(spark):
    ident.register(spark)
    parse.register(spark)
    row = spark.sql("select node_id('file', 'a', 'a') as i, severity_rank('HIGH') as r, severity_rank(null) as n").first()
    want = spark.range(1).select(ident.node_id(F.lit("file"), F.lit("a"), F.lit("a")).alias("i")).first()
    assert (row.i, row.r, row.n) == (want.i, 1, 5)
    got = spark.sql("select * from parse_symbols('class A { f() { } }', 'javascript', 'a.js')").collect()
    assert [r.qualified_name for r in got] == ["A", "A.f"]
    assert len(spark.range(1).select(ident.random_id().alias("x")).first().x) == 8


def test_only_changed_files_are_parsed_again(spark):
    cols = "path string, language string, content_hash string, text string"
    old = spark.createDataFrame([("a.py", "python", "1", "def a(): pass"), ("b.py", "python", "1", "def b(): pass"), ("c.py", "python", "1", "")], cols)
    before = parse.parsed(old).join(old.select("path", "content_hash"), "path")
    new = spark.createDataFrame([("a.py", "python", "1", "NOT PARSED AGAIN ("), ("b.py", "python", "2", "def z(): pass"), ("d.py", "python", "1", "def d(): pass")], cols)
    got = {r.path: [s.name for s in r.symbols] for r in parse.reparsed(new, before).collect()}
    assert got == {"a.py": ["a"], "b.py": ["z"], "d.py": ["d"]}


def test_snapshots(spark):
    s = "path string, content_hash string"
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("d", "4"), ("e", "4")], s)
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "4"), ("z", "8")], s)
    got = {(r.path, r.type, r.old_path, r.content_hash) for r in changes.snapshot_changes(before, after).collect()}
    assert got == {("b", "modified", None, "9"), ("x", "moved", "c", "3"), ("y", "moved", "d", "4"), ("z", "created", None, "8"), ("e", "deleted", None, "")}
    assert changes.snapshot_changes(before, before).count() == 0


def test_share_of_a_text(spark):
    df = spark.createDataFrame([("abcdefghij", 20), ("abc", 5), (None, 0)], "t string, n int")
    assert [r[0] for r in df.select(text.truncate_share(F.col("t"), F.col("n"), 10)).collect()] == ["abcde", "abc", None]


def test_model_and_checkpoints(tmp_path):
    asked = []

    def complete(prompt):
        asked.append(prompt)
        if len(asked) > 1:
            raise OSError
        return '{"findings": [{"title": "T", "severity": "low", "file_path": "f", "recommendation": "r"}]}'

    provider = reports.model_provider(complete, "GET /", "performance")
    kept = reports.Checkpoints(str(tmp_path / "runs"))
    done = reports.run("GET /", "performance", "x" * 9000, provider, checkpoints=kept, thread="t")
    assert {f["title"] for f in done["findings"]} >= {"T"} and len(asked) == 3 and len(asked[0]) < 4000
    again = reports.run("GET /", "performance", "", lambda *_: 1 / 0, checkpoints=kept, thread="t")
    assert again["findings"] == done["findings"] and kept.load("none") is None
