"""Text functions: the columns against their plain versions, and the plain versions against examples."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as T

SOURCES = [
    "import { A, B as C } from './m';\nimport D from \"d\";\nimport os\n\nuse(C, os)\n",
    "/* gone */ a /** kept */\n// line\n/// kept\n# gone\n#! kept\nx = 1 // tail\ny = 'http://z' // tail\nz = `//` + \"\\\"//\" // t\n",
    "a  \n\n\n\n b\t\n\n", "", "\n\n", "x / y // z", "'unclosed // text", "a \\// b",
    "class A {\n  async run(x: number): Promise<void> {\n    if (x) {\n      y();\n    }\n  }\n  keep() {\n    z();\n  }\n}",
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_strip_comments_column_equals_plain(spark):
    assert column(spark, [*SOURCES, None], T.strip_comments) == [*map(T.strip_comments_text, SOURCES), None]


def test_normalize_whitespace_column_equals_plain(spark):
    got = column(spark, SOURCES, T.normalize_whitespace)
    assert [g.split("\n") for g in got] == [T.normalize_whitespace_text(s).split("\n") for s in SOURCES]


def test_generated_lines(spark):
    from random import Random

    rng = Random(3)
    lines = ["".join(rng.choice("ab/'\"`\\ *#") for _ in range(rng.randrange(14))) for _ in range(400)]
    assert column(spark, lines, T.strip_comments) == [T.strip_comments_text(x) for x in lines]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a/'\"`\\ ", max_size=20))
def test_inline_scan(line):
    quote, i, want = "", 0, line
    while i < len(line):
        c = line[i]
        if c == "\\" and i + 1 < len(line):
            i += 2
            continue
        if c in "'\"`":
            quote = "" if quote == c else quote or c
        elif c == "/" and line[i + 1 : i + 2] == "/" and not quote:
            want = line[:i].rstrip()
            break
        i += 1
    if not line.lstrip().startswith("//") or line.lstrip().startswith("///"):
        assert T.strip_comments_text(line) == want


def test_prune_imports():
    kept = T.prune_imports_text(SOURCES[0])
    assert "C } from" in kept and "import D" not in kept and "import os" in kept
    assert T.prune_imports_text("from a import b\nb()") == "from a import b\nb()"
    assert T.prune_imports_text("no imports") == "no imports"


def test_summarize_methods():
    out = T.summarize_methods_text(SOURCES[-1], {"keep"})
    assert "y();" not in out and "z();" in out and "run(x: number): Promise<void> { /* ... */ }" in out
    assert T.summarize_methods_text(SOURCES[-1], None) == SOURCES[-1]


def test_compress_stops_at_the_budget():
    long = SOURCES[0] + SOURCES[1]
    assert T.compress_text(long, 10_000) == T.prune_imports_text(long)
    assert T.compress_text(long) == T.normalize_whitespace_text(T.strip_comments_text(T.prune_imports_text(long)))


def test_lines_and_counts(spark):
    df = spark.createDataFrame([("a\r\nb\nc", 2, 9), ("a", 5, 9), (None, 1, 1), ("a\nb", 0, 1), ("a\nb", 2, 1)], "t string, a int, b int")
    assert [r[0] for r in df.select(T.line_slice(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["b\nc", "", "", "a", ""]
    texts = ["foo(bar, 1) != äé_x", "", None, "a b\nc"]
    assert column(spark, texts, T.token_count) == [T.count_tokens_text(t) for t in texts]
    assert column(spark, ["a b\nc d e\nf", ""], lambda c: T.truncate_lines(c, F.lit(4))) == ["a b", ""]
    assert column(spark, ["this.repo.find(1); x.y (2)"], T.call_sites) == [["repo.find", "x.y"]]


def test_registered_functions(spark):
    T.register(spark)
    assert spark.sql("select count_tokens('a b'), strip_comments('x // y')").first()[:] == (2, "x")


@pytest.mark.parametrize("text,hit", [("query(`select ${x}`)", True), ("query(`select\n${x}`)", False)])
def test_patterns(spark, text, hit):
    assert column(spark, [text], lambda c: c.rlike(T.INTERPOLATED_SQL)) == [hit]


IMPORTS = {
    "import { A, B as C } from './m'": ["A", "C"], "import D from \"d\"": ["D"], "  import os": ["os"], "from a.b import c, d as e": ["c", "e"], "import { } from 'x'": [], "import a.b": ["a"],
    "import './x'": None, "import {} from 'x'": None, "import a, { b } from 'c'": None, "important = 1": None, "from x": None, "": None, "import * as z from 'q'": None,
}
HEADS = {
    "  async run(x: number): Promise<void> {": "run", "public static f() {": "f", "function g(a) {": "g", "if (x) {": "if", "f(): void{": "f", "f(): Map<a, b> {": None, "x.f() {": None,
    "f(": None, "f()": None, "function (x) {": "function", "static async f() {": None, "f(): {a} {": "f", "f() : {": None, "": None,
}


def test_heads_of_imports_and_methods():
    assert {k: T.imported_names(k) for k in IMPORTS} == IMPORTS
    assert {k: (h := T.method_head(k)) and h[0] for k in HEADS} == HEADS
