"""Graph operators against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.ident import node_id, role
from graphloom.operators import context as C
from graphloom.operators import graph as G
from graphloom.schema import EDGES, NODES


def nodes(spark, rows):
    """rows: (id, type, name, provenance, seq)"""
    return spark.createDataFrame([(i, t, n, p, 1, 2, p, None, None, None, None, s) for i, t, n, p, s in rows], NODES)


def edges(spark, rows):
    """rows: (source, target, type, seq)"""
    return spark.createDataFrame([(a, b, t, 1.0, None, None, s) for a, b, t, s in rows], EDGES)


@pytest.fixture(scope="module")
def random_edges(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for _ in range(34)}
    return sorted(pairs), edges(spark, [(a, b, "calls", i) for i, (a, b) in enumerate(sorted(pairs))])


def test_upserts_and_phantoms(spark):
    n = nodes(spark, [("a", "class", "old", "f", 1), ("a", "service", "new", "f", 2), ("b", "file", "b", "f", 1), (None, "x", "x", "f", 9)])
    assert {r.id: r.qualified_name for r in G.upsert_nodes(n).collect()} == {"a": "new", "b": "b"}
    e = edges(spark, [("a", "b", " CALLS", 1), ("a", "b", "uses", 2), ("a", "b", "uses", 2), ("a", "z", "uses", 1), (None, "b", "uses", 1)])
    assert {(r.source, r.target): r.type for r in G.upsert_edges(e).collect()} == {("a", "b"): "uses", ("a", "z"): "uses"}
    assert G.upsert_edges(e, multi=True).count() == 3
    assert [r.id for r in G.phantoms(n, e).collect()] == ["z"]
    assert G.counts(G.upsert_nodes(n), G.upsert_edges(e)).first().asDict() == {"node_count": 3, "edge_count": 2}


def test_prune_drops_nodes_and_edges_at_them(spark):
    n = nodes(spark, [("a", "class", "a", "f1", 1), ("b", "class", "b", "f1", 1), ("c", "class", "c", "f2", 1)])
    e = edges(spark, [("a", "c", "calls", 1), ("c", "c", "calls", 1), ("c", "b", "calls", 1)])
    left, rest = G.prune(n, e, spark.createDataFrame([("f1",)], "provenance string"))
    assert [r.id for r in left.collect()] == ["c"] and [(r.source, r.target) for r in rest.collect()] == [("c", "c")]


def test_registry_last_write_wins(spark):
    n = nodes(spark, [("a", "endpoint", "GET /", "f1", 1), ("b", "endpoint", "GET /", "f2", 2), ("c", "class", "GET /", "f2", 3)])
    assert [(r.name, r.id) for r in G.registry(n).collect()] == [("GET /", "b")]


def test_reach_and_neighbors(spark, random_edges):
    pairs, e = random_edges
    ids = sorted({x for p in pairs for x in p})
    seeds = spark.createDataFrame([(i,) for i in [*ids, "nobody"]], "id string")
    want = set()
    for s in ids:
        seen, layer = {s}, {s}
        for hop in range(1, 4):
            layer = {b for a, b in pairs if a in layer} - seen
            seen |= layer
            want |= {(s, x, hop) for x in layer}
    assert {(r.seed, r.node, r.hops) for r in G.reach(e, seeds, 3).collect()} == want
    one = {(r.seed, r.node) for r in G.neighbors(e, seeds).collect()}
    assert one == set(pairs)  # loops included
    assert {(r.seed, r.node) for r in G.neighbors(e, seeds, depth=3).collect()} == {(a, b) for a, b, _ in want}
    assert G.neighbors(e, seeds, depth=0).count() == 0 and G.neighbors(e, seeds, ["uses"]).count() == 0
    assert G.goal_subgraph(e, seeds.limit(1), "performance", 0).count() == 1


@pytest.mark.parametrize("small", [0, G.IN_ONE_TASK])
def test_pagerank_matches_power_iteration(spark, random_edges, monkeypatch, small):
    monkeypatch.setattr(G, "IN_ONE_TASK", small)
    pairs, e = random_edges
    members = ["n00", "n01", "n02", "n03", "n04", "n05", "n06", "n07", "n08"]
    index = {m: i for i, m in enumerate(members)}
    walk = np.zeros((9, 9))
    for a, b in pairs:
        if a in index and b in index:
            walk[index[a], index[b]] += 1
    out = walk.sum(1)
    teleport = np.zeros(9)
    teleport[0] = 1
    x = np.full(9, 1 / 9)
    for _ in range(100):
        new = 0.85 * (x / np.where(out > 0, out, 1)) @ walk + 0.85 * x[out == 0].sum() * teleport + 0.15 * teleport
        done = np.abs(new - x).sum() < 9e-6
        x = new
        if done:
            break
    df = spark.createDataFrame([("n00", m) for m in members], "seed string, node string")
    got = {r.node: r.score for r in G.pagerank(e, df).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    assert np.allclose([got[m] for m in members], x, atol=1e-9)
    assert {r.score for r in G.pagerank(e, df, iterations=1).collect()} == {1 / 9}  # not settled: uniform


def test_cycles_match_brute_force(spark, random_edges):
    pairs, e = random_edges
    ids, want = sorted({x for p in pairs for x in p}), set()
    for n in range(1, 5):
        for combo in itertools.permutations(ids, n):
            if combo[0] == min(combo) and all((combo[i], combo[(i + 1) % n]) in set(pairs) for i in range(n)):
                want.add(combo)
    assert {tuple(r.cycle) for r in G.cycles(e, 4).collect()} == want
    assert [len(r.cycle) for r in G.cycles(e, 4, 3).collect()] == sorted(map(len, want))[:3]
    assert G.cycles(e.limit(0), 4).count() == 0


def test_tree_hangs_each_node_once(spark):
    e = edges(spark, [("r", "a", "calls", 1), ("r", "b", "uses", 2), ("a", "c", "calls", 3), ("b", "c", "calls", 4), ("c", "r", "calls", 5)])
    assert {(r.parent, r.child, r.level, r.type) for r in G.tree(e, "r", 3).collect()} == {("r", "a", 1, "calls"), ("r", "b", 1, "uses"), ("a", "c", 2, "calls")}


def test_greedy_goes_on_after_what_does_not_fit(spark):
    rows = [("k", "a", 9.0, 60), ("k", "b", 8.0, 50), ("k", "c", 7.0, 30), ("k", "d", 6.0, 10), ("k", "e", 5.0, 1), ("j", "x", 1.0, 101), ("k", "n", 4.0, None)]
    df = spark.createDataFrame(rows, "key string, item string, score double, cost int")
    got = {(r.key, r.item) for r in C.greedy_budget(df, "key", [-F.col("score"), F.col("item")], "cost", 100, "item").collect()}
    assert got == {("k", "a"), ("k", "c"), ("k", "d")}


def test_greedy_matches_a_plain_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, float(rng.randrange(9)), rng.choice([0, 1, 2, 3, 7, 20, 60, 130])) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, item long, score double, cost int")
    want = set()
    for key in "ab":
        used = 0
        for _, item, cost in sorted((-s, i, c) for k, i, s, c in rows if k == key):
            if used + cost <= 100:
                used += cost
                want.add((key, item))
    got = [(r.key, r.item) for r in C.greedy_budget(df, "key", [-F.col("score"), F.col("item")], "cost", 100, "item").collect()]
    assert set(got) == want and len(got) == len(want)


def test_snippets_cut_the_first_if_it_is_too_long(spark):
    n = nodes(spark, [("a", "service", "A", "f", 1), ("b", "class", "B", "g", 1), ("c", "file", "f", "f", 1), ("d", "class", "D", "missing", 1)])
    files = spark.createDataFrame([("f", "one two three\nfour five\nsix"), ("g", "x\ny"), ("h", None)], "file_path string, text string")
    scores = spark.createDataFrame([("s", x, v) for x, v in (("a", 0.9), ("b", 0.5), ("c", 2.0), ("d", 1.0), ("gone", 3.0))], "seed string, node string, score double")
    got = {r.node_id: (r.source_code, r.token_count) for r in C.select_snippets(scores, n, files, 4).collect()}
    assert got == {"a": ("one two three", 3)}
    assert {r.node_id for r in C.select_snippets(scores, n, files, 7).collect()} == {"a", "b"}
    text = C.rendered(C.select_snippets(scores, n, files, 7)).first().text
    assert text.index("A (service)") < text.index("B (class)")


def test_identity_and_roles(spark):
    row = spark.range(1).select(node_id(F.lit("class"), F.lit("A"), F.lit("f.ts")).alias("id")).first()
    import hashlib

    assert row.id == hashlib.sha256(b"class:A:f.ts").hexdigest()[:16]
    names = [("UserController", []), ("AuthService", []), ("UserRepository", []), ("AuthGuard", None), ("CreateUserDto", []), ("AppConfig", []), ("Plain", []), ("X", ["Injectable()"]), ("X", ["Entity"]), ("routes", [])]
    df = spark.createDataFrame(names, "name string, decorators array<string>")
    got = [r.role for r in df.select(role(F.col("name"), F.col("decorators")).alias("role")).collect()]
    assert got == ["controller", "service", "repository", "middleware", "validator", "config", "class", "service", "entity", "controller"]


def test_context_snippets_of_every_endpoint(spark, tmp_path):
    import __spark_entry__ as entry

    ring = ["a1", "a2", "a3", "a4", "a5", "a6"]
    n = nodes(spark, [("e1", "endpoint", "GET /a", "f", 1), ("e2", "endpoint", "GET /b", "f", 1), ("x", "class", "x", "f", 1), *((i, "class", i, "f", 1) for i in ring)])
    e = edges(spark, [*((a, b, "calls", 1) for a, b in zip(["e1", *ring], ring)), ("e2", "x", "calls", 1)])
    n.write.parquet(f"{tmp_path}/nodes.parquet")
    e.write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([("f", "one line\nand another\n")], "file_path string, text string").write.parquet(f"{tmp_path}/parse_results.parquet")
    got = {(r.seed, r.node_id) for r in entry.queries()["context_snippets"](spark, str(tmp_path)).collect()}
    assert got == {("e1", i) for i in ["e1", *ring[:5]]} | {("e2", "e2"), ("e2", "x")}


@pytest.mark.parametrize("in_one_task", [G.IN_ONE_TASK, 0])
def test_cycles_of_any_length(spark, random_edges, monkeypatch, in_one_task):
    monkeypatch.setattr(G, "IN_ONE_TASK", in_one_task)
    ring = lambda p, n: [(f"{p}{i:02d}", f"{p}{(i + 1) % n:02d}") for i in range(n)]
    between = [("a03", "m"), ("m", "b02"), ("x", "y"), ("y", "a00"), ("b05", "z")]
    e = edges(spark, [(a, b, "calls", 1) for a, b in [*ring("a", 9), *ring("b", 12), ("b00", "b04"), *between]])
    assert [len(r.cycle) for r in G.cycles(e, None, 5).collect()] == [9, 9, 12]
    assert sorted(len(r.cycle) for r in G.cycles(e, None).collect()) == [9, 9, 12]
    _, some = random_edges
    assert [r.cycle for r in G.cycles(some, None, 5).collect()] == [r.cycle for r in G.cycles(some, 14, 5).collect()]
    assert G.cycles(e.limit(0), None, 5).count() == 0
