"""Ledger, hierarchies and orphan references, against brute force and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import hierarchy as H
from graphloom.operators import ledger as L
from graphloom.operators import orphans as O
from graphloom.operators.skew import join_on_unique


def brute_tree(links):
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up[c] = min(up.get(c, p), p)
    out = {}
    for n in set(up) | set(up.values()):
        path, seen, at = [n], {n}, n
        while at in up and up[at] not in seen:
            at = up[at]
            seen.add(at)
            path.append(at)
        out[n] = ("", -1, None) if at in up else (at, len(path) - 1, path[::-1])
    return out


def forest(n, seed):
    rng = random.Random(seed)
    links = [(f"n{i:03d}", f"n{rng.randrange(i):03d}") for i in range(1, n)]
    links += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("below", "r1"), ("lower", "below"), ("self", "self")]
    links += [("two", "n001"), ("two", "n000"), (None, "n000"), ("x", None)] + links[:20]
    return links


@pytest.mark.parametrize("peels,hot", [(H.MAX_PEELS, H.HOT_CHILDREN), (H.MAX_PEELS, 3), (2, 3)])
def test_hierarchy_matches_brute_force(spark, monkeypatch, peels, hot):
    monkeypatch.setattr(H, "MAX_PEELS", peels)
    monkeypatch.setattr(H, "HOT_CHILDREN", hot)
    links = forest(60, 1)
    df = spark.createDataFrame([(*x, "extra") for x in links], "child string, parent string, path string")
    rows = {r.node_id: r for r in H.hierarchy(df).collect()}
    want = brute_tree(links)
    assert {k: (r.root_id, r.depth, r.path) for k, r in rows.items()} == want
    sizes = {k: sum(1 for p in want.values() if p[2] and k in p[2]) for k, v in want.items() if v[2]}
    assert {k: rows[k].subtree_size for k in sizes} == sizes
    assert rows["r1"].subtree_size is None
    below = {(r.ancestor_id, r.descendant_id, r.distance) for r in H.descendants(H.hierarchy(df)).collect()}
    assert below == {(a, k, len(v[2]) - 1 - i) for k, v in want.items() if v[2] for i, a in enumerate(v[2][:-1])}


def test_long_chain_without_paths(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_PEELS", 2)
    df = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(120)], "child string, parent string")
    rows = H.hierarchy(df, with_path=False).collect()
    assert {r.root_id for r in rows} == {"0120"} and max(r.depth for r in rows) == 120
    assert sorted(r.subtree_size for r in rows) == list(range(1, 122))


@pytest.mark.parametrize("with_path", [True, False])
def test_long_chain_into_a_ring(spark, monkeypatch, with_path):
    monkeypatch.setattr(H, "MAX_PEELS", 2)
    links = [(f"{i:02d}", f"{i + 1:02d}") for i in range(20)] + [("20", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("side", "15"), ("self", "self")]
    rows = H.hierarchy(spark.createDataFrame(links, "child string, parent string"), with_path).collect()
    assert {(r.root_id, r.depth, r.path) for r in rows} == {("", -1, None)}
    want = {f"{i:02d}": i + 1 + (i >= 15) for i in range(21)} | {"side": 1, "r1": None, "r2": None, "r3": None, "self": None}
    assert {r.node_id: r.subtree_size for r in rows} == want


def test_hierarchy_of_nothing(spark):
    assert H.hierarchy(spark.createDataFrame([], "child string, parent string")).count() == 0


EVENTS = "item string, token long, event string, version string, deadline long, seq long"


def test_fold(spark):
    rows = [
        ("a", 1, "done", "v1", None, 1), ("a", 3, "done", "v3", None, 5), ("a", 2, "done", "v2", None, 9),  # stale, late
        ("b", 1, "leased", "v1", 100, 1), ("c", 1, "leased", "v1", 10, 1),  # live, past its deadline
        ("d", 1, "leased", "v1", 100, 1), ("d", 1, "expired", "v1", None, 2),
        ("e", 1, "done", None, None, 1), ("f", 2, "done", "x", None, 1), ("f", 2, "done", "y", None, 2), ("f", 2, "done", "y", None, 2),
    ]
    state = {r.item: (r.state, r.version) for r in L.fold(spark.createDataFrame(rows, EVENTS), F.lit(50)).collect()}
    assert state == {"a": ("done", "v3"), "b": ("leased", None), "c": ("pending", None), "d": ("pending", None), "e": ("done", None), "f": ("done", "y")}
    current = spark.createDataFrame([("a", "v3"), ("b", "v1"), ("c", "v1"), ("e", None), ("f", "z"), ("new", "v")], "item string, version string")
    todo = L.pending(current, L.fold(spark.createDataFrame(rows, EVENTS), F.lit(50)))
    assert {r.item for r in todo.collect()} == {"c", "f", "new"}


def test_ledger_runs_survive_failures(spark, tmp_path):
    book = L.Ledger(spark, (tmp_path / "ledger").as_uri())
    cur = lambda *v: spark.createDataFrame([(f"i{n}", x) for n, x in enumerate(v)], "item string, version string")
    t1, got = book.lease(cur("a", "b"), now=0, ttl=10)
    assert got.count() == 2
    assert book.lease(cur("a", "b"), now=5, ttl=10)[1].count() == 0  # leased elsewhere
    t3, again = book.lease(cur("a", "b"), now=20, ttl=10)  # the first holder is gone
    assert again.count() == 2
    book.commit(t1)  # a stale writer
    assert L.fold(book.events(), F.lit(21)).where("state = 'done'").count() == 0
    book.commit(t3)
    book.commit(t3)  # a retry
    assert L.fold(book.events(), F.lit(21)).where("state = 'done'").count() == 2
    t4, changed = book.lease(cur("a", "b2", "c"), now=30, ttl=10)
    assert {r.item for r in changed.collect()} == {"i1", "i2"}
    book.expire(t4)
    assert book.lease(cur("a", "b2", "c"), now=31, ttl=10)[1].count() == 2
    assert book.output_path("/out", t4) == book.output_path("/out/", t4)


def test_orphans(spark):
    parents = spark.createDataFrame(
        [("P1", 10, None), (" p2", 10, 5), ("p3", 50, None), ("p3", 20, 9), ("p4", 0, 0), (None, 1, None), ("p2 ", 5, 3)], "id string, created_at long, deleted_at long"
    )
    keys = O.parent_keys(parents, "id", O.epoch(F.col("created_at")), O.epoch(F.col("deleted_at")))
    refs = spark.createDataFrame(
        [("1", "p1\t", 20), ("2", "P2", 20), ("3", "p3", 20), ("4", "p9", 20), ("5", " ", 1), ("6", None, 1), ("7", "p4", 1), ("8", "p3", 60), ("4", "p9", 20), ("9", "p3", 0)],
        "row_id string, key string, created_at long",
    )
    r = O.references(refs, F.col("row_id"), "key", O.epoch(F.col("created_at")))
    found = O.orphans(r, keys, 5)
    assert {(x.row_id, x.reason) for x in found.collect()} == {("2", "deleted"), ("3", "late"), ("4", "missing")}
    months = {x.month: (x.refs, x.missing, x.deleted, x.late) for x in O.report(r, found).collect()}
    assert months["1970-01"] == (6, 1, 1, 1) and months[None][0] == 1
    assert O.orphans(r, keys.limit(0), 0).where("reason <> 'missing'").count() == 0
    assert O.orphans(r.limit(0), keys, 5).count() == 0


def test_skewed_join_keeps_all_rows(spark):
    left = spark.range(60_000).select(F.when(F.col("id") < 40_000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    left = left.unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    right = spark.createDataFrame([("hot", 1), ("50000", 2)], "k string, v int")
    got = join_on_unique(left, right, "k")
    assert got.count() == 60_001 and got.where("v = 1").count() == 40_000 and got.where("v = 2").count() == 1
    assert join_on_unique(left, right, "k", "left_anti").count() == 20_000


def test_extra_columns_do_not_clash(spark):
    log = spark.createDataFrame([(1, "f", "h", 1, True, "x")], "run_id int, file_id string, content_hash string, log_seq long, ok boolean, status string")
    runs = spark.createDataFrame([(1, "completed", "f")], "run_id int, status string, file_id string")
    assert [r.event for r in L.run_events(log, runs).collect()] == ["done"]
    assert L.run_events(log, runs.limit(0)).first().event == "expired"
    index = spark.createDataFrame([("f", "h", 1, "v"), ("f", "g", 0, "v"), (None, "h", 1, "v")], "id string, content_hash string, updated_at long, version string")
    assert [(r.item, r.version) for r in L.current_versions(index, "id", "content_hash", [F.col("updated_at")]).collect()] == [("f", "h")]


@pytest.mark.parametrize("share", [0.0, 0.3, 2.0])
def test_results_do_not_depend_on_how_much_is_peeled(spark, monkeypatch, share):
    monkeypatch.setattr(H, "PEEL_SHARE", share)
    links = forest(80, 4) + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [(f"t{i}", f"t{i + 1}") for i in range(9)] + [("t9", "r1")]
    rows = {r.node_id: r for r in H.hierarchy(spark.createDataFrame(links, "child string, parent string")).collect()}
    want = brute_tree(links)
    assert {k: (r.root_id, r.depth, r.path) for k, r in rows.items()} == want
    assert [rows[f"t{i}"].subtree_size for i in range(10)] == list(range(1, 11)) and rows["c30"].subtree_size == 31
    assert rows["r2"].subtree_size is None and rows["self"].subtree_size is None


def test_key_filter_grows_with_the_keys(spark, monkeypatch):
    from graphloom.functions import bloom

    monkeypatch.setattr(bloom, "MAX_BITS", 1 << 13)
    monkeypatch.setattr(bloom, "AT_ONCE", 3)
    keys, rows = spark.range(5_000).select("id"), spark.range(20_000).select("id", F.lit("x").alias("h"))
    hashed = F.xxhash64("id")
    filters = bloom.KeyFilter(keys, hashed, 5_000)
    assert filters.ranges == 8
    got = filters.marked(rows, hashed, "maybe")
    assert got.count() == 20_000 and got.where("id < 5000 and not maybe").count() == 0
    assert got.where("id >= 5000 and maybe").count() < 300
    assert bloom.KeyFilter(keys.limit(0), hashed, 0).marked(rows, hashed, "maybe").where("maybe").count() == 0


def test_tokens_are_claimed_once_and_compaction_keeps_states(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    one, two = (L.Ledger(spark, (tmp_path / "ledger").as_uri()) for _ in range(2))
    with ThreadPoolExecutor(8) as pool:
        tokens = list(pool.map(lambda i: (one, two)[i % 2].next_token(), range(24)))
    assert len(set(tokens)) == 24
    cur = lambda *v: spark.createDataFrame([(f"i{n}", x) for n, x in enumerate(v)], "item string, version string")
    for n, versions in enumerate([("a", "b"), ("a2", "b"), ("a2", "b2", "c")]):
        token, _ = one.lease(cur(*versions), now=n, ttl=10)
        one.commit(token)
    open_token, rows = two.lease(cur("a3", "b3", "c"), now=5, ttl=10)
    assert rows.count() == 2
    state = lambda book, now: sorted(map(tuple, L.fold(book.events(), F.lit(now)).collect()))
    before = [state(one, 6), state(one, 20)]
    one.compact()
    assert [state(two, 6), state(two, 20)] == before and one.events().count() <= 9
    two.commit(open_token)
    assert {r.item: r.version for r in L.fold(one.events(), F.lit(6)).collect()} == {"i0": "a3", "i1": "b3", "i2": "c"}
    one.compact()
    assert {r.item: r.version for r in L.fold(one.events(), F.lit(6)).collect()} == {"i0": "a3", "i1": "b3", "i2": "c"}


@pytest.mark.parametrize("seed", range(3))
def test_essential_events_fold_to_the_same_states(spark, seed):
    rng = random.Random(seed)
    rows = [(f"i{rng.randrange(6)}", rng.randrange(5), rng.choice(["done", "leased", "expired"]), rng.choice(["v", "w", None]), rng.choice([5, 50, None]), rng.randrange(3)) for _ in range(60)]
    df = spark.createDataFrame(rows, EVENTS)
    late = spark.createDataFrame(rows[:10] + [("i1", 9, "done", "z", None, 0)], EVENTS)
    fold = lambda e: sorted(map(str, L.fold(e, F.lit(20)).collect()))
    assert fold(df) == fold(L.essential(df)) and fold(df.unionByName(late)) == fold(L.essential(df).unionByName(late))
