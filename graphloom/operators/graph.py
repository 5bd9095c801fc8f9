"""The property graph as two DataFrames: upserts, pruning, traversal, ranking, cycles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import held
from graphloom.operators.skew import join_on_unique
from graphloom.runtime import Scratch, trimmed
from graphloom.schema import GOAL_EDGES


def normalised(edges: DataFrame) -> DataFrame:
    """Edge types without letter case and outer blanks; edges without an end are dropped."""
    return edges.where("source is not null and target is not null").withColumn("type", F.lower(trimmed("type")))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the one written last. Ties go to the greatest row by content, so that the result is fixed.

    One aggregate with map-side combination; a key may hold any share of the rows.
    """
    rest = [c for c in rows.columns if c not in keys]
    comparable = [c for c in rest if "map<" not in rows.schema[c].dataType.simpleString()]
    best = F.max_by(F.struct(*rest), F.struct(order.alias("__order"), *comparable)).alias("__row")
    return rows.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*rows.columns)


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes by id, the last write of each."""
    return latest(nodes.where("id is not null"), ["id"], F.col("seq"))


def upsert_edges(edges: DataFrame, multi: bool = False) -> DataFrame:
    """Edges by (source, target), the last write of each; with ``multi`` edges of different type stay apart."""
    keys = ["source", "target"] + (["type"] if multi else [])
    return latest(normalised(edges), keys, F.col("seq"))


def phantoms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges name and nodes lack: they count as nodes without attributes."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return ends.where("id is not null").distinct().join(nodes.select("id"), "id", "left_anti")


def registry(nodes: DataFrame) -> DataFrame:
    """(name, id) of endpoints, the last write of each name."""
    named = nodes.where("type = 'endpoint'").select(F.col("qualified_name").alias("name"), "id", "seq")
    return latest(named, ["name"], F.col("seq")).select("name", "id")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes (phantoms among them) and edges."""
    n = nodes.select("id").unionByName(phantoms(nodes, edges)).agg(F.count("*").alias("node_count"))
    return n.crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each


def prune(nodes: DataFrame, edges: DataFrame, provenance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes that the given files (provenance) wrote and without every edge at one of them."""
    gone = nodes.join(provenance, "provenance", "left_semi").select("id").distinct()
    kept = nodes.join(gone, "id", "left_anti")
    left = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
    return kept, left.join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(*edges.columns)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    one = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    return one.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, edge_types: list[str] | None = None, both_ways: bool = False, include_seeds: bool = False) -> DataFrame:
    """(seed, node, hops): what each seed (id) reaches over up to ``depth`` edges, with the fewest hops.

    Layer by layer: the frontier joins the edges, doubles are removed, and what was seen is joined away; the layers are
    tables in the shared folder. All seeds run at once, and every later rule filters this one result by hops. A seed is
    not among its own nodes unless asked for; an unknown seed reaches nothing; depth 0 gives no rows but seeds.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "reach")
    e = edges if edge_types is None else edges.where(F.col("type").isin(edge_types))
    steps = e.select(F.col("source").alias("node"), F.col("target").alias("next"))
    if both_ways:
        steps = steps.unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("next")))
    steps = scratch.put(steps.where("node is not null and next is not null").distinct()) if depth > 1 else steps.distinct()
    start = seeds.select(F.col("id").alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    layers = [start]
    for hop in range(1, depth + 1):
        found = layers[-1].join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, layers).select("seed", "node")
        layer = scratch.put(found.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if layer.isEmpty():
            break
        layers.append(layer)
    return reduce(DataFrame.unionByName, layers if include_seeds else layers[1:] or [start.limit(0)])


def neighbors(edges: DataFrame, seeds: DataFrame, edge_types: list[str] | None = None, depth: int = 1) -> DataFrame:
    """(seed, node). At depth 1 the direct targets, a seed itself among them if it has an edge to itself; beyond, all
    nodes within ``depth`` hops but the seed. Depth 0 or less gives none."""
    if depth == 1:
        e = edges if edge_types is None else edges.where(F.col("type").isin(edge_types))
        ids = seeds.select(F.col("id").alias("seed"))
        return e.join(ids, e.source == ids.seed).select("seed", F.col("target").alias("node")).distinct()
    return reach(edges, seeds, max(depth, 0), edge_types).select("seed", "node")


def goal_subgraph(edges: DataFrame, seeds: DataFrame, goal: str, depth: int = 5) -> DataFrame:
    """(seed, node, hops) within ``depth`` edges in either direction of the types a goal follows, the seed included. An
    unknown goal follows all types.

    A graph that tasks can hold is traversed in memory for blocks of seeds, a larger one layer by layer."""
    types = GOAL_EDGES.get(goal, GOAL_EDGES["full"])
    graph = held.hold(edges, seeds, types, both_ways=True, walks=False)
    if graph is None:
        return reach(edges, seeds, depth, types, both_ways=True, include_seeds=True)
    return held.reach(edges.sparkSession, graph, depth, include_seeds=True)


#: A seed whose subgraph has at most this many edges is ranked within one task; larger ones over all tasks.
IN_ONE_TASK = 200_000


def pagerank(
    edges: DataFrame, members: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, keep_every: int = 5
) -> DataFrame:
    """(seed, node, score): personalised PageRank of each seed over its own members (seed, node).

    Scores begin uniform; the walk follows edges in their direction and by their weight within the members, returns to
    the seed with probability 1 - alpha, and from nodes without edges at once. It ends when the summed change is below
    ``tolerance`` for each node, or after ``iterations``; a seed whose scores have not settled by then gets uniform ones
    (with ``tolerance`` None the number of iterations is fixed and its scores stand). Every step is one aggregate keyed by
    (seed, node) with partial sums, so a hub's inbound mass is summed before it is moved; the plan is cut every few
    steps. If every seed's subgraph is small, which is counted first, each is iterated within a task instead.
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    weighted = edges.select("source", "target", F.coalesce("weight", F.lit(1.0)).alias("weight")).where("weight > 0")
    inside = (
        members.select("seed", F.col("node").alias("source"))
        .join(weighted, "source")
        .join(members.select("seed", F.col("node").alias("target")), ["seed", "target"])
    )
    total = inside.groupBy("seed", "source").agg(F.sum("weight").alias("all"))
    walk = scratch.put(
        inside.join(total, ["seed", "source"]).select(
            "seed", F.col("source").alias("node"), "target", (F.col("weight") / F.col("all")).alias("share")
        )
    )
    if (walk.groupBy("seed").count().agg(F.max("count")).first()[0] or 0) <= IN_ONE_TASK:
        return _settled(members, walk, alpha, iterations, tolerance)
    size = members.groupBy("seed").agg(F.count("*").alias("n"))
    dangling = members.join(total.select("seed", F.col("source").alias("node")), ["seed", "node"], "left_anti").select(
        "seed", "node", F.lit(True).alias("ends")
    )
    fixed = scratch.put(members.select("seed", "node").join(dangling, ["seed", "node"], "left").join(size, "seed"))
    score = fixed.select("seed", "node", "n", "ends", (1 / F.col("n")).alias("score"))
    settled = None
    for i in range(1, iterations + 1):
        moved = score.join(walk, ["seed", "node"]).select(
            "seed", F.col("target").alias("node"), (F.col("score") * F.col("share") * alpha).alias("in")
        )
        back = score.groupBy("seed").agg(
            (F.sum(F.when(F.col("ends"), F.col("score")).otherwise(0.0)) * alpha + (1 - alpha)).alias("in")
        ).select("seed", F.col("seed").alias("node"), "in")
        inflow = moved.unionByName(back).groupBy("seed", "node").agg(F.sum("in").alias("in"))
        after = score.join(inflow, ["seed", "node"], "left").select(
            "seed", "node", "n", "ends", F.coalesce("in", F.lit(0.0)).alias("score"), F.abs(F.coalesce("in", F.lit(0.0)) - F.col("score")).alias("change")
        )
        if i % keep_every and tolerance is None and i < iterations:
            score = after.drop("change")
            continue
        before, after = score, scratch.put(after)
        scratch.drop(before)
        score = after
        if tolerance is not None:
            open_seeds = after.groupBy("seed").agg((F.sum("change") >= F.max("n") * tolerance).alias("open"))
            settled = open_seeds
            if not open_seeds.where("open").limit(1).count():
                break
    if tolerance is None or settled is None:
        return score.select("seed", "node", "score")
    return score.join(settled, "seed").select("seed", "node", F.when(F.col("open"), 1 / F.col("n")).otherwise(F.col("score")).alias("score"))


def _settled(members: DataFrame, walk: DataFrame, alpha: float, iterations: int, tolerance: float | None) -> DataFrame:
    def rank(key, mine: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        nodes = mine.node.drop_duplicates().reset_index(drop=True)
        n, at = len(nodes), pd.Series(nodes.index, index=nodes)
        a, b, share = at[steps.node].to_numpy(), at[steps.target].to_numpy(), steps.share.to_numpy()
        ends, home = np.ones(n, bool), np.zeros(n)
        ends[a] = False
        home[at[key[0]]] = 1.0
        score, settled = np.full(n, 1 / n), tolerance is None
        for _ in range(iterations):
            moved = np.bincount(b, score[a] * share, n) * alpha + home * (alpha * score[ends].sum() + 1 - alpha)
            change, score = np.abs(moved - score).sum(), moved
            if tolerance is not None and change < n * tolerance:
                settled = True
                break
        return pd.DataFrame({"seed": key[0], "node": nodes, "score": score if settled else 1 / n})

    pairs = members.select("seed", "node").groupBy("seed").cogroup(walk.groupBy("seed"))
    return pairs.applyInPandas(rank, "seed string, node string, score double")


PEELS = 4


def cycles(edges: DataFrame, longest: int | None, limit: int | None = None) -> DataFrame:
    """(cycle): simple cycles of up to ``longest`` nodes, each once, beginning with its smallest node, in order.

    Paths grow from their smallest node over greater nodes only. Nodes that lie on no cycle, because nothing leads in or
    out of them, are peeled off first, so that paths are only grown where cycles can be. ``limit`` keeps the first ones.
    With ``longest`` None cycles may have any length: only strongly connected edges are kept, and paths grow until none
    is open or, as shorter cycles come first, ``limit`` cycles are found.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    e = scratch.put(edges.select("source", "target").where("source is not null and target is not null").distinct())
    e = _peeled(e, PEELS, scratch) if longest is not None else _strong(e, scratch)
    loops = e.where("source = target").select(F.array("source").alias("cycle"))
    path = e.where("source < target").select(F.array("source", "target").alias("path"), F.col("source").alias("first"), F.col("target").alias("last"))
    found, n, many = [loops], 1, loops.count() if longest is None and limit else 0
    while (n < longest) if longest is not None else not (limit and many >= limit):
        n += 1
        closing = e.select(F.col("source").alias("last"), F.col("target").alias("first"))
        closed = path.join(closing, ["last", "first"]).select(F.col("path").alias("cycle"))
        found.append(closed)
        if longest is None and limit:
            many += closed.count()
        path = scratch.put(
            path.join(e.select(F.col("source").alias("last"), F.col("target").alias("next")), "last")
            .where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
            .select(F.concat("path", F.array("next")).alias("path"), "first", F.col("next").alias("last"))
        )
        if path.isEmpty():
            break
    out = reduce(DataFrame.unionByName, found)
    return out.orderBy(F.size("cycle"), "cycle").limit(limit) if limit else out


def _peeled(e: DataFrame, rounds: int | None, scratch: Scratch) -> DataFrame:
    """Edges without those at nodes that nothing leads into or out of, again and again, ``rounds`` times at most."""
    n, done = e.count(), 0
    while n and (rounds is None or done < rounds):
        inner = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        inner = scratch.put(inner.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        left = inner.count()
        scratch.drop(e)
        e, done = inner, done + 1
        if left == n:
            break
        n = left
    return e


def _strong(e: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges within strongly connected components: those that lie on a cycle.

    Up to IN_ONE_TASK edges are worked on within one task. Of more, each node takes the greatest id that leads to it and
    the greatest it leads to; both are the same all over a component, so edges between nodes that differ in one are
    dropped. When none is, what hangs together is strongly connected.
    """
    e = _peeled(e, PEELS, scratch)
    if e.count() <= IN_ONE_TASK:
        return scratch.put(e.coalesce(1).mapInPandas(_strong_in_task, "source string, target string"))
    while True:
        e = _peeled(e, None, scratch)
        n = e.count()
        if not n:
            return e
        marks = _greatest(e, "source", "target", scratch).join(_greatest(e, "target", "source", scratch), "node")
        side = lambda key: marks.select(F.col("node").alias(key), F.struct("source_mark", "target_mark").alias(f"of_{key}"))
        e = scratch.put(e.join(side("source"), "source").join(side("target"), "target").where("of_source = of_target").select("source", "target"))
        if e.count() == n:
            return e


def _strong_in_task(batches):
    rows = [r for b in batches for r in zip(b.source, b.target, strict=True)]
    out, back = {}, {}
    for a, b in rows:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    ended, seen = [], set()
    for start in out:
        if start in seen:
            continue
        seen.add(start)
        todo = [(start, iter(out[start]))]
        while todo:
            node, rest = todo[-1]
            after = next((x for x in rest if x not in seen), None)
            if after is None:
                ended.append(node)
                todo.pop()
            else:
                seen.add(after)
                todo.append((after, iter(out.get(after, ()))))
    part: dict[str, str] = {}
    for root in reversed(ended):
        todo = [] if root in part else [root]
        while todo:
            node = todo.pop()
            if node not in part:
                part[node] = root
                todo += back.get(node, ())
    kept = [(a, b) for a, b in rows if part[a] == part[b]]
    yield pd.DataFrame(kept, columns=["source", "target"], dtype=object)


def _greatest(e: DataFrame, start: str, end: str, scratch: Scratch) -> DataFrame:
    """(node, <start>_mark): the greatest id from which a node can be reached, going from ``start`` to ``end``."""
    mark = f"{start}_mark"
    state = scratch.put(e.select(F.col("source").alias("node")).union(e.select("target")).distinct().withColumn(mark, F.col("node")))
    while True:
        told = e.join(state.select(F.col("node").alias(start), mark), start).select(F.col(end).alias("node"), mark)
        after = told.groupBy("node").agg(F.max(mark).alias("told"))
        new = scratch.put(state.join(after, "node", "left").select("node", F.greatest(mark, "told").alias("new"), F.col(mark).alias("old")))
        open_marks = new.where("new > old").limit(1).count()
        state = new.select("node", F.col("new").alias(mark))
        if not open_marks:
            return state


def trees(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, parent, child, level, type): a dependency tree of each root (id), in which each node hangs at its first place,
    by levels and then by the smallest parent."""
    layers = Scratch(edges.sparkSession, "trees").put(reach(edges, roots, depth, include_seeds=True))
    typed = edges.groupBy("source", "target").agg(F.min("type").alias("type"))
    steps = (
        layers.select("seed", F.col("node").alias("source"), F.col("hops").alias("from"))
        .join(typed, "source")
        .join(layers.select("seed", F.col("node").alias("target"), F.col("hops").alias("level")), ["seed", "target"])
        .where(F.col("level") == F.col("from") + 1)
    )
    return steps.groupBy(F.col("seed").alias("root"), F.col("target").alias("child"), "level").agg(
        F.min("source").alias("parent"), F.min_by("type", "source").alias("type")
    ).select("root", "parent", "child", "level", "type")


def tree(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(parent, child, level, type) of the one tree at ``root``."""
    return trees(edges, edges.sparkSession.createDataFrame([(root,)], "id string"), depth).drop("root")


def clear(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The empty graph of the same columns."""
    return nodes.limit(0), edges.limit(0)


def out_degree(edges: DataFrame) -> DataFrame:
    """(source, out_degree) over distinct targets."""
    return edges.select("source", "target").distinct().groupBy("source").agg(F.count("*").alias("out_degree"))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with type, name, file and line of both ends; null where a node is missing."""
    cols = ["type", "qualified_name", "file_path", "line_start"]
    side = lambda key, p: nodes.select(F.col("id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    return join_on_unique(join_on_unique(edges, side("source", "src"), "source"), side("target", "tgt"), "target")


def lifted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between the classes, or other owners, that the calling and called functions belong to."""
    owned = edges.where("type = 'belongs_to'").join(nodes.where("type = 'function'").select(F.col("id").alias("source")), "source", "left_semi")
    owner = owned.groupBy("source").agg(F.min("target").alias("owner"))
    calls = edges.where("type = 'calls'").select("source", "target").join(owner, "source", "left")
    calls = calls.withColumn("source", F.coalesce("owner", "source")).drop("owner")
    ends = calls.join(owner.withColumnRenamed("source", "target"), "target", "left")
    return ends.select("source", F.coalesce("owner", "target").alias("target"), F.lit("calls").alias("type")).distinct()
