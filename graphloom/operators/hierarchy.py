"""Child-parent rows to full hierarchies by leaf peeling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import join_on_unique
from graphloom.runtime import Scratch, shuffle_partitions

#: A parent with more children than this, and than a quarter of a mean partition, is joined apart.
HOT_CHILDREN = 10_000
#: Peeling stops when a round finds fewer leaves than this share of what is left: long chains, which doubling ends sooner.
PEEL_SHARE = 1 / 16
MAX_PEELS = 200

_STATE = "node string, parent string, waits long, size long"
_KNOWN = "node string, root string, depth int, size long, path array<string>"


def hierarchy(links: DataFrame, with_path: bool = True) -> DataFrame:
    """Rows (node_id, root_id, depth, subtree_size, path) of all nodes named in ``links`` (child, parent).

    ``links`` may hold repeated rows; rows with a null end are ignored; a child with several parents keeps the smallest
    one, so that each node has one chain. Nodes whose chain of parents never ends have root_id '', depth -1 and a null
    path; their subtree_size counts what hangs below them when they are not in a ring themselves, else it is null.
    A path runs from the root to the node, both included. No links give no rows.

    Peeling goes bottom up: each round takes the nodes that wait for no child, adds their subtree sizes to the parents
    (summed before the shuffle, so a hot parent costs one row a task), writes them once, and keeps the rest, whose former
    copy is dropped: disk is linear in the nodes. A node's round is its height. What cannot be peeled lies on rings. Going
    back, nodes are taken by the height of their parents, greatest first, and joined with the nodes of that height alone:
    every node is read once as a child and once as a parent. Descendants are not sent as lists, which a hot root would
    gather in one row: ``descendants`` gives them as rows, out of the paths. When a round peels too little
    (``PEEL_SHARE``), or after ``MAX_PEELS``, what is left is finished by pointer doubling, so that the number of rounds
    grows with the logarithms of the number of nodes and of the depth, whatever the shape.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    pairs = links.select("child", "parent").where("child is not null and parent is not null")
    up = pairs.groupBy("child").agg(F.min("parent").alias("parent"))
    waits = up.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("waits"))
    state = (
        up.withColumnRenamed("child", "node")
        .join(waits, "node", "full_outer")
        .select("node", "parent", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(1).cast("long").alias("size"))
    )
    leaves, rest, n_leaves, n_rest = _split(state, scratch)
    hot = _hot_parents(rest, n_leaves + n_rest, scratch) if rest is not None else None
    peeled: list[DataFrame] = []
    while n_leaves and len(peeled) < MAX_PEELS and n_leaves >= PEEL_SHARE * (n_leaves + n_rest):
        peeled.append(leaves)
        if not n_rest:
            leaves = None
            break
        told = leaves.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count("*").alias("done"), F.sum("size").alias("more")
        )
        after = rest.join(told, "node", "left").select(
            "node",
            "parent",
            (F.col("waits") - F.coalesce("done", F.lit(0))).alias("waits"),
            (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
        )
        before = rest
        leaves, rest, n_leaves, n_rest = _split(after, scratch, n_rest)
        scratch.drop(before)
    parts = [x for x in (leaves, rest) if x is not None]
    left = reduce(DataFrame.unionByName, parts) if parts else None
    known = [] if left is None else [scratch.put(_left_over(left, n_leaves + n_rest, not n_leaves, with_path, scratch))]
    known += _back(peeled, left, known, hot, with_path, scratch)
    if not known:
        known = [spark.createDataFrame([], _KNOWN)]
    return reduce(DataFrame.unionByName, (k.select("node", "root", "depth", "size", "path") for k in known)).select(
        F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.col("size").alias("subtree_size"), "path"
    )


def _split(state: DataFrame, scratch: Scratch, n: int | None = None) -> tuple[DataFrame | None, DataFrame | None, int, int]:
    """Leaves and the rest of a state (of ``n`` rows, if known), written in one pass, with their numbers; None where there
    are none."""
    path = scratch.write(state.withColumn("leaf", (F.col("waits") == 0).cast("int")), ["leaf"])
    n_leaves = scratch.read(f"{path}/leaf=1", _STATE).count() if scratch.exists(f"{path}/leaf=1") else 0
    if n is None:
        n = n_leaves + (scratch.read(f"{path}/leaf=0", _STATE).count() if scratch.exists(f"{path}/leaf=0") else 0)
    part = lambda leaf, there: scratch.read(f"{path}/leaf={leaf}", _STATE) if there else None
    return part(1, n_leaves), part(0, n - n_leaves), n_leaves, n - n_leaves


def _hot_parents(rest: DataFrame, n: int, scratch: Scratch) -> DataFrame | None:
    """(parent) of the hot ones: by counting, at most four times as many as partitions."""
    least = max(HOT_CHILDREN, n // (4 * shuffle_partitions(rest.sparkSession)))
    hot = scratch.put(rest.where(F.col("waits") > least).select(F.col("node").alias("parent")))
    return None if hot.isEmpty() else hot


def _back(peeled: list[DataFrame], left: DataFrame | None, above: list[DataFrame], hot: DataFrame | None, with_path: bool, scratch: Scratch) -> list[DataFrame]:
    """Root, depth and path of the peeled nodes, by falling height of their parents; nodes in ``left`` have the greatest."""
    if not peeled:
        return []
    top = len(peeled)
    own = reduce(DataFrame.unionByName, (df.select("node", "parent", "size", F.lit(h).alias("height")) for h, df in enumerate(peeled)))
    heights = own.select(F.col("node").alias("parent"), F.col("height").alias("above"))
    if left is not None:
        heights = heights.unionByName(left.select(F.col("node").alias("parent"), F.lit(top).alias("above")))
    placed = _below(own.where("parent is not null"), heights, hot).unionByName(own.where("parent is null").withColumn("above", F.lit(-1)))
    schema = "node string, parent string, size long"
    path = scratch.write(placed.select("node", "parent", "size", "above", "height"), ["above", "height"])
    held = scratch.read(path, f"{schema}, above int, height int")
    sizes = held.groupBy("above", "height").count().collect()  # a row for each pair of heights
    of = {a: sorted(r.height for r in sizes if r.above == a) for a in {r.above for r in sizes}}
    hot_at = {r.above for r in heights.join(F.broadcast(hot), "parent", "left_semi").select("above").distinct().collect()} if hot is not None else set()
    none = F.lit(None).cast("array<string>")
    roots = lambda h: scratch.read(f"{path}/above=-1/height={h}", schema).select(
        "node", F.col("node").alias("root"), F.lit(0).alias("depth"), "size", (F.array("node") if with_path else none).alias("path")
    )
    done: dict[int, str] = {}
    out = [roots(h) for h in of.get(-1, [])]
    for at in range(top, 0, -1):
        if at not in of:
            continue
        known = list(above) if at == top else []
        known += [roots(at)] if at in of.get(-1, []) else []
        known += [scratch.read(f"{done[a]}/height={at}", _KNOWN) for a in done if at in of[a]]
        parents = reduce(DataFrame.unionByName, (k.select("node", "root", "depth", "path") for k in known)).select(
            F.col("node").alias("parent"), F.col("root").alias("root"), F.col("depth").alias("d"), F.col("path").alias("p")
        )
        children = scratch.read(f"{path}/above={at}", f"{schema}, height int")
        lost = F.col("root") == ""
        level = _below(children, parents, hot if at in hot_at else None).select(
            "node", "root", F.when(lost, -1).otherwise(F.col("d") + 1).cast("int").alias("depth"), "size",
            (F.when(~lost, F.concat("p", F.array("node"))) if with_path else none).alias("path"), "height",
        )
        done[at] = scratch.write(level, ["height"])
        out.append(scratch.read(done[at], _KNOWN + ", height int").drop("height"))
    return out


def _below(leaves: DataFrame, above: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Leaves with what is known of their parents; children of hot parents meet them by broadcast."""
    if hot is None:
        return leaves.join(above, "parent", "left")
    few = F.broadcast(above.join(F.broadcast(hot), "parent", "left_semi"))
    children = leaves.join(F.broadcast(hot), "parent", "left_semi").join(few, "parent", "left")
    return children.unionByName(leaves.join(F.broadcast(hot), "parent", "left_anti").join(above, "parent", "left"))


def _left_over(rest: DataFrame, left: int, ringed: bool, with_path: bool, scratch: Scratch) -> DataFrame:
    """Results of the ``left`` nodes that were not peeled: ring members, or, after MAX_PEELS, whatever remains.

    Doubling keeps for each node its 2^k-th ancestor ``at``, what was summed over fewer than 2^k levels below it, and
    its root once there is no such ancestor; it ends when no node has one. Nodes that still have one when 2^k exceeds their number never end; those
    not on a ring get their sizes by doubling once more, over the chains that are left when the rings are taken away.
    """
    none = F.lit(None).cast("array<string>")
    if ringed:
        return rest.select("node", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("long").alias("size"), none.alias("path"))
    state = _end_of_doubling(rest, left, scratch)
    endless = state.where("at is not null")
    rings = scratch.put(endless.select(F.col("at").alias("node")).distinct())  # so far up, all are on rings, and every ring member is met
    tails = scratch.put(
        rest.join(endless, "node", "left_semi")
        .join(rings, "node", "left_anti")
        .join(rings.select(F.col("node").alias("parent"), F.lit(True).alias("ends")), "parent", "left")
        .select("node", F.when(F.col("ends").isNull(), F.col("parent")).alias("parent"), "size")
    )
    never = rings.select("node", F.lit(None).cast("long").alias("size"))
    if below := tails.count():
        never = never.unionByName(_end_of_doubling(tails, below, scratch).select("node", "size"))
    if with_path:
        ends = scratch.put(state.where("at is null").select("node", "root", "hops", "size"))
        walk = scratch.put(
            rest.join(ends, "node", "left_semi").select(
                "node", F.col("parent").alias("at"), F.array("node").alias("path")
            )
        )
        for _ in range(left.bit_length() + 1):
            if walk.where("at is not null").isEmpty():
                break
            over = walk.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("path").alias("p"))
            walk = scratch.put(
                join_on_unique(walk, over, "at", scratch=scratch).select(
                    "node", F.col("next").alias("at"), F.when(F.col("p").isNull(), F.col("path")).otherwise(F.concat("p", "path")).alias("path")
                )
            )
        ended = ends.join(walk.select("node", "path"), "node")
    else:
        ended = state.where("at is null").select("node", "root", "hops", "size", none.alias("path"))
    return ended.select("node", "root", F.col("hops").alias("depth"), "size", "path").unionByName(
        never.select("node", F.lit("").alias("root"), F.lit(-1).alias("depth"), "size", none.alias("path"))
    )


def _end_of_doubling(rest: DataFrame, left: int, scratch: Scratch) -> DataFrame:
    state = scratch.put(
        rest.select(
            "node", F.col("parent").alias("at"), "size", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("hops"),
            F.when(F.col("parent").isNull(), F.col("node")).alias("root"),
        )
    )
    for _ in range(left.bit_length() + 1):
        before, state = state, scratch.put(_doubled(state, scratch))
        scratch.drop(before)
        if state.where("at is not null").isEmpty():
            break
    return state


def _doubled(state: DataFrame, scratch: Scratch) -> DataFrame:
    over = state.select(
        F.col("node").alias("at"), F.col("at").alias("next"), F.col("hops").alias("h"), F.col("root").alias("r")
    )
    below = state.where("at is not null").groupBy(F.col("at").alias("node")).agg(F.sum("size").alias("more"))
    return (
        join_on_unique(state, over, "at", scratch=scratch)
        .join(below, "node", "left")
        .select(
            "node",
            F.col("next").alias("at"),
            (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
            (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"),
            F.coalesce("root", "r").alias("root"),
        )
    )


def descendants(tree: DataFrame) -> DataFrame:
    """Rows (ancestor_id, descendant_id, distance) of every node and each node above it, out of a hierarchy with paths.

    Each node gives one row for each of its ancestors, in its own task; nothing is gathered per ancestor.
    """
    return (
        tree.where("path is not null")
        .select("node_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
        .where("at < depth")
        .select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("at")).alias("distance"))
    )
