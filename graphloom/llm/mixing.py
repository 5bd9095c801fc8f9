"""Mixing sources to target shares of all tokens, by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import Scratch

BUCKETS = 1 << 16
MAX_SOURCES = 1_000
#: Classes of weights a source, by which the rate of expected copies is found: an eighth of an octave each.
WEIGHT_CLASSES, PER_OCTAVE = 1 << 10, 8


def uniform(seed: int, *cols) -> Column:
    """A number in (0, 1) that depends on the values only, so that a task that runs again draws the same."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None) -> dict[str, float]:
    """Tokens each source shall give. Sources without tokens give none and their shares go to the others in proportion.

    Without ``total`` the mix is the largest in which every share can be met.
    """
    live = {s: share for s, (share, _) in targets.items() if sizes.get(s, 0) > 0 and share > 0}
    whole = sum(live.values())
    if not whole:
        return {}
    share = {s: x / whole for s, x in live.items()}
    most = {s: sizes[s] * targets[s][1] for s in live}
    total = min(most[s] / share[s] for s in live) if total is None else total
    return {s: float(min(most[s], share[s] * total)) for s in live}


def mix(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", weight: str | None = None, total: float | None = None, seed: int = 7
) -> DataFrame:
    """Rows (id, source, n_tokens, copies): how often each document occurs in the mix; those with no copy are left out.

    ``docs`` has id, source, n_tokens; ``targets`` has source, target_share, max_repeats. A document's expected copies
    are in proportion to its ``weight`` (equal without one), at most max_repeats. Their whole part is certain. The rest
    is an inclusion probability p, and one more copy goes to the documents that come first in the order of
    (u / (1 - u)) / (p / (1 - p)), u random, until the source has its tokens: a sample of fixed size with unequal
    probabilities. The last document is taken if that brings the size closer, so a source misses its tokens by at most
    half a document. Documents of sources that are null or not listed, without tokens, or without a positive weight
    take no part. With ``total`` a source that cannot reach its share gives all it may. No sources or no documents give
    no rows. The cut in the order is found by a histogram with BUCKETS classes per source, and exact order is only
    needed in one class of each, so that a source may hold any share of the rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    # Few rows: one per listed source; more than MAX_SOURCES are refused.
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("most")
    ).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = {r.source: (r.share or 0.0, r.most or 0) for r in rows}
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    listed = spark.createDataFrame([(s, m) for s, (_, m) in goal.items()], "source string, most int")
    base = scratch.put(
        docs.select(F.col(id_col).alias("id"), "source", F.col("n_tokens").alias("x"), w.alias("w"))
        .where("x > 0 and w > 0")
        .join(F.broadcast(listed), "source")
    )
    sums = base.groupBy("source").agg(F.sum("x").alias("x"))
    need = plan({r.source: r.x for r in sums.collect()}, goal, total)
    rate = _rates(base, need, {s: m for s, (_, m) in goal.items()})
    params = spark.createDataFrame([(s, need[s], rate[s]) for s in need], "source string, need double, rate double")
    rated = base.join(F.broadcast(params), "source").withColumn(
        "e", F.least(F.col("most").cast("double"), F.col("rate") * F.col("w"))
    )
    near = F.round("e")  # a rate that is whole but for rounding errors leaves nothing to draw
    rated = rated.withColumn("e", F.when(F.abs(F.col("e") - near) < 1e-9, near).otherwise(F.col("e")))
    u, p = uniform(seed, "id"), F.col("e") - F.floor("e")
    q = (u / (1 - u)) / (p / (1 - p))
    ranked = scratch.put(
        rated.withColumn("whole", F.floor("e").cast("int"))
        .withColumn("rank", F.when(p > 0, q / (1 + q)))
        .select("id", "source", "x", "need", "whole", "rank", F.floor(F.col("rank") * BUCKETS).cast("int").alias("bucket"))
    )
    cut = _cuts(ranked)
    marked = ranked.drop("need").join(F.broadcast(cut), "source", "left")  # a row per source
    edge = marked.where("bucket = cut")
    before = F.sum("x").over(_order("rank", "id")) - F.col("x")
    taken = edge.withColumn("one", (F.col("upto") + before + F.col("x") / 2 <= F.col("left")).cast("int"))
    others = marked.where("bucket is null or cut is null or bucket <> cut").withColumn(
        "one", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("int")
    )
    out = others.unionByName(taken).withColumn("copies", F.col("whole") + F.col("one")).where("copies > 0")
    return out.select(F.col("id").alias(id_col), "source", F.col("x").alias("n_tokens"), "copies")


def _order(*cols):
    return Window.partitionBy("source").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)


def _rates(base: DataFrame, need: dict[str, float], most: dict[str, int]) -> dict[str, float]:
    """Expected copies per weight such that a source's copies, each capped, have its tokens.

    One pass makes a histogram of the weights, a row for each class of a source, which tells nearly which documents are
    capped; from there the exact sums of capped and other documents settle the rate within a pass or two. A row per source
    each round.
    """
    if not need:
        return {}
    spark = base.sparkSession
    kind = F.least(F.greatest(F.floor(F.log2("w") * PER_OCTAVE), F.lit(-WEIGHT_CLASSES // 2)), F.lit(WEIGHT_CLASSES // 2)).alias("kind")
    classes: dict[str, list[tuple[float, float, float]]] = {}
    for r in base.groupBy("source", kind).agg(F.sum("x").alias("x"), F.sum(F.col("w") * F.col("x")).alias("wx")).collect():
        classes.setdefault(r.source, []).append((r.wx / r.x, float(r.x), float(r.wx)))
    rate = {s: _rate(classes.get(s, []), need[s], most[s]) for s in need}
    for _ in range(50):
        at = spark.createDataFrame(list(rate.items()), "source string, rate double")
        capped = F.col("rate") * F.col("w") >= F.col("most")
        sums = base.join(F.broadcast(at), "source").groupBy("source").agg(
            F.sum(F.when(capped, F.col("most") * F.col("x")).otherwise(0)).alias("full"),
            F.sum(F.when(~capped, F.col("w") * F.col("x")).otherwise(0.0)).alias("free"),
        )
        new = {r.source: (need[r.source] - r.full) / r.free if r.free > 0 else rate[r.source] for r in sums.collect()}
        if all(abs(new[s] - rate[s]) <= 1e-12 * max(1.0, new[s]) for s in rate):
            break
        rate = new
    return rate


def _rate(classes: list[tuple[float, float, float]], need: float, most: int) -> float:
    """The rate at which classes (weight, tokens, weighted tokens) give what is needed, the heaviest being capped first."""
    full, free = 0.0, sum(wx for *_, wx in classes)
    for w, x, wx in sorted(classes, reverse=True):
        rate = (need - full) / free if free > 0 else 0.0
        if rate * w < most:
            return rate
        full, free = full + most * x, free - wx
    return most / min((w for w, *_ in classes), default=1.0)


def _cuts(ranked: DataFrame) -> DataFrame:
    """Per source: tokens left to draw, the class in which they are reached, and the tokens in the classes before it."""
    per = ranked.groupBy("source", "bucket").agg(
        F.sum(F.when(F.col("bucket").isNotNull(), F.col("x")).otherwise(0)).alias("x"),
        F.sum(F.col("x") * F.col("whole")).alias("sure"),
        F.max("need").alias("need"),
    )
    left = per.groupBy("source").agg((F.max("need") - F.sum("sure")).alias("left"))
    # At most BUCKETS rows for each source.
    upto = per.where("bucket is not null").withColumn("upto", F.sum("x").over(_order("bucket")) - F.col("x"))
    reached = upto.join(left, "source").where("upto <= left")
    last = reached.groupBy("source").agg(F.max(F.struct("bucket", "upto", "left")).alias("m"))
    return last.select("source", F.col("m.bucket").alias("cut"), F.col("m.upto").alias("upto"), F.col("m.left").alias("left"))


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: its target, what it has, what the mix holds of it and the share reached."""
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("have_tokens"), F.count("*").alias("have_docs"))
    got = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"),
        F.count("*").alias("mix_docs"),
        F.max("copies").alias("most_copies"),
    )
    whole = got.agg(F.sum("mix_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        targets.select("source", "target_share", "max_repeats").join(have, "source", "left").join(got, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", "max_repeats", zero("have_tokens"), zero("have_docs"), zero("mix_tokens"),
            zero("mix_docs"), zero("most_copies"),
            F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
        )
    )
