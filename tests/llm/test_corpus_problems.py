"""Dedup, encoding and mixing: brute force, exact round trips, edge cases."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.llm import dedup, mixing, tokenizer
from tests.test_entry import SF, duck  # noqa: F401
from verify_oracles import bag

LLM = [n for n, f in entry.queries().items() if f.__module__.startswith("graphloom.llm")]


@pytest.mark.parametrize("name", LLM)
def test_query(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, SF)
    got = bag(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert got == bag(names, cur.fetchall())


def plain(s):
    return None if s is None else "".join(c for c in s.upper().lower() if c.isalnum())


def canonical(title):
    if title is None:
        return None
    m = re.search(r"[(\[{<]([^()\[\]{}<>]*)[)\]}>][\W_]*$", title)
    if m:
        fields = [f for f in re.split("[,;]", m[1]) if plain(f)]
        if fields and all(re.search(r"[^\W_][^=:]*[=:]", f) for f in fields):
            return plain(title[: m.start()]) + "".join(sorted(map(plain, fields)))
    return plain(title)


def test_titles(spark):
    base = "Query Inside a Loop"
    same = [f"{base} [method=GET, path=/a]", f" query-inside  A loop ({'path : /A'}; METHOD=get)!", f"“{base}” {{path=/a,method=GET}}"]
    other = [f"{base} [method=/a, path=GET]", f"{base} [method=GET]", f"Inside Query a Loop [method=GET, path=/a]", base, None, "", "[a=1] tail", "STRASSE", "straße"]
    df = spark.createDataFrame([(t,) for t in same + other], "t string")
    got = [r.c for r in df.select(dedup.canonical_title(F.col("t")).alias("c")).collect()]
    assert got == [canonical(t) for t in same + other]
    assert len(set(got[:3])) == 1 and len(set(got[:7])) == 5 and got[-1] == got[-2]


@pytest.mark.parametrize("parts", [1, 7])
def test_collapse_matches_brute_force(spark, parts):
    rng = random.Random(parts)
    words = ["Alpha beta", "ALPHA-beta", "gamma", "Gamma!", None, "", "--", "delta [a=1, b=2]", "delta [b=2;a=1]", "delta [a=2, b=1]"]
    rows = [(i, rng.choice(words), rng.choice(["x/y", "X/Y", None]), rng.choice(["R1", None])) for i in rng.sample(range(10_000), 400)]
    rows += [(20_000 + i, "hot", "hot", "hot") for i in range(300)] + [(None, "x", "x", "x")] + [(30_000 + i, f"once {i}", None, None) for i in range(200)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, title string, file string, rule string, key int, copies int").repartition(parts)
    keys = {"t": dedup.canonical_title(F.col("title")), "f": dedup.plain_text(F.col("file")), "r": dedup.plain_text(F.col("rule"))}
    groups = {}
    for i, t, f, r in rows:
        if i is not None:
            groups.setdefault((canonical(t), plain(f), plain(r)), []).append(i)
    want = {i: (min(g), len(g)) for g in groups.values() for i in g}
    got = {r.copy_id: (r.kept_id, r.copies) for r in dedup.collapse(df, "id", keys).collect()}
    assert got == want
    assert dedup.collapse(df.limit(0), "id", keys).count() == 0


def test_a_small_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(dedup, "MAX_BLOCKS", 1)
    monkeypatch.setattr(dedup, "BLOCK_BITS", 1 << 8)
    df = spark.range(3_000).select("id", (F.col("id") % 2_900).cast("string").alias("t"))
    got = dedup.collapse(df, "id", {"t": F.col("t")})
    assert got.count() == 3_000 and got.where("copies = 2").count() == 200


ALPHABET = st.text(alphabet=st.sampled_from("ab 's\n\t1.,'é語🙂\u00a0ſ\u0301_-"), max_size=300)


@settings(max_examples=150, deadline=None)
@given(ALPHABET, st.integers(3, 40), st.integers(1, 12))
def test_chunks_encode_as_the_whole(text, size, overlap):
    enc = tokenizer.encoder()
    parts = []
    for k, part, last in tokenizer.chunks(text, size, overlap):
        piece, sound = tokenizer.piece(k, part, last, size, overlap)
        parts.append((enc.encode_ordinary(piece), None) if sound else (None, piece))
    ids = tokenizer.join_pieces(parts)
    assert ids == enc.encode_ordinary(text)
    assert tokenizer.decode(ids) == text


def test_encode(spark):
    long = ("word2 don't " * 3_000) + "x" * 30_000 + " end"
    texts = [None, "", "hello world", "<|endoftext|>", long, "日本語のテキスト。" * 2_000, " \n\n  ", "hello world"]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, keep string, rid int")
    got = {r.doc_id: r.ids for r in tokenizer.encode(df, ["doc_id"]).collect()}
    enc = tokenizer.encoder()
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in tokenizer.encode(df, ["doc_id", "keep"], count_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokenizer.encode(df.limit(0), ["doc_id"]).count() == 0


def docs(spark):
    rng = random.Random(2)
    rows = [(i, s, rng.randrange(1, 60)) for k, s, n in ((1, "big", 3_000), (2, "mid", 400), (3, "small", 40)) for i in range(k * 100_000, k * 100_000 + n)]
    rows += [(1, None, 5), (2, "unlisted", 5), (3, "big", 0), (4, "big", None)]
    return spark.createDataFrame([(*r, 1.0 + r[0] % 3) for r in rows], "doc_id long, source string, n_tokens long, w double")


TARGETS = [("big", 0.5, 2), ("mid", 0.3, 2), ("small", 0.1, 4), ("none", 0.1, 3)]


@pytest.mark.parametrize("weight,total", [(None, None), ("w", None), (None, 60_000.0), ("w", 1e9)])
def test_mix(spark, weight, total):
    df, targets = docs(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, weight=weight, total=total)
    rows = mixed.collect()
    assert {r.source for r in rows} <= {"big", "mid", "small"} and len({r.doc_id for r in rows}) == len(rows)
    assert all(1 <= r.copies <= dict((s, m) for s, _, m in TARGETS)[r.source] for r in rows)
    got = Counter()
    for r in rows:
        got[r.source] += r.n_tokens * r.copies
    sizes = Counter()
    for r in df.where("n_tokens > 0").collect():
        sizes[r.source] += r.n_tokens
    need = mixing.plan(dict(sizes), {s: (x, m) for s, x, m in TARGETS}, total)
    assert all(abs(got[s] - need[s]) <= 60 for s in need)
    if total is None:
        report = {r.source: r.share for r in mixing.shares(mixed, df, targets).collect()}
        assert abs(report["big"] - 0.5 / 0.9) < 0.02 and report["none"] == 0.0
    assert sorted(map(tuple, mixing.mix(df, targets, weight=weight, total=total).collect())) == sorted(map(tuple, rows))


def test_mix_of_nothing(spark):
    df, targets = docs(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def test_pareto_inclusion_follows_the_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("n_tokens"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(df, targets, weight="w", total=80_000.0).collect()
    even = sum(r.doc_id % 2 == 0 for r in rows)
    assert len(rows) == 8_000 and abs(even - 6_000) < 150


def test_filters_grow_in_passes(spark, monkeypatch):
    from graphloom.runtime import Scratch

    monkeypatch.setattr(dedup, "MAX_BLOCKS", 4)
    monkeypatch.setattr(dedup, "BLOCK_BITS", 1 << 11)
    monkeypatch.setattr(dedup, "CHUNK_ROWS", 100)
    df = spark.range(3_000).select(F.col("id").alias("copy_id"), F.encode((F.col("id") % 2_900).cast("string"), "utf-8").alias("key")).withColumn("h", F.xxhash64("key"))
    single, maybe = dedup.split(df, 3_000, Scratch(spark, "test"))
    assert single.count() + maybe.count() == 3_000 and single.select("key").distinct().count() == single.count()
    assert 200 <= maybe.count() < 400  # singletons stay out of the shuffle although one filter holds only 820 rows


def brute_mix(rows, targets, total):
    """(id, copies) by plain Python: rows (id, source, x, w, u)."""
    sizes = Counter()
    for _, s, x, _, _ in rows:
        sizes[s] += x
    need = mixing.plan(dict(sizes), {s: (a, m) for s, a, m in targets}, total)
    out = {}
    for s, most in ((s, m) for s, _, m in targets if s in need):
        own = [r for r in rows if r[1] == s]
        lo, hi = 0.0, most / min(r[3] for r in own)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(most, mid * r[3]) * r[2] for r in own) < need[s] else (lo, mid)
        drawn, left = [], need[s]
        for i, _, x, w, u in own:
            e = min(most, hi * w)
            e = round(e) if abs(e - round(e)) < 1e-9 else e
            p = e - int(e)
            out[i] = int(e)
            left -= int(e) * x
            if p > 0:
                drawn.append((u / (1 - u) / (p / (1 - p)), i, x))
        taken = 0
        for _, i, x in sorted(drawn):
            if taken + x / 2 <= left:
                out[i] += 1
            taken += x
    return {i: c for i, c in out.items() if c}


@pytest.mark.parametrize("total", [None, 40_000.0, 1e9])
def test_weighted_mix_matches_brute_force(spark, total):
    df, targets = docs(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    known = df.where("n_tokens > 0").select("doc_id", "source", "n_tokens", "w", mixing.uniform(7, F.col("doc_id")).alias("u"))
    rows = [tuple(r) for r in known.collect() if r.source in {"big", "mid", "small"}]
    want = brute_mix(rows, TARGETS, total)
    mixed = mixing.mix(df, targets, weight="w", total=total)
    assert {r.doc_id: r.copies for r in mixed.collect()} == want
    by = {r[0]: (r[1], r[2]) for r in rows}
    tokens = Counter()
    for i, c in want.items():
        tokens[by[i][0]] += c * by[i][1]
    got = {r.source: (r.mix_tokens, r.mix_docs, r.most_copies) for r in mixing.shares(mixed, df, targets).collect()}
    for s in ("big", "mid", "small"):
        assert got[s] == (tokens[s], sum(by[i][0] == s for i in want), max(c for i, c in want.items() if by[i][0] == s))
