"""Change batches, the graph kept up to date by a stream, and windows."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom.schema import CHANGES, EDGES, NODES
from graphloom.streaming import changes as S

T0 = dt.datetime(2024, 1, 1)


def batch(spark, rows):
    return spark.createDataFrame([(i, p, t, o, h, T0) for i, (p, t, o, h) in enumerate(rows)], CHANGES)


def test_coalesced(spark):
    df = batch(spark, [
        ("a.ts", "created", None, "1"), ("a.ts", "modified", None, "1"),  # same content: stays created
        ("b.ts", "modified", None, "1"), ("b.ts", "modified", None, "2"), ("c.ts", "created", None, "1"), ("c.ts", "deleted", None, "1"),
        ("e.ts", "moved", "d.ts", "9"), (".git/x", "created", None, "1"), (None, "created", None, "1"), ("b.ts", "modified", None, "2"),
    ])
    got = [(r.path, r.type, r.content_hash) for r in S.coalesced(df).orderBy("first_seen", "path").collect()]
    assert got == [("a.ts", "created", "1"), ("b.ts", "modified", "2"), ("c.ts", "deleted", ""), ("d.ts", "deleted", ""), ("e.ts", "created", "9")]
    assert S.change_stats(S.coalesced(df)).first().asDict() == {"updated": 3, "deleted": 2, "total": 5}
    assert S.coalesced(df.limit(0)).count() == 0


def node(i, f):
    return (i, "class", i, f, 1, 1, f, None, None, None, None, 1)


def test_stream_keeps_the_graph(spark, tmp_path):
    def read(changed):
        made = changed.select(F.concat(F.lit("new:"), "path").alias("id"), "path")
        n = made.selectExpr("id", "'class' type", "id qualified_name", "path file_path", "1 line_start", "1 line_end", "path provenance", "cast(null as string) kind", "cast(null as string) http_method", "cast(null as string) http_path", "cast(null as map<string,string>) metadata", "1L seq")
        return n, spark.createDataFrame([], EDGES)

    writer = S.GraphWriter(spark, (tmp_path / "g").as_uri(), read)
    edges = spark.createDataFrame([("a", "b", "calls", 1.0, "a.ts", None, 1), ("b", "c", "calls", 1.0, "b.ts", None, 1)], EDGES)
    writer.start(spark.createDataFrame([node("a", "a.ts"), node("b", "b.ts"), node("c", "c.ts")], NODES), edges)
    source = (tmp_path / "in").as_uri()
    batch(spark, [("a.ts", "modified", None, "1"), ("c.ts", "deleted", None, "")]).coalesce(1).write.parquet(source)
    errors = []
    sink = S.isolated(lambda *_: 1 / 0, writer, on_error=errors.append)
    q = S.follow(S.read_changes(spark, source), sink, (tmp_path / "cp").as_uri()).start()
    q.processAllAvailable()
    q.stop()
    nodes, kept = writer.version(1)
    assert {r.id for r in nodes.collect()} == {"new:a.ts", "b"} and kept.count() == 0 and len(errors) == 1
    writer(batch(spark, [("a.ts", "modified", None, "1"), ("c.ts", "deleted", None, "")]), 0)  # the batch again
    assert writer.version(1)[0].count() == 2


def test_windows_of_a_stream(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, "a", at(0), 1.0), (2, "a", at(10), 2.0), (3, "a", at(70), 3.0), (4, "b", at(70), None)]
    df = spark.createDataFrame(rows, "event_id long, k string, ts timestamp, value double")
    assert sorted((r.k, r.n, r.total) for r in S.tumbling(df, "ts", ["k"]).collect()) == [("a", 1, 3.0), ("a", 2, 3.0), ("b", 1, None)]
    assert sorted((r.k, r.n) for r in S.sessions(df, "ts", "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    df.coalesce(1).write.parquet((tmp_path / "e").as_uri())
    stream = spark.readStream.schema(df.schema).parquet((tmp_path / "e").as_uri())
    q = S.tumbling(stream, "ts", ["k"]).writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win").count() == 3
    seen = S.unseen(batch(spark, [("a", "modified", None, "1"), ("a", "modified", None, "1"), ("a", "modified", None, "2")]).withColumnRenamed("type", "kind"))
    assert "content_hash" in seen.columns
