"""Counts kept up to date by batches, against the same counts made anew."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lattica.operators import degree, maintain
from lattica.plans.snapshot import shared_dir

CHANGES = "src string, dst string, relation string, n int"


def test_batches_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Edges come, repeat and go, with loops, unknown ends and nulls; the state is opened anew between batches."""
    monkeypatch.setattr(maintain, "FILE", 2)
    r = random.Random(11)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(12)] + [(None,), ("n3",)], "id string")
    name = lambda: r.choice([*(f"n{i}" for i in range(9)), "gone", None])
    there, folder = Counter(), f"file://{tmp_path}/graph"
    for k in range(7):
        changes = [(name(), name(), r.choice(["calls", "uses", " Calls", None]), r.choice([1, 1, 2])) for _ in range(15)]
        for e in r.sample(sorted(there, key=str), min(len(there), 9)):
            changes.append((*e, -r.randint(1, there[e])))
        for *e, n in changes:
            there[tuple(e)] += n
        there = +there
        graph = maintain.MaintainedGraph(spark, folder, nodes, parts=5, fan=3)
        assert graph.batch == k - 1
        graph.apply(spark.createDataFrame(changes, CHANGES))
        edges = spark.createDataFrame([(*e, i) for e, n in there.items() for i in range(n)], "src string, dst string, relation string, pos int")
        assert Counter(map(tuple, graph.degrees().collect())) == Counter(map(tuple, degree.degrees(edges).collect()))
        assert graph.validated().first().asDict() == degree.validate(nodes, edges).first().asDict()
        assert {tuple(e[:3]): e.n for e in graph.edges().collect()} == dict(there)
    assert len(graph._counts["edges"].segments) <= 4


def test_what_cannot_go_and_what_came_before(spark, tmp_path):
    """More copies than there are: an error, and nothing changes. A batch that comes again is passed over; an empty one counts nothing."""
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    graph = maintain.MaintainedGraph(spark, f"file://{tmp_path}/graph", nodes)
    one = spark.createDataFrame([("a", "b", "uses", 1)], CHANGES)
    graph.apply(one, 0).apply(one, 0)
    assert graph.edges().first().n == 1 and graph.lint["orphans"] == 1
    with pytest.raises(ValueError):
        graph.apply(spark.createDataFrame([("a", "b", "uses", -2), ("b", "c", "uses", 1)], CHANGES))
    assert graph.batch == 0 and [tuple(e) for e in graph.edges().collect()] == [("a", "b", "uses", 1)]
    graph.apply(one.limit(0))
    graph.apply(spark.createDataFrame([("a", "b", "uses", -1)], CHANGES))
    assert graph.lint == {"dangling": 0, "self_loops": 0, "recursive": 0, "duplicates": 0, "orphans": 3} and not graph.degrees().count()


def test_a_small_batch_reads_its_own_parts(spark, tmp_path, capsys):
    nodes = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("id"))
    chain = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"), F.lit("uses").alias("relation"), F.lit(1).alias("n"))
    graph = maintain.MaintainedGraph(spark, f"file://{tmp_path}/graph", nodes, parts=50)
    graph.apply(chain)
    counts = graph._counts["edges"]
    part = chain.where("src = 'n7'").select(counts._part()).first()[0]
    read = counts.found([part])
    read.explain("extended")
    assert 0 < read.count() < 2000 / 10 and "PartitionFilters: [isnotnull(part" in capsys.readouterr().out
    before = counts.segments
    graph.apply(chain.where("src = 'n7'").withColumn("n", F.lit(-1)))
    assert counts.segments[:-1] == before and counts.segments[-1][1] == 1
    assert graph.edges().count() == 1999


def test_changes_of_a_stream_count_once(spark, tmp_path):
    """A stream of edges that ends and starts again gives the counts of the batch."""
    edges = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.lit("reads").alias("relation"), F.lit(1).alias("n"))
    source, nodes = f"file://{tmp_path}/edges", edges.select(F.col("src").alias("id")).distinct()
    edges.repartition(4).write.parquet(source)

    def once():
        graph = maintain.MaintainedGraph(spark, f"file://{tmp_path}/graph", nodes)
        stream = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 2).parquet(source)
        stream.writeStream.foreachBatch(lambda rows, k: graph.apply(rows, k) and None).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        return graph

    once()
    edges.limit(30).coalesce(1).write.mode("append").parquet(source)
    graph = once()
    every = spark.read.schema(edges.schema).parquet(source)
    assert Counter(map(tuple, graph.degrees().collect())) == Counter(map(tuple, degree.degrees(every).collect()))
    assert graph.validated().first().asDict() == degree.validate(nodes, every).first().asDict()


def test_a_batch_writes_four_tables(spark, tmp_path):
    """Changes and ends as they came, and a segment of each: what a batch finds out about its keys is the segment."""
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    graph = maintain.MaintainedGraph(spark, f"file://{tmp_path}/graph", nodes, parts=2)
    graph.apply(spark.createDataFrame([("a", "b", "uses", 1), ("x", "y", "uses", 2)], CHANGES))
    there = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}
    before = there()
    graph.apply(spark.createDataFrame([("x", "y", "uses", -1), ("x", "b", "uses", 1), (None, "y", "calls", 1)], CHANGES))
    assert len(there() - before) == 4
    assert graph.lint == {"dangling": 3, "self_loops": 0, "recursive": 0, "duplicates": 0, "orphans": 0}
