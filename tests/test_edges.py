"""Edges are shuffled before they are grouped by what is nearly a key of theirs."""

from lattica.operators import degree, resolve, review


def lines(df, capfd):
    df.explain()
    return [x for x in capfd.readouterr().out.splitlines() if "Aggregate" in x or "Exchange" in x]


def test_edges_are_shuffled_before_they_are_grouped(spark, capfd):
    rows = [(1, "a", "b", "calls", "INFERRED"), (2, "a", "b", "calls", "EXTRACTED"), (3, "b", "a", "calls", None)]
    edges = spark.createDataFrame(rows, "pos long, src string, dst string, relation string, confidence string")
    for df in (degree.duplicate_edges(edges), resolve.merge_edges(edges)):
        assert "Exchange" in lines(df, capfd)[-1]  # the lowest of them
    assert [tuple(r) for r in degree.duplicate_edges(edges).collect()] == [("a", "b", "calls", 2)]
    assert {tuple(r) for r in resolve.merge_edges(edges).collect()} == {("a", "b", "calls", 1, "EXTRACTED", 2), ("b", "a", "calls", 3, None, 1)}


def test_definitions_are_dealt_before_they_are_counted(spark, capfd):
    nodes = spark.createDataFrame([("x", "f", "a.py"), ("y", "f", "b.py"), ("z", "g", "b.py")], "id string, label string, file string")
    edges = spark.createDataFrame([("z", "x", "imports")], "src string, dst string, relation string")
    df = review.same_named(nodes, edges)
    df.explain()
    assert "REPARTITION_BY_COL" in capfd.readouterr().out
    assert [tuple(r)[0::1] for r in df.select("name", "files", "definitions", "imported_by").collect()] == [("f", 2, 2, 1)]
