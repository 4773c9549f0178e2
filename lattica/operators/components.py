"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.snapshot import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each end of an edge the smallest node that it reaches.

    ``edges`` has two columns of one ordered type. Each round alternates two star operations on the edge
    table: every node hands its smaller neighbours' minimum to its larger ones, then to its smaller ones, until
    only stars are left. Both are a grouped minimum and a join on the same key, so a hub's neighbours are never
    gathered in one row. The table of each round is written to the shared folder. Rounds grow with the
    logarithm of the longest path; ``RuntimeError`` if ``rounds`` don't suffice. Null ends and loops are dropped.
    """
    a, b = edges.columns
    now = cut(_canonical(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node point to the least of its neighbourhood
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _canonical(both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b"))
        # small star: neighbours below a node, and it, point to the least of them; each edge has a < b
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*")
        now = cut(_canonical(small), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components not settled in {rounds} rounds")


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def no_edges(spark: SparkSession, kind: str = "long") -> DataFrame:
    return spark.createDataFrame([], f"a {kind}, b {kind}")
