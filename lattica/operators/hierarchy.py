"""Labels of a hierarchy by which "is below" is a comparison of two numbers, without a table of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import cut
from .traverse import running_sum

#: Numbers that one join key covers where nodes are looked up below others.
BLOCK = 4096


def labels(edges: DataFrame) -> DataFrame:
    """(id, parent, depth, pre, size) of every node of the forest ``edges`` (src above dst): its place from 0 when each node
    comes before its children, siblings and roots by id, and how many nodes it has below it, itself included. A node
    is below another if its ``pre`` is among the ``size`` numbers from the other's on.

    The tour that enters and leaves each node is a list; every element doubles its reach each round and adds up what
    it passes, so rounds grow with the logarithm of the nodes, however deep the forest. No element has two
    predecessors, so no key of the joins is hot, however many children a node has. Repeated edges and those with a null
    end count once and not at all; other columns are ignored. A node with two parents or on a cycle is a ``ValueError``.
    """
    pairs = cut(edges.select(F.col("src").alias("parent"), F.col("dst").alias("id")).dropna().distinct(), "parents")
    if pairs.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a node has two parents")
    roots = pairs.select(F.col("parent").alias("id")).distinct().join(pairs.select("id"), "id", "left_anti")
    rows = pairs.unionByName(roots.select(F.lit(None).cast("string").alias("parent"), "id"))
    placed = cut(running_sum(rows, F.lit(1), F.asc_nulls_first("parent"), F.asc("id")).select("whole.parent", "whole.id", "n"), "placed")
    total = 2 * placed.count()
    after = placed.select((F.col("n") - 1).alias("n"), F.col("parent").alias("p"), F.lit(True).alias("there"))
    met = placed.join(after, "n", "left").withColumn("last", ~(F.col("there").isNotNull() & F.col("p").eqNullSafe(F.col("parent"))))
    first = placed.groupBy(F.col("parent").alias("id")).agg(F.min("n").alias("child"))
    enter = placed.join(first, "id", "left").select((2 * F.col("n")).alias("e"), F.coalesce(2 * F.col("child"), 2 * F.col("n") + 1).alias("next"), F.lit(1).alias("lift"))
    between = met.where("not last").select((2 * F.col("n") + 1).alias("e"), (2 * F.col("n") + 2).alias("next"), F.lit(-1).alias("lift"))
    ends = met.where("last").join(placed.select(F.col("id").alias("parent"), F.col("n").alias("up")), "parent", "left")
    leave = ends.select((2 * F.col("n") + 1).alias("e"), (2 * F.col("up") + 1).alias("next"), F.lit(-1).alias("lift"))
    tour = cut(enter.unionByName(between).unionByName(leave).withColumn("steps", F.lit(1).cast("long")).withColumn("lift", F.col("lift").cast("long")), "tour")
    for _ in range(total.bit_length()):
        ahead = tour.select(F.col("e").alias("next"), F.col("next").alias("beyond"), F.col("steps").alias("s"), F.col("lift").alias("l"))
        more = lambda own, passed: (F.col(own) + F.coalesce(passed, F.lit(0))).alias(own)
        tour = cut(tour.join(ahead, "next", "left").select("e", F.col("beyond").alias("next"), more("steps", "s"), more("lift", "l")), "tour")
    if tour.where("next is not null").limit(1).count():
        raise ValueError("a node is below itself")
    both = tour.groupBy(F.floor(F.col("e") / 2).alias("n")).agg(F.max("steps").alias("entered"), F.min("steps").alias("left"), F.max_by(-F.col("lift"), "steps").alias("depth"))
    named = placed.join(both, "n").withColumn("at", F.lit(total) - F.col("entered"))
    return named.select("id", "parent", "depth", F.expr("(at + depth) div 2").alias("pre"), F.expr("(entered - left + 1) div 2").alias("size"))


def below(labelled: DataFrame, tops: DataFrame) -> DataFrame:
    """(top, id, distance): the nodes below each of ``tops`` (id), by their labels. A top that has no label has none.

    A node meets the tops of its own ``BLOCK`` numbers only, and a top is looked up in the blocks that it covers."""
    wanted = labelled.join(tops.select("id").distinct(), "id", "left_semi").where("size > 1")
    span = F.sequence(F.floor((F.col("pre") + 1) / BLOCK), F.floor((F.col("pre") + F.col("size") - 1) / BLOCK))
    above = wanted.select(F.col("id").alias("top"), F.col("pre").alias("low"), (F.col("pre") + F.col("size")).alias("high"), F.col("depth").alias("d"), F.explode(span).alias("block"))
    nodes = labelled.select("id", "pre", "depth", F.floor(F.col("pre") / BLOCK).alias("block"))
    return nodes.join(above, "block").where("pre > low and pre < high").select("top", "id", (F.col("depth") - F.col("d")).alias("distance"))
