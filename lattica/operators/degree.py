"""Counts over the graph: degrees, overview, lint, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ends(edges: DataFrame) -> DataFrame:
    """(id): both ends of every edge; a self-loop's twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of all ids in edges, dangling ones too. Map-side partial counts keep hubs from one task."""
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The nodes of the highest degree; ties by id. Ids without a node keep null columns."""
    best = degrees(edges).orderBy(F.desc("degree"), "id").limit(top)
    return best.join(nodes.select("id", "label", "type"), "id", "left")


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of nodes, edges and communities, and nodes that repeat an id."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("community").alias("n_communities"), (F.count("*") - F.countDistinct("id")).alias("id_collisions"))
    e = edges.agg(F.count("*").alias("n_edges"), F.countDistinct("relation").alias("n_relations"))
    return n.crossJoin(e)  # one row each


def relation_tally(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation", "confidence").agg(F.count("*").alias("n"))


def node_tally(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that isn't a node."""
    ids = nodes.select("id").distinct()
    there = lambda c: ids.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_there"))
    met = edges.join(there("src"), "src", "left").join(there("dst"), "dst", "left").where("src_there is null or dst_there is null")
    return met.select("src", *(c for c in edges.columns if c != "src"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of independent counts: dangling, self-loops that aren't calls, recursive calls, repeats of the same
    (src, dst, relation), nodes without edges."""
    ids = nodes.select("id").distinct().withColumn("there", F.lit(1))
    ended = edges.join(ids.select(F.col("id").alias("src"), F.col("there").alias("s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.col("there").alias("d")), "dst", "left")
    loop, call = F.col("src") == F.col("dst"), F.lower(F.trim("relation")).isin("calls", "indirect_call")
    lint = ended.agg(F.count_if(F.col("s").isNull() | F.col("d").isNull()).alias("dangling"), F.count_if(loop & ~call).alias("self_loops"), F.count_if(loop & call).alias("recursive"))
    repeats = edges.groupBy("src", "dst", "relation").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    orphans = nodes.select("id").distinct().join(ends(edges).distinct(), "id", "left_anti").agg(F.count("*").alias("orphans"))
    return lint.crossJoin(repeats).crossJoin(orphans)  # one row each


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges).distinct(), "id", "left_anti")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, n) of more than one. Edges are shuffled before they are counted: nearly all are distinct, so
    a task that counted the file parts it reads would hold them all and save nothing."""
    return edges.select("src", "dst", "relation").repartition("src", "dst", "relation").groupBy("src", "dst", "relation").agg(F.count("*").alias("n")).where("n > 1")


def community_sizes(nodes: DataFrame, edges: DataFrame, members: int = 3) -> DataFrame:
    """Per community: size, and its members of the highest degree (ties by id)."""
    known = nodes.where("community is not null").select("id", "community").join(degrees(edges), "id", "left").fillna(0, ["degree"])
    rank = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    sized = known.groupBy("community").agg(F.count("*").alias("size"))
    top = known.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= members)
    return top.join(sized, "community").select("community", "size", F.col("rank").cast("long").alias("rank"), "id", "degree")


def degree_cut(edges: DataFrame, share: float = 0.99, least: int = 20) -> DataFrame:
    """One row: the degree at place ``int(n * share)`` of the ascending degrees, ``least`` at least.

    Degrees are counted per value first, so the running count covers as many rows as there are distinct degrees.
    """
    per = degrees(edges).groupBy("degree").agg(F.count("*").alias("k"))
    total = per.agg(F.sum("k").alias("n"))
    running = per.withColumn("upto", F.sum("k").over(Window.orderBy("degree")))
    at = running.crossJoin(total).where(F.col("upto") > F.floor(F.col("n") * share))
    return at.agg(F.greatest(F.lit(least), F.min("degree")).cast("long").alias("cut"))


def directory_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between diverging directories: how many, and how many distinct ends on each side."""
    from ..functions.paths import diverging

    file = nodes.where("file <> ''").select("id", "file")
    met = edges.join(file.select(F.col("id").alias("src"), F.col("file").alias("f")), "src").join(file.select(F.col("id").alias("dst"), F.col("file").alias("g")), "dst")
    pairs = met.withColumn("d", diverging(F.col("f"), F.col("g"))).where("d is not null")
    return pairs.groupBy(F.element_at("d", 1).alias("from_dir"), F.element_at("d", 2).alias("to_dir")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


def set_signature(members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n, signature): a hash of each group's sorted members that doesn't depend on their order.

    Two sums of 64-bit hashes, so that a group of any size is aggregated in parts.
    """
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), member).cast("decimal(38,0)")).cast("string")
    return members.select(group, member).distinct().groupBy(group).agg(F.count("*").alias("n"), F.sha1(F.concat_ws(":", h(1), h(2))).alias("signature"))
