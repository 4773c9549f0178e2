"""A property graph over relational tables: keys become nodes, references become typed edges.

``node_view`` and ``edge_view`` give the canonical columns that every operator takes. ``VIEW_SQL`` is the same
view in DuckDB's SQL, as the beginning of a WITH clause.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.snapshot import shared_dir

#: Order of the kinds in the graph; a node's or edge's position is its kind's rank times this, plus its key.
STEP = 1_000_000_000_000
#: Parts above this size aren't nodes, so edges to them dangle.
LARGEST_PART = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: dict[tuple, tuple] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make, tables: tuple[str, ...] | None = None) -> DataFrame:
    """The view of ``tables`` (by default ``VIEWED``) that ``make`` gives, written to the shared folder at its first use in a session, so that queries read
    its columns instead of joining the tables again. Tables that have changed since are viewed anew."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{sf_dir}/{t}.parquet" for t in tables or VIEWED])
    stamp = files.agg(F.count("*"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, name, *stamp)
    if key not in _written:
        df = make(spark, sf_dir)
        path = f"{shared_dir(spark)}/view-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _written[key] = path, df.schema
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


#: Tables that the view reads.
VIEWED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _node(df: DataFrame, rank: int, prefix: str, key: str, label, kind: str, file, community, external) -> DataFrame:
    return df.select(
        (F.lit(rank * STEP) + F.col(key).cast("long")).alias("pos"), _id(prefix, key).alias("id"), label.alias("label"), F.lit(kind).alias("type"), file.alias("file"), community.cast("long").alias("community"), external.alias("external")
    )


def part_file():
    top = F.when(F.col("p_size") <= 5, "vendor/").when(F.col("p_size") <= 8, "tests/").otherwise("catalog/")
    return F.concat(top, F.col("p_brand"), F.lit("/"), F.col("p_type"))


def node_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, id, label, type, file, community, external; written once a session."""
    return kept(spark, sf_dir, "nodes", _nodes)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    no = F.lit(False)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", F.concat(F.lit("geo/"), "r_name", F.lit("/"), "n_name").alias("place"))
    small = places.select("n_nationkey", "place")
    nodes = [
        _node(t("region"), 0, "r", "r_regionkey", F.col("r_name"), "region", F.concat(F.lit("geo/"), "r_name"), F.col("r_regionkey"), no),
        _node(places, 1, "n", "n_nationkey", F.col("n_name"), "nation", F.col("place"), F.col("n_regionkey"), no),
        _node(t("customer").join(small, F.col("c_nationkey") == F.col("n_nationkey")), 2, "c", "c_custkey", F.col("c_name"), "customer", F.concat("place", F.lit("/customer")), F.col("c_nationkey"), no),
        _node(t("supplier").join(small, F.col("s_nationkey") == F.col("n_nationkey")), 3, "s", "s_suppkey", F.col("s_name"), "supplier", F.concat("place", F.lit("/supplier")), F.col("s_nationkey"), F.col("s_acctbal") < 0),
        _node(t("part").where(F.col("p_size") <= LARGEST_PART), 4, "p", "p_partkey", F.col("p_name"), "part", part_file(), F.col("p_size") + 100, no),
        _node(t("orders"), 5, "o", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "order", F.concat(F.lit("orders/"), "o_orderstatus"), F.lit(None), no),
    ]
    out = nodes[0]
    for x in nodes[1:]:
        out = out.unionByName(x)
    return out


def _edge(df: DataFrame, rank: int, key, src, dst, relation: str, confidence) -> DataFrame:
    return df.select((F.lit(rank * STEP) + key.cast("long")).alias("pos"), src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), confidence.alias("confidence"))


def edge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, src, dst, relation, confidence; positions of one order's lines may tie, dst then decides. Written once a
    session."""
    return kept(spark, sf_dir, "edges", _edges)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    sure = F.lit("EXTRACTED")
    flag = F.when(F.col("l_returnflag") == "A", "AMBIGUOUS").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("EXTRACTED")
    edges = [
        _edge(t("nation"), 0, F.col("n_nationkey"), _id("r", "n_regionkey"), _id("n", "n_nationkey"), "contains", sure),
        _edge(t("customer"), 1, F.col("c_custkey"), _id("n", "c_nationkey"), _id("c", "c_custkey"), "contains", sure),
        _edge(t("supplier"), 2, F.col("s_suppkey"), _id("n", "s_nationkey"), _id("s", "s_suppkey"), "contains", sure),
        _edge(t("orders"), 3, F.col("o_orderkey"), _id("o", "o_orderkey"), _id("c", "o_custkey"), "calls", sure),
        _edge(t("lineitem"), 4, F.col("l_orderkey") * 10 + F.col("l_linenumber"), _id("o", "l_orderkey"), _id("p", "l_partkey"), "calls", flag),
        _edge(t("lineitem").select("l_suppkey", "l_partkey").distinct(), 5, F.col("l_suppkey") * 10_000_000 + F.col("l_partkey"), _id("s", "l_suppkey"), _id("p", "l_partkey"), "references", F.lit("INFERRED")),
    ]
    out = edges[0]
    for x in edges[1:]:
        out = out.unionByName(x)
    return out


def graph_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return node_view(spark, sf_dir), edge_view(spark, sf_dir)


def next_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, src, dst, relation: each part to the next line's part of the same brand in the same order, for all lines.
    It has cycles of many sizes and loops, unlike the references."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey", "p_brand").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    branded = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    lines = branded.withColumn("next", F.lead("l_partkey").over(order)).where("next is not null")
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), _id("p", "l_partkey").alias("src"), _id("p", "next").alias("dst"), F.lit("imports").alias("relation"))


NEXT_PART_SQL = """
next_part AS (
  SELECT 'p' || l_partkey AS src, 'p' || nxt AS dst, l_orderkey * 10 + l_linenumber AS pos FROM (
    SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey, p_brand ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nxt FROM lineitem JOIN part ON l_partkey = p_partkey
  ) WHERE nxt IS NOT NULL
)"""

VIEW_SQL = """
WITH RECURSIVE place AS (SELECT n_nationkey, n_name, n_regionkey, 'geo/' || r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) AS pos, 'r' || r_regionkey AS id, r_name AS label, 'region' AS type, 'geo/' || r_name AS file, CAST(r_regionkey AS BIGINT) AS community, false AS external FROM region
  UNION ALL SELECT 1000000000000 + n_nationkey, 'n' || n_nationkey, n_name, 'nation', place, CAST(n_regionkey AS BIGINT), false FROM place
  UNION ALL SELECT 2000000000000 + c_custkey, 'c' || c_custkey, c_name, 'customer', place || '/customer', CAST(c_nationkey AS BIGINT), false FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 3000000000000 + s_suppkey, 's' || s_suppkey, s_name, 'supplier', place || '/supplier', CAST(s_nationkey AS BIGINT), s_acctbal < 0 FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 4000000000000 + p_partkey, 'p' || p_partkey, p_name, 'part', CASE WHEN p_size <= 5 THEN 'vendor/' WHEN p_size <= 8 THEN 'tests/' ELSE 'catalog/' END || p_brand || '/' || p_type, CAST(p_size + 100 AS BIGINT), false FROM part WHERE p_size <= 25
  UNION ALL SELECT 5000000000000 + o_orderkey, 'o' || o_orderkey, 'Order ' || o_orderkey, 'order', 'orders/' || o_orderstatus, NULL, false FROM orders
),
edges AS (
  SELECT CAST(n_nationkey AS BIGINT) AS pos, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS relation, 'EXTRACTED' AS confidence FROM nation
  UNION ALL SELECT 1000000000000 + c_custkey, 'n' || c_nationkey, 'c' || c_custkey, 'contains', 'EXTRACTED' FROM customer
  UNION ALL SELECT 2000000000000 + s_suppkey, 'n' || s_nationkey, 's' || s_suppkey, 'contains', 'EXTRACTED' FROM supplier
  UNION ALL SELECT 3000000000000 + o_orderkey, 'o' || o_orderkey, 'c' || o_custkey, 'calls', 'EXTRACTED' FROM orders
  UNION ALL SELECT 4000000000000 + l_orderkey * 10 + l_linenumber, 'o' || l_orderkey, 'p' || l_partkey, 'calls', CASE l_returnflag WHEN 'A' THEN 'AMBIGUOUS' WHEN 'R' THEN 'INFERRED' ELSE 'EXTRACTED' END FROM lineitem
  UNION ALL SELECT 5000000000000 + l_suppkey * 10000000 + l_partkey, 's' || l_suppkey, 'p' || l_partkey, 'references', 'INFERRED' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
)"""
