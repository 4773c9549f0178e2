"""From names to nodes, and joins of nodes with what surrounds them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import bare_name, is_file_hub
from .scope import CONTAINMENT, HTTP, IMPORTS, NON_DEPENDENCY


def exact_index(nodes: DataFrame) -> DataFrame:
    """(name, id): ids and labels in one namespace; of nodes with the same name the first in graph order."""
    names = nodes.select(F.explode(F.array("id", "label")).alias("name"), "id", "pos")
    return names.groupBy("name").agg(F.min_by("id", F.struct("pos", "id")).alias("id"))


def by_name(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes whose label or bare name is ``label`` or its bare name, in graph order; a file's own node only by label."""
    bare = bare_name(F.col("label"))
    wanted = bare_name(F.lit(label))
    hit = (F.col("label") == label) | ((bare == wanted) & ~is_file_hub(F.col("label"), F.coalesce("file", F.lit(""))))
    return nodes.where(hit).orderBy("pos", "id")


def substring_matches(nodes: DataFrame, key: str, cap: int = 6) -> DataFrame:
    """The first ``cap`` nodes whose label or id contains the key, with the number of all."""
    hits = nodes.where(F.contains(F.lower("label"), F.lit(key.lower())) | F.contains(F.lower("id"), F.lit(key.lower())))
    return hits.orderBy("pos").limit(cap).crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))  # one row


def close_matches(nodes: DataFrame, key: str, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """The bare names most like the key by longest matching blocks, best first; SQL has no such measure."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        m = SequenceMatcher(b=key)

        def of(name: str) -> float:
            m.set_seq1(name or "")
            return m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0

        return names.map(of)

    names = nodes.select(bare_name(F.col("label")).alias("name")).distinct()
    return names.withColumn("score", ratio("name")).where(F.col("score") >= cutoff).orderBy(F.desc("score"), "name").limit(n)


def pick(nodes: DataFrame, key: str) -> DataFrame:
    """The node that a key means, with how it was found and how many others fit.

    An id before a label or bare name (definitions before files), before a qualified name's end, before a file's
    path, before a part of a label.
    """
    label, bare = F.col("label"), bare_name(F.col("label"))
    low, part = F.lower("label"), F.lit(key.lower())
    hub = is_file_hub(label, F.coalesce("file", F.lit("")))
    prio = F.when(F.col("id") == key, 0).when((label == key) & ~hub, 1).when((bare == bare_name(F.lit(key))) & ~hub, 2).when(F.endswith(label, F.lit("." + key)) | F.endswith(label, F.lit("::" + key)), 3).when((label == key) | (F.col("file") == key), 4).when(F.contains(low, part) | F.contains(F.lower("id"), part), 5)
    hits = nodes.withColumn("prio", prio).where("prio is not null")
    best = hits.groupBy("prio").agg(F.min_by("id", F.struct("pos", "id")).alias("id"), F.count("*").alias("total")).orderBy("prio").limit(1)
    how = F.element_at(F.array(*(F.lit(x) for x in ("id", "label", "name", "qualified", "file", "part"))), F.col("prio") + 1)
    return best.select("id", how.alias("how"), (F.col("total") - 1).alias("others"))


def node_details(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """One row: the node with its degrees by direction."""
    there = nodes.where(F.col("id") == node)
    out = edges.where((F.col("src") == node) | (F.col("dst") == node)).agg(F.count_if(F.col("src") == node).alias("n_out"), F.count_if(F.col("dst") == node).alias("n_in"), F.countDistinct("relation").alias("n_relations"))
    return there.crossJoin(out)  # one row each


def file_edges(nodes: DataFrame, edges: DataFrame, relations=IMPORTS) -> DataFrame:
    """(src_file, dst_file, n): edges of the relations lifted to files; within a file and without one they go."""
    file = nodes.where("file <> ''").select("id", "file")
    met = edges.where(F.lower("relation").isin(*relations)).join(file.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(file.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    return met.where("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count("*").alias("n"))


def linked_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unordered pairs of files with a dependency between them."""
    file = nodes.where("file <> ''").select("id", "file")
    met = edges.where(~F.lower("relation").isin(*NON_DEPENDENCY)).join(file.select(F.col("id").alias("src"), F.col("file").alias("f")), "src").join(file.select(F.col("id").alias("dst"), F.col("file").alias("g")), "dst")
    return met.where("f <> g").select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b")).distinct()


def touches(edges: DataFrame) -> DataFrame:
    """(definition, state, writes, reads) of ``reads`` and ``writes`` edges."""
    own = edges.where(F.lower("relation").isin("reads", "writes"))
    return own.groupBy(F.col("src").alias("definition"), F.col("dst").alias("state")).agg(F.max(F.lower("relation") == "writes").alias("writes"), F.max(F.lower("relation") == "reads").alias("reads"))


def state_neighbours(edges: DataFrame, definition: str, cap: int = 15) -> DataFrame:
    """Other definitions that touch the same state as one; two readers don't affect each other."""
    own = touches(edges)
    mine = own.where(F.col("definition") == definition).select("state", F.col("writes").alias("w"), F.col("reads").alias("r"))
    met = own.where(F.col("definition") != definition).join(mine, "state").where("w or writes")
    effect = F.when(F.col("w") & F.col("writes"), "both_write").when(F.col("w"), "reads_mine").otherwise("writes_mine")
    return met.select("state", "definition", effect.alias("effect")).orderBy("state", "definition").limit(cap)


def with_written_by(edges: DataFrame) -> DataFrame:
    """For each ``writes`` edge also the reverse ``written_by``."""
    back = edges.where(F.lower("relation") == "writes")
    return edges.unionByName(back.select(*(F.col("dst").alias("src") if c == "src" else F.col("src").alias("dst") if c == "dst" else F.lit("written_by").alias("relation") if c == "relation" else F.col(c) for c in edges.columns)))


def routes(edges: DataFrame) -> DataFrame:
    """(route, handlers, callers): how many definitions handle each route and how many call it."""
    own = edges.where(F.lower("relation").isin(*HTTP))
    route = F.when(F.lower("relation") == "handles", F.col("src")).otherwise(F.col("dst"))
    other = F.when(F.lower("relation") == "handles", F.col("dst")).otherwise(F.col("src"))
    return own.groupBy(route.alias("route")).agg(F.countDistinct(F.when(F.lower("relation") == "handles", other)).alias("handlers"), F.countDistinct(F.when(F.lower("relation") == "http_calls", other)).alias("callers"))


def members(edges: DataFrame) -> DataFrame:
    """(owner, member) of containment."""
    return edges.where(F.lower("relation").isin(*CONTAINMENT)).select(F.col("src").alias("owner"), F.col("dst").alias("member")).distinct()


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order, which should be total."""
    ranked = df.select(F.struct(*df.columns).alias("whole"), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("rank"))
    return ranked.where("rank = 1").select("whole.*")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, relation): the site of the first, the surest confidence, the earliest run. Edges
    are shuffled first: nearly all are distinct, and a task that merged what it reads would hold them all."""
    sure = F.element_at(F.create_map(*(F.lit(x) for x in ("EXTRACTED", 0, "INFERRED", 1, "AMBIGUOUS", 2))), F.coalesce("confidence", F.lit("EXTRACTED")))
    own = edges.select("src", "dst", "relation", "pos", "confidence").repartition("src", "dst", "relation")
    return own.groupBy("src", "dst", "relation").agg(F.min("pos").alias("pos"), F.min_by("confidence", sure).alias("confidence"), F.count("*").alias("n"))


def did_you_mean(nodes: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(rank, name, why) for a key that no node has: up to ``n`` alternatives, those that contain it first, then those
    that are spelled like it."""
    bare = bare_name(F.col("label"))
    part = nodes.where(F.contains(F.lower("label"), F.lit(key.lower()))).groupBy(bare.alias("name")).agg(F.min("pos").alias("pos")).select("name", F.lit("contains").alias("why"), F.lit(0).alias("prio"), F.col("pos").cast("double").alias("order"))
    like = close_matches(nodes, key, n).select("name", F.lit("spelled like").alias("why"), F.lit(1).alias("prio"), (-F.col("score")).alias("order"))
    both = part.unionByName(like).groupBy("name").agg(F.min(F.struct("prio", "order", "why")).alias("x"))
    order = Window.orderBy("x.prio", "x.order", "name")
    best = both.orderBy("x.prio", "x.order", "name").limit(n)  # so few rows that one window numbers them
    return best.select(F.row_number().over(order).cast("long").alias("rank"), "name", F.col("x.why").alias("why"))


def explain(nodes: DataFrame, edges: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """(part, id, relation, n): what is known of a key: the node it means (``node``), its neighbours by relation and
    direction (``out``, ``in``) with how many there are of each; the first ``limit`` of each direction by relation, id."""
    picked = pick(nodes, key).select("id")
    met = edges.join(picked.withColumnRenamed("id", "src"), "src", "left_semi").select(F.lit("out").alias("part"), F.col("dst").alias("id"), "relation").unionByName(edges.join(picked.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.lit("in").alias("part"), F.col("src").alias("id"), "relation"))
    counted = met.groupBy("part", "id", "relation").agg(F.count("*").alias("n"))
    first = counted.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("relation", "id"))).where(F.col("k") <= limit).drop("k")
    return picked.select(F.lit("node").alias("part"), "id", F.lit(None).cast("string").alias("relation"), F.lit(None).cast("long").alias("n")).unionByName(first)
