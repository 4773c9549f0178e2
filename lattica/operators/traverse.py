"""Walks over the graph: breadth-first levels, provenance, paths, neighbourhoods, impact, all under a size budget.

Each level is one join of the frontier with the edges and one anti-join with what was reached before; levels are
written to the shared folder. Hop counts bound the number of jobs. The frontier is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_path
from ..plans.snapshot import cut
from .degree import degrees
from .scope import NON_DEPENDENCY, STATE, of_relations, strict


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, relation) in both orientations; a self-loop appears twice."""
    return edges.select("src", "dst", "relation").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) as the walk goes: ``out`` along edges, ``in`` against them, ``both``."""
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return out if direction == "out" else back if direction == "in" else out.unionAll(back)


def hop_distances(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out", until: DataFrame | None = None) -> DataFrame:
    """(id, distance) of all within ``hops`` of the seeds (id); seeds at 0. With ``until`` (id) the walk ends with the
    first hop that reaches one of these.

    Each hop reads the two columns of the edges once and joins them with the frontier, which is broadcast as long as
    it is small; the edges themselves are neither sorted nor shuffled. Give edges that are cheap to read (a table).
    """
    steps = oriented(edges, direction).where("src <> dst")
    seen = cut(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "hops")
    for d in range(1, hops + 1):
        frontier = seen.where(F.col("distance") == d - 1).select(F.col("id").alias("src"))
        found = steps.join(frontier, "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        new = cut(found.withColumn("distance", F.lit(d)), "hops")
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
        if until is not None and new.join(until, "id", "left_semi").limit(1).count():
            break
    return seen


def hop_records(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out") -> DataFrame:
    """(id, distance, via, relation, rank): how each node was first reached.

    Discovery is by queue order, then edge order: of the edges that reach a new node the one whose source has the
    smallest rank, then the smallest position, counts; ranks of a level follow that order. Seeds (id, rank) have
    distance 0. Edges need ``pos``.
    """
    e = edges.where("src <> dst").select("src", "dst", "relation", "pos")
    if direction != "out":
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "pos")
        e = back if direction == "in" else e.unionAll(back)
    none = F.lit(None).cast("string")
    seen = cut(seeds.select("id", F.lit(0).alias("distance"), none.alias("via"), none.alias("relation"), F.struct(F.lit(0).cast("long").alias("parent"), F.col("rank").cast("long").alias("pos"), F.col("id").alias("tie")).alias("order"), F.col("rank").cast("long").alias("rank")), "records")
    base = 1 << 40
    for d in range(1, hops + 1):
        frontier = seen.where(F.col("distance") == d - 1).select(F.col("id").alias("src"), F.col("rank").alias("parent"))
        reached = e.join(frontier, "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        order = F.struct("parent", "pos", F.col("dst").alias("tie"))
        first = reached.groupBy(F.col("dst").alias("id")).agg(F.min(order).alias("order"), F.min_by("src", order).alias("via"), F.min_by("relation", F.struct(order, "relation")).alias("relation"))
        # dense ranks aren't needed: any number that grows with (parent, pos, tie) keeps the queue's order
        ranked = _numbered(first, base * d)
        new = cut(ranked.select("id", F.lit(d).alias("distance"), "via", "relation", "order", "rank"), "records")
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
    return seen.drop("order")


def _numbered(df: DataFrame, start: int) -> DataFrame:
    """Rows numbered from ``start`` in the order of ``order``: sorted by ranges, then a base for each range."""
    dealt = cut(df.repartitionByRange("order").sortWithinPartitions("order").withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "dealt")
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("i0"))  # a row for each partition
    bases = sizes.withColumn("base", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    return dealt.join(F.broadcast(bases.select("__p", "i0", F.coalesce("base", F.lit(0)).alias("base"))), "__p").withColumn("rank", F.lit(start) + F.col("base") + F.col("__i") - F.col("i0")).drop("__p", "__i", "i0", "base")


def shortest_path(edges: DataFrame, src: str, dst: str, hops: int = 12, direction: str = "out") -> DataFrame:
    """(step, id): the nodes of the first shortest path; no rows if there is none within ``hops``."""
    spark = edges.sparkSession
    reached = hop_records(edges, spark.createDataFrame([(src, 0)], "id string, rank long"), hops, direction)
    at, steps = dst, []
    while at is not None and len(steps) <= hops:  # one row for each step
        row = reached.where(F.col("id") == at).select("via", "distance").first()
        if row is None:
            return spark.createDataFrame([], "step long, id string")
        steps.append((int(row.distance), at))
        at = row.via
    return spark.createDataFrame(sorted(steps), "step long, id string")


def beyond(edges: DataFrame, reached: DataFrame, direction: str = "out") -> DataFrame:
    """One row: how many nodes one more hop would add."""
    steps = oriented(edges, direction)
    new = steps.join(reached.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).join(reached.select("id"), "id", "left_anti")
    return new.agg(F.countDistinct("id").alias("beyond"))


def neighbours(nodes: DataFrame, edges: DataFrame, node: str, limit: int = 200) -> DataFrame:
    """(id, relation, direction, degree): each once; tests last, then by degree, then id."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "relation", F.lit("out").alias("direction"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("id"), "relation", F.lit("in").alias("direction"))
    own = out.unionAll(into).distinct().join(degrees(edges), "id").join(nodes.select("id", "file"), "id", "left")
    own = own.withColumn("test", is_test_path(F.coalesce("file", F.lit(""))))
    return own.orderBy("test", F.desc("degree"), "id", "relation", "direction").limit(limit).select("id", "relation", "direction", "degree", "test")


def neighbour_tally(edges: DataFrame, node: str) -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "relation", F.lit("out").alias("direction"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("id"), "relation", F.lit("in").alias("direction"))
    return out.unionAll(into).distinct().groupBy("relation", "direction").agg(F.count("*").alias("n"))


def running_sum(rows: DataFrame, size: Column, *order: Column) -> DataFrame:
    """(whole, n, own, sum): each row as a struct, its place from 1 in the order, its size, and the sum of sizes up to it.

    Rows are dealt by ranges of ``order``; each range counts and sums on its own, a row for each range is summed up to
    its base, so no window is over all rows. Rows that tie share a range, in any order.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(sorted_.select(F.struct(*rows.columns).alias("whole"), size.alias("own"), F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")), "dealt")
    inside = Window.partitionBy("__p").orderBy("__i")
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = dealt.groupBy("__p").agg(F.count("*").alias("rows"), F.sum("own").alias("size"))
    bases = sums.select("__p", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("rows"), F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("size"))
    return dealt.join(F.broadcast(bases), "__p").select("whole", (F.col("rows") + F.row_number().over(inside)).alias("n"), "own", (F.col("size") + F.sum("own").over(inside)).alias("sum"))


def within_budget(rows: DataFrame, size: Column, budget: float, *order: Column, start: float = 98, per: float = 3.5, crossing: bool = False) -> DataFrame:
    """Rows in order until their sizes reach the budget: the first always; the one that crosses only if wanted. Sums run
    by ranges of the order (``running_sum``)."""
    total = running_sum(rows, size + 2, *order).withColumn("s", (F.lit(start) + F.col("sum")) / per)
    before = (F.col("s") * per - F.col("own")) / per
    return total.where((F.col("n") == 1) | ((before if crossing else F.col("s")) < budget)).select("whole.*")


def subgraph(nodes: DataFrame, edges: DataFrame, node: str, hops: int = 2, budget: float = 1500) -> DataFrame:
    """(src, dst, relation, distance): edges around a node, each unordered pair and relation once in its true
    orientation, nearest first, under a budget that the crossing edge still fits in."""
    spark = edges.sparkSession
    near = hop_distances(edges, spark.createDataFrame([(node,)], "id string"), hops, "both")
    met = edges.join(near.select(F.col("id").alias("src"), F.col("distance").alias("ds")), "src").join(near.select(F.col("id").alias("dst"), F.col("distance").alias("dd")), "dst")
    met = met.where(F.least("ds", "dd") < hops).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation").agg(F.min_by(F.struct("src", "dst"), "pos").alias("e"), F.min(F.least("ds", "dd")).alias("distance"))
    rows = met.select("e.src", "e.dst", "relation", "distance")
    size = F.length("src") + F.length("dst") + F.length("relation") + 40
    return within_budget(rows, size, budget, F.col("distance"), F.col("src"), F.col("dst"), F.col("relation"), crossing=True)


def impact(nodes: DataFrame, edges: DataFrame, node: str, direction: str = "in", hops: int = 3, relations: str | None = None, only_read: bool = False, budget: float | None = None) -> DataFrame:
    """(id, distance, direction, degree, test): what depends on a node, or what it depends on.

    Containment, rationale and state edges don't carry impact unless asked for. Reached both ways, the smaller
    distance counts, dependents before dependencies. Members of the node are seeds with it.
    """
    spark = edges.sparkSession
    e = strict(edges) if only_read else edges
    carried = of_relations(e, relations) if relations else e.where(~F.lower("relation").isin(*NON_DEPENDENCY, *STATE))
    own = edges.where((F.col("src") == node) & F.lower("relation").isin("method", "contains")).select(F.col("dst").alias("id"))
    seeds = cut(spark.createDataFrame([(node,)], "id string").union(own).distinct(), "seeds")
    parts = [hop_distances(carried, seeds, hops, d).withColumn("direction", F.lit(d)) for d in (("in", "out") if direction == "both" else (direction,))]
    hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = hits.where("distance > 0").groupBy("id").agg(F.min(F.struct("distance", "direction")).alias("b")).select("id", "b.*")  # "in" sorts before "out"
    rows = best.join(degrees(edges), "id", "left").join(nodes.select("id", "label", "file"), "id", "left").withColumn("test", is_test_path(F.coalesce("file", F.lit(""))))
    rows = rows.select("id", "distance", "direction", F.coalesce("degree", F.lit(0)).alias("degree"), "test", F.coalesce("label", "id").alias("label"))
    if budget is None:
        return rows
    return within_budget(rows, F.length("id") + F.length("label") + 60, budget, F.col("distance"), F.col("test"), F.desc("degree"), F.col("label"), F.col("id"))


def tests_for(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(id, tier): tests that use a node directly, or through one caller that isn't a test."""
    use = edges.where(~F.lower("relation").isin(*NON_DEPENDENCY, *STATE, "imports", "imports_from")).select("src", "dst")
    own = edges.where((F.col("src") == node) & (F.lower("relation") == "method")).select(F.col("dst").alias("id")).union(edges.sparkSession.createDataFrame([(node,)], "id string")).distinct()
    file = nodes.select("id", is_test_path(F.coalesce("file", F.lit(""))).alias("test"))
    callers = use.join(own.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct().join(own, "id", "left_anti").join(file, "id")
    direct = callers.where("test").select("id", F.lit("direct").alias("tier"))
    through = use.join(callers.where("not test").select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct().join(own, "id", "left_anti").join(file.where("test"), "id").join(direct.select("id"), "id", "left_anti")
    return direct.unionByName(through.select("id", F.lit("through").alias("tier")))


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(src, dst, distance): all pairs within ``depth`` steps, for sparse hierarchies such as inheritance."""
    step = edges.select("src", "dst").where("src <> dst").distinct()
    seen = cut(step.withColumn("distance", F.lit(1)), "closure")
    for d in range(2, depth + 1):
        more = seen.where(F.col("distance") == d - 1).select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst").distinct().join(seen.select("src", "dst"), ["src", "dst"], "left_anti")
        new = cut(more.withColumn("distance", F.lit(d)), "closure")
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
    return seen


def compose_prefixes(routers: DataFrame, mounts: DataFrame, depth: int = 8) -> DataFrame:
    """(router, prefix): every path under which a router (router, own) is reached through mounts (parent, child,
    prefix). An unmounted router has its own prefix; mounts on a cycle or deeper than ``depth`` start anew."""
    join = lambda *xs: F.regexp_replace(F.concat_ws("", *(F.regexp_replace(F.coalesce(x, F.lit("")), "/+$", "") for x in xs)), "/{2,}", "/")
    mounted = mounts.select(F.col("child").alias("router")).distinct()
    start = routers.join(mounted, "router", "left_anti")
    level = cut(start.select("router", join("own").alias("prefix"), F.array("router").alias("trail")), "prefixes")
    found = level.select("router", "prefix")
    for _ in range(depth):
        step = level.join(mounts.withColumnRenamed("prefix", "at"), level["router"] == mounts["parent"]).where(~F.array_contains("trail", F.col("child")))
        level = cut(step.select(F.col("child").alias("router"), "prefix", "at", "trail").join(routers, "router").select("router", join("prefix", "at", "own").alias("prefix"), F.concat("trail", F.array("router")).alias("trail")), "prefixes")
        if not level.limit(1).count():
            break
        found = found.union(level.select("router", "prefix"))
    rest = routers.join(found.select("router").distinct(), "router", "left_anti").select("router", join("own").alias("prefix"))
    return found.union(rest).distinct()
