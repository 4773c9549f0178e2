"""Strongly connected components and cycles, by joins to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import cut


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that doesn't broadcast it: the tables of a loop, each small enough to be, add up in the driver."""
    return df.hint("merge")


def _trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges without those of nodes that nothing enters or leaves, some rounds deep: they are in no cycle."""
    for _ in range(rounds):
        inner = edges.select("src").distinct().join(_shuffled(edges.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
        inner = _shuffled(inner)
        edges = cut(edges.join(inner, "src", "left_semi").join(inner.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"), "trim")
    return edges


def _least_reaching(edges: DataFrame, ids: DataFrame, seed: int, rounds: int) -> DataFrame:
    """(id, label): the node of the least hash among those that reach a node, itself included; label is (hash, id).

    In each round a node takes the least label of its predecessors and the label of its label: what reaches the node
    that reaches it. Hashes make the order of nodes along a path random, so that labels' reach about doubles in a
    round, and rounds grow with the logarithm of the longest path on chains, rings and the like.
    """
    own = F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id").alias("id"))
    label = cut(ids.select("id", own.alias("label")), "label")
    for _ in range(rounds):
        handed = edges.join(_shuffled(label.withColumnRenamed("id", "src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("m"))
        jump = label.select(F.col("id").alias("at"), F.col("label").alias("further"))
        least = F.least("label", "m", "further")
        new = label.join(_shuffled(jump), label["label"]["id"] == jump["at"]).join(_shuffled(handed), "id", "left").select("id", least.alias("label"), (least < F.col("label")).alias("moved"))
        new = cut(new, "label")
        label = new.select("id", "label")
        if not new.where("moved").limit(1).count():
            return label
    raise RuntimeError(f"labels haven't settled in {rounds} rounds")


def strong_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component): nodes of components of two nodes or more; the component is its smallest id.

    Forward and backward at once from many pivots: every node takes the least node (by a hash) that reaches it; of
    those with the same, the nodes that reach it too are its component. The others are cut apart where either label
    differs, as no cycle crosses there, and labelled again under other hashes. ``RuntimeError`` if ``rounds`` of either
    kind don't suffice.
    """
    left = _trimmed(cut(edges.select("src", "dst").where("src <> dst").distinct(), "scc"))
    done = []
    for seed in range(rounds):
        if not left.limit(1).count():
            break
        ids = cut(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "scc")
        of = lambda label, end, name: _shuffled(label.select(F.col("id").alias(end), F.col("label").alias(name)))
        fore = _least_reaching(left, ids, seed, rounds)
        own = cut(left.join(of(fore, "src", "cs"), "src").join(of(fore, "dst", "cd"), "dst").where("cs = cd").select("src", "dst"), "scc")
        back = _least_reaching(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ids, seed, rounds)
        both = cut(fore.withColumnRenamed("label", "fore").join(_shuffled(back.withColumnRenamed("label", "back")), "id").select("id", "fore", "back", (F.col("fore") == F.col("back")).alias("found")), "scc")
        done.append(both.where("found").select("id", F.col("fore").alias("label")))
        rest = both.where("not found").select("id", F.col("back").alias("label"))
        left = _trimmed(own.join(of(rest, "src", "bs"), "src").join(of(rest, "dst", "bd"), "dst").where("bs = bd").select("src", "dst"))
    else:
        raise RuntimeError("strong components not settled")
    out = edges.sparkSession.createDataFrame([], "id string, component string")
    for member in done:
        least = member.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(member.join(_shuffled(least), "label").select("id", "component"))
    return out


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(component, size, edges): the groups, with how many distinct edges run inside each."""
    member = strong_components(edges)
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    inside = edges.select("src", "dst").where("src <> dst").distinct().join(_shuffled(member.withColumnRenamed("id", "src")), "src").join(_shuffled(member.select(F.col("id").alias("dst"), F.col("component").alias("d"))), "dst").where("component = d")
    return sizes.join(inside.groupBy("component").agg(F.count("*").alias("edges")), "component")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


def cycle_path(edges: DataFrame, component: DataFrame, start: str, hops: int = 50) -> DataFrame:
    """(step, id): a shortest loop through ``start`` inside a component (id). ``RuntimeError`` if it is longer than
    ``hops``; no rows if ``start`` is in no loop."""
    from .traverse import hop_distances, shortest_path

    ids = cut(component.select("id"), "component")
    # written once: each step of the walks reads it
    inside = cut(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "inside")
    back = inside.where((F.col("dst") == start) & (F.col("src") != start)).select("src").distinct()
    reach = hop_distances(inside, edges.sparkSession.createDataFrame([(start,)], "id string"), hops, until=back.withColumnRenamed("src", "id"))
    last = reach.join(back.withColumnRenamed("src", "id"), "id").orderBy("distance", "id").first()
    if last is None and back.limit(1).count():
        raise RuntimeError(f"no loop through {start} within {hops} steps")
    if last is None:
        return edges.sparkSession.createDataFrame([], "step long, id string")
    best = shortest_path(inside, start, last.id, int(last.distance))
    return best.union(edges.sparkSession.createDataFrame([(int(last.distance) + 1, start)], "step long, id string"))


#: When an import runs, earliest first.
RUNS = ("module-level", "deferred", "type-checking")


def tiered_cycles(edges: DataFrame, runs=RUNS) -> DataFrame:
    """(tier, component, size, signature): import cycles in the first tier that closes them.

    Edges (src, dst, runs). Tiers nest: what runs on load, then with deferred imports, then with those only for
    type checking. A group with the same members as one of an earlier tier isn't reported again. A tier begins with the
    groups of the one before it as single nodes, so what has been found isn't looked for again.
    """
    from .degree import set_signature

    rank = F.coalesce(F.array_position(F.array(*(F.lit(r) for r in runs)), F.col("runs")), F.lit(1)).cast("int")
    first = edges.groupBy("src", "dst").agg(F.min(F.when(rank == 0, 1).otherwise(rank)).alias("rank"))
    first = cut(first, "tiers")
    out = member = None
    for k, name in enumerate(runs, 1):
        own = first.where(F.col("rank") <= k).select("src", "dst")
        if member is None:
            member = cut(strong_components(own), "tier")
        else:
            of = lambda c: member.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
            merged = own.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("src_in", "src").alias("src"), F.coalesce("dst_in", "dst").alias("dst"))
            # a group's name is its smallest id, so the least name of those that join is their smallest id
            joined = cut(strong_components(merged).select(F.col("id").alias("component"), F.col("component").alias("wider")), "tier")
            inner = member.join(joined, "component", "left").select("id", F.coalesce("wider", "component").alias("component"))
            new = joined.join(member.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("wider").alias("component"))
            member = cut(inner.unionByName(new), "tier")
        groups = set_signature(member, "component", "id").select(F.lit(name).alias("tier"), "component", F.col("n").alias("size"), "signature")
        out = groups if out is None else out.unionByName(groups.join(out.select("signature"), "signature", "left_anti").select(groups.columns))
    return out


def module_imports(edges: DataFrame, runs=RUNS) -> DataFrame:
    """(src, dst, runs): one edge for each pair of files, at its earliest."""
    rank = F.array_position(F.array(*(F.lit(r) for r in runs)), F.coalesce("runs", F.lit(runs[0])))
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.min_by("runs", rank).alias("runs"))
