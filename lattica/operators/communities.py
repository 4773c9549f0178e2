"""Communities: edge weights, directory ties, partition by local moves, modularity, cohesion, votes, stable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dirname, is_file_hub, is_test_path, top_dir
from ..plans.snapshot import bucketed, cut
from . import local_moves
from .components import connected_components

# Fixed weights by relation.
RELATION_WEIGHTS = {"contains": 1.0, "method": 1.0, "defines": 1.0, "case_of": 1.0, "calls": 1.0, "inherits": 1.5, "implements": 1.5, "mixes_in": 1.5, "embeds": 1.5}
# Imports of a file and of something in it; every other relation.
IMPORT_OF_FILE, IMPORT_OF_PART, OTHER = 0.7, 0.4, 0.5
CLIQUE, TIE, RING = 64, 0.1, 0.05


def edge_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight) of unordered pairs: by relation, halved if guessed, more inside a directory, less across top
    directories and between tests and other code. External nodes take no part."""
    file = F.coalesce("file", F.lit(""))
    hub = F.coalesce(is_file_hub(F.col("label"), file) & (file != ""), F.lit(False)) if "label" in nodes.columns else F.lit(False)
    inner = nodes.where(~F.coalesce("external", F.lit(False))).select("id", file.alias("file"), hub.alias("hub"))
    met = edges.where("src <> dst").join(inner.select(F.col("id").alias("src"), F.col("file").alias("f")), "src").join(inner.select(F.col("id").alias("dst"), F.col("file").alias("g"), "hub"), "dst")
    pairs = [F.lit(x) for kv in RELATION_WEIGHTS.items() for x in kv]
    imported = F.when(F.col("relation").isin("imports", "imports_from"), F.when(F.col("hub"), IMPORT_OF_FILE).otherwise(IMPORT_OF_PART))
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), "relation"), imported, F.lit(OTHER)) * F.when(F.col("confidence") == "INFERRED", 0.5).otherwise(1.0)
    known = (F.col("f") != "") & (F.col("g") != "") & (F.col("f") != F.col("g"))
    weight = weight * F.when(known & (dirname(F.col("f")) == dirname(F.col("g"))), 1.25).when(known & (top_dir(F.col("f")) != top_dir(F.col("g"))), 0.6).otherwise(1.0)
    weight = weight * F.when(is_test_path(F.col("f")) != is_test_path(F.col("g")), 0.1).otherwise(1.0)
    return met.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(weight).alias("weight"))


def directory_ties(files: DataFrame) -> DataFrame:
    """(a, b, weight) between files (file) of a directory: all pairs of up to 64, beyond that a ring."""
    named = files.select("file", dirname(F.col("file")).alias("dir")).distinct()
    sizes = named.groupBy("dir").agg(F.count("*").alias("k"))
    met = named.join(sizes, "dir").where("k > 1")
    small = met.where(F.col("k") <= CLIQUE)
    pairs = small.select("dir", F.col("file").alias("a"), "k").join(small.select("dir", F.col("file").alias("b")), "dir").where("a < b")  # at most 64 a directory
    order = Window.partitionBy("dir").orderBy("file")
    ring = met.where(F.col("k") > CLIQUE).select(F.col("file").alias("a"), F.coalesce(F.lead("file").over(order), F.first("file").over(order)).alias("b"))
    return pairs.select("a", "b", (TIE / (F.col("k") - 1)).alias("weight")).unionByName(ring.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(RING).alias("weight")))


def _both(weights: DataFrame) -> DataFrame:
    return weights.select("a", "b", "weight").unionByName(weights.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def partition(weights: DataFrame, rounds: int = 200, resolution: float = 1.0, tolerance: float = 1e-4, finest: int = 16, start: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """(id, community): every node starts alone (or in its community of ``start``: id, community) and moves to the
    neighbouring community of the greatest gain in modularity, a part of the nodes (by a hash that changes) in each
    round: a half at first, and a smaller part, down to one in ``finest``, whenever a round gains less than
    ``tolerance`` of modularity. A round that loses is taken back, so moves that undo each other come to an end.

    A distributed form of sequential local moves: each round writes one row a node, its best move, from which the next
    communities are read; equal gains go to the smallest community, so that reruns agree. Where none of those that gain would move, all do; where
    none gains, the moves are done. Loops (a = b) count for a node's strength. Nodes are numbered in the order of their ids; links lie by the node that they
    lead to, with its community's strength beside it, so a round shuffles them once, to the node that moves. ``total``: the strength of the whole graph, if ``weights`` are some of its
    components only. ``RuntimeError`` if the moves don't settle within ``rounds``.
    """
    from .traverse import _numbered

    links = cut(_both(weights), "links")
    strength = links.groupBy(F.col("a").alias("id")).agg(F.sum(F.col("weight") * F.when(F.col("a") == F.col("b"), 2).otherwise(1)).alias("k"))
    nodes = cut(_numbered(strength.withColumn("order", F.struct("id")), 0).select("id", F.col("rank").alias("n"), "k"), "nodes")
    size = nodes.agg(F.sum("k").alias("k"), F.count("*").alias("n")).first()
    total = total or size.k
    now = nodes.select(F.col("n").alias("id"), F.col("n").alias("community"), "k")
    if start is not None:
        begun = cut(nodes.join(start.select("id", F.col("community").cast("string").alias("c")), "id", "left").select("n", "k", F.coalesce("c", "id").alias("c")), "partition")
        ranked = _numbered(begun.select("c").distinct().withColumn("order", F.struct("c")), 0).select("c", "rank")
        now = begun.join(ranked, "c").select(F.col("n").alias("id"), F.col("rank").alias("community"), "k")
    if not total:
        return _by_least(now, nodes)
    number = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"))
    met = links.where("a <> b").join(number("a"), "a").join(number("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "weight")
    met = met.unionByName(nodes.select(F.col("n").alias("a"), F.col("n").alias("b"), F.lit(0.0).alias("weight")))  # so that each node meets its own community
    tasks = (links.count() + size.n) // ROWS + 1
    lying = bucketed(met.repartition(int(tasks), "b").sortWithinPartitions("b"), "between", int(tasks), "b")
    now = cut(now.join(nodes.select(F.col("n").alias("id"), F.xxhash64("id").alias("h")), "id"), "partition")
    able = F.col("gain") > F.col("own_gain") + 1e-9
    chosen = lambda r, parts: able & (F.pmod(F.xxhash64("h", F.lit(r)), F.lit(parts)) == 0)
    parts, kept = 2, None
    for r in range(rounds):
        best = cut(_best_moves(lying, int(tasks), now, total, resolution), "moves")
        count = lambda df: df.agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("tot")).alias("squares"), F.count_if(able).alias("able"), F.count_if(chosen(r, parts)).alias("n1"), F.count_if(chosen(r, 2 * parts)).alias("n2")).first()  # noqa: B023,E731
        sums, slow = count(best), False
        quality = sums.inside / total - resolution * (sums.squares / total**2)
        if kept is not None and quality < kept[0] + tolerance:
            slow = True
            if quality < kept[0]:
                quality, best = kept
                sums = count(best)
            parts *= 2
        if parts > finest or not sums.able:
            return _by_least(best, nodes)
        kept = quality, best
        move = chosen(r, parts) if (sums.n2 if slow else sums.n1) else able
        now = best.select("id", F.when(move, F.col("to")).otherwise(F.col("community")).alias("community"), "k", "h")
    raise RuntimeError(f"the moves haven't settled in {rounds} rounds")


#: Links that a task of a round of moves takes.
ROWS = 250_000


def _best_moves(lying: DataFrame, tasks: int, now: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, community, k, h, to, gain, own_gain, inside, tot): the community that each node of ``now`` (id, community, k, h)
    gains most in, with the gain there and where it is, its weight to its own community and that one's strength.
    ``lying`` (a, b, weight), in ``tasks`` buckets of b, has a row of weight 0 from each node to itself."""
    strong = now.join(now.groupBy("community").agg(F.sum("k").alias("tot")), "community").withColumnRenamed("id", "b")
    own = F.col("a") == F.col("b")
    sent = lying.join(strong.repartition(tasks, "b").hint("shuffle_hash"), "b").select("a", "community", "tot", "weight", F.when(own, F.col("k")).alias("k"), F.when(own, F.col("h")).otherwise(0).alias("h"))
    return sent.repartition(tasks, "a").mapInArrow(local_moves.best_moves(total, resolution), "id long, community long, k double, h long, to long, gain double, own_gain double, inside double, tot double")


def _by_least(member: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Communities named by their smallest member; ``names`` (id, n): the ids of members that are numbers."""
    least = member.groupBy("community").agg(F.min("id").alias("least"))
    named = member.join(least, "community").select("id", F.col("least").alias("community"))
    if names is None:
        return named
    name = lambda c: names.select(F.col("n").alias(c), F.col("id").alias(f"{c}_name"))
    return named.join(name("id"), "id").join(name("community"), "community").select(F.col("id_name").alias("id"), F.col("community_name").alias("community"))


def refinement(weights: DataFrame, member: DataFrame, rounds: int = 400, resolution: float = 1.0, total: float | None = None) -> DataFrame:
    """(id, community, part, round, rank): the merges that refine communities; a node that joined another's part has
    the round and the rank in it, and ``part`` is the node that it began with.

    Inside a community every node begins alone. A node that is still alone, and well connected to the rest of the
    community, joins the part in which it gains most, if that one is well connected too; *well connected* means a weight
    to the rest of the community of at least resolution * strength * (strength of the rest) / (all strength). In a
    round, nodes with a hash of one kind join nodes of the other or parts already joined, and so do those of the other
    kind that none has chosen, so none moves into one that moves. The nodes that choose the same part are taken in order of gain, as long as both conditions hold with those
    before them in it: running sums over the order, with the weights among them, give the same as one merge after another.
    """
    eps = 1e-12
    links = cut(_both(weights), "links")
    strength = cut(links.groupBy("a").agg(F.sum(F.col("weight") * F.when(F.col("a") == F.col("b"), 2).otherwise(1)).alias("k")), "strength")
    m2 = total or strength.agg(F.sum("k")).first()[0] or 1.0
    known = member.join(strength, member["id"] == strength["a"], "left").select("id", "community", F.coalesce("k", F.lit(0.0)).alias("k"))
    whole = known.groupBy("community").agg(F.sum("k").alias("total"))
    now = cut(known.join(whole, "community").select("id", "community", "k", "total", F.col("id").alias("part"), F.lit(None).cast("int").alias("round"), F.lit(None).cast("int").alias("rank")), "parts")
    of = lambda c, name: member.select(F.col("id").alias(c), F.col("community").alias(name))
    inner = cut(links.where("a <> b").join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca = cb").select("a", "b", "weight"), "inside")
    loose = lambda ext, tot, total: F.col(ext) + eps < resolution * F.col(tot) * (F.col(total) - F.col(tot)) / m2
    for r in range(rounds):
        to = inner.join(now.select(F.col("id").alias("b"), F.col("part").alias("into")), "b").repartition("a").groupBy("a", "into").agg(F.sum("weight").alias("w"))
        to = to.join(now.select(F.col("id").alias("a"), "part", "k", "total"), "a").where("part <> into")
        sums = now.groupBy("part").agg(F.sum("k").alias("tot"), F.count("*").alias("n"), F.first("total").alias("total"))
        groups = sums.join(to.groupBy("part").agg(F.sum("w").alias("ext")), "part", "left").withColumn("ext", F.coalesce("ext", F.lit(0.0)))
        groups = groups.where(~loose("ext", "tot", "total"))
        alone = groups.where("n = 1").select("part", F.col("ext").alias("own"))
        target = groups.select(F.col("part").alias("into"), "tot", "ext", "n")
        met = to.join(alone, "part").join(target, "into").withColumn("gain", F.col("w") - resolution * F.col("k") * F.col("tot") / m2).where(F.col("gain") >= -eps)
        best = met.withColumn("order", F.struct((-F.round("gain", 9)).alias("g"), "into")).groupBy(F.col("a").alias("id")).agg(F.min_by(F.struct("into", "w", "k", "total", "own", "tot", "ext", "n", "gain"), "order").alias("x")).select("id", "x.*")
        best = cut(best, "moves")
        if not best.limit(1).count():
            return now.select("id", "community", "part", "round", "rank")
        side = lambda c: F.pmod(F.xxhash64(F.xxhash64(c), F.lit(r)), F.lit(2))
        asked = best.where((side("id") == 0) & ((F.col("n") > 1) | (side("into") == 1)))
        rest = best.where((side("id") == 1) & (F.col("n") > 1)).join(asked.select(F.col("into").alias("id")), "id", "left_anti")
        asked = asked.unionByName(rest)
        inorder = Window.partitionBy("into").orderBy(F.desc("gain"), "id")
        asked = asked.withColumn("at", F.row_number().over(inorder))  # of what is written, so each use of it agrees
        # weights between a node and those before it in the same part's order
        place = lambda c, p: asked.select(F.col("id").alias(c), F.col("into").alias(f"{p}_into"), F.col("at").alias(f"{p}_at"))
        among = inner.join(place("a", "x"), "a").join(place("b", "y"), "b").where("x_into = y_into and y_at < x_at").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("among"))
        upto = inorder.rowsBetween(Window.unboundedPreceding, -1)
        before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0))
        lined = asked.join(among, "id", "left").withColumn("among", F.coalesce("among", F.lit(0.0))).withColumn("d", F.col("own") - 2 * F.col("w") - 2 * F.col("among"))
        lined = lined.withColumn("joined", before(F.col("k"))).withColumn("t", F.col("tot") + F.col("joined")).withColumn("e", F.col("ext") + before(F.col("d")))
        good = ~loose("e", "t", "total") & (F.col("gain") + F.col("among") - resolution * F.col("k") * F.col("joined") / m2 >= -eps)
        taken = lined.withColumn("bad", F.sum((~good).cast("int")).over(inorder)).where("bad = 0").select("id", "into", F.col("at"))
        now = cut(now.join(taken, "id", "left").select("id", "community", "k", "total", F.coalesce("into", "part").alias("part"), F.when(F.col("into").isNotNull(), r).otherwise(F.col("round")).cast("int").alias("round"), F.coalesce("at", "rank").cast("int").alias("rank")), "parts")
    raise RuntimeError(f"the refinement hasn't settled in {rounds} rounds")


def refine(weights: DataFrame, member: DataFrame, resolution: float = 1.0, total: float | None = None) -> DataFrame:
    """(id, community): communities cut into well connected parts (``refinement``), each named by its smallest id."""
    return _by_least(refinement(weights, member, resolution=resolution, total=total).select("id", F.col("part").alias("community")))


#: A group of up to so many weights is worked in one task, and a task is dealt groups of so many together.
FITS, DEAL = 1_000_000, 20_000


def components(weights: DataFrame) -> DataFrame:
    """(id, grp): the nodes of ``weights`` (a, b) by the smallest that each is linked to."""
    reached = connected_components(weights.select("a", "b"))
    nodes = weights.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return nodes.join(reached, nodes["id"] == reached["node"], "left").select("id", F.coalesce("root", "id").alias("grp"))


def leiden(weights: DataFrame, levels: int = 64, resolution: float = 1.0, start: DataFrame | None = None, groups: DataFrame | None = None, fits: int = FITS, **moves) -> DataFrame:
    """(id, community): local moves, refinement into well connected parts, and the same on the graph of those parts, in
    which each community of the moves starts together, until a level joins nothing more.

    No move joins nodes that no weights link, so each component goes through its levels by itself. Those of up to ``fits``
    weights do in tasks, many at once (``local_moves``), larger ones together by tables (``_levels``); both take the same
    moves. ``groups`` (id, grp): sets of nodes without weights between them, if they are known.
    """
    own = cut(weights.select("a", "b", "weight"), "level")
    groups = cut((components(own) if groups is None else groups).select("id", F.col("grp").cast("string").alias("grp")), "groups")
    dealt = cut(own.join(groups, own["a"] == groups["id"]).select("a", "b", "weight", "grp"), "dealt")
    sizes = cut(dealt.groupBy("grp").agg(F.count("*").alias("links"), F.sum("weight").alias("weight")), "sizes")
    all_of = sizes.agg(F.sum("links").alias("links"), (2 * F.sum("weight")).alias("total"), F.max("links").alias("most")).first()
    known = groups.select("id", "grp")
    if start is not None:
        known = known.join(start.select("id", F.col("community").cast("string").alias("start")), "id", "left")
    known = known.select("id", "grp", F.xxhash64(F.xxhash64("id")).alias("h"), F.coalesce("start", "id").alias("start") if start is not None else F.col("id").alias("start"))
    if not all_of.total:
        return known.select("id", F.col("id").alias("community"))
    bins = all_of.links // DEAL + 1
    of = lambda df: df.join(sizes.where(F.col("links") <= fits).select("grp"), "grp").withColumn("bin", F.pmod(F.xxhash64("grp"), F.lit(bins))).repartition(int(bins), "bin").groupBy("bin")
    found = of(dealt).cogroup(of(known)).applyInArrow(local_moves.in_tasks(all_of.total, levels=levels, resolution=resolution, **moves), "id string, community string")
    if all_of.most <= fits:
        return found
    large = cut(dealt.join(sizes.where(F.col("links") > fits).select("grp"), "grp").select("a", "b", "weight"), "level")
    begun = known.select("id", F.concat_ws("\x00", "grp", "start").alias("community")) if start is not None else None  # a community of several groups is one in each
    return found.unionByName(_levels(large, all_of.total, levels, resolution, begun, **moves))


def _levels(own: DataFrame, total: float, levels: int, resolution: float, start: DataFrame | None, **moves) -> DataFrame:
    """``leiden`` of the written ``own`` (a, b, weight), whose components are too large for a task. Level by level a table of
    (node, part) and the aggregated weights are written; the graph shrinks with each."""
    nodes = cut(_both(own).select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("part")), "level")
    for _ in range(levels):
        moved = partition(own, resolution=resolution, start=start, total=total, **moves)
        parts = cut(refine(own, moved, resolution, total), "level")
        found = parts.join(moved.withColumnRenamed("community", "of"), "id")  # (id, community: its part, of)
        before, after = parts.count(), parts.select("community").distinct().count()
        nodes = cut(nodes.join(found.select(F.col("id").alias("part"), F.col("community").alias("next"), "of"), "part").select("id", F.col("next").alias("part"), "of"), "level")
        if after == before:
            return _by_least(nodes.select("id", F.col("of").alias("community")))
        of = lambda c, name: parts.select(F.col("id").alias(c), F.col("community").alias(name))
        own = cut(own.join(of("a", "pa"), "a").join(of("b", "pb"), "b").groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.sum("weight").alias("weight")), "level")
        start = found.select(F.col("community").alias("id"), F.col("of").alias("community")).distinct()
        nodes = nodes.drop("of")
    raise RuntimeError(f"more than {levels} levels")


#: A community is cut again if it is larger than this and this share of all nodes, or so large and so loosely linked.
SPLIT_SIZE, SPLIT_SHARE, LOOSE_SIZE, LOOSE = 10, 0.25, 50, 0.05


def split(weights: DataFrame, edges: DataFrame, member: DataFrame, **moves) -> DataFrame:
    """(id, community): what is too large, then what is too loosely linked (by ``edges``), partitioned once more by
    itself; one that stays whole is kept."""
    n = member.count()
    for rule in ("large", "loose"):
        if rule == "large":
            chosen = member.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") > max(SPLIT_SIZE, int(n * SPLIT_SHARE)))
        else:
            chosen = cohesion(edges, member).where((F.col("size") >= LOOSE_SIZE) & (F.col("cohesion") < LOOSE))
        chosen = cut(chosen.select("community"), "split")
        if not chosen.limit(1).count():
            continue
        within = cut(member.join(chosen, "community", "left_semi"), "split")
        of = lambda c, name: within.select(F.col("id").alias(c), F.col("community").alias(name))
        inside = weights.join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca = cb").select("a", "b", "weight")
        parts = leiden(inside, groups=within.select("id", F.col("community").alias("grp")), **moves)  # chosen communities have no weights between them
        again = within.join(parts.withColumnRenamed("community", "part"), "id", "left").select("id", F.coalesce("part", F.col("id")).alias("community"))
        member = cut(member.join(chosen, "community", "left_anti").select("id", "community").unionByName(again), "split")
    return _by_least(member)


def settle(weights: DataFrame, edges: DataFrame, before: DataFrame | None = None, passes: int = 32, **moves) -> DataFrame:
    """(id, community) that another pass, starting from it, gives again: partitions and splits until a result comes
    back. If states alternate, the one that agrees most with where the passes began (``before``, or the first result)
    is kept; of equals the earliest. ``RuntimeError`` if ``passes`` don't bring one back."""
    weights = cut(weights.select("a", "b", "weight"), "settled")
    groups, edges = cut(components(weights), "settled"), cut(edges.select("src", "dst"), "settled")
    once = lambda start: cut(split(weights, edges, cut(leiden(weights, start=start, groups=groups, **moves), "settled"), **moves), "settled")
    mark = lambda m: m.agg(F.count("*"), F.sum(F.xxhash64("id", "community").cast("decimal(38,0)"))).first()
    states = [once(before)]
    marks = [mark(states[0])]
    reference = before if before is not None else states[0]
    for _ in range(passes):
        new = once(states[-1])
        m = mark(new)
        if m == marks[-1]:
            return states[-1]
        if m in marks:
            cycle = states[marks.index(m) :]
            agree = [overlap(s, reference).groupBy("old").agg(F.max("shared").alias("s")).agg(F.sum("s")).first()[0] or 0 for s in cycle]
            return cycle[agree.index(max(agree))]
        states.append(new)
        marks.append(m)
    raise RuntimeError(f"no state came back in {passes} passes")


def by_size(member: DataFrame) -> DataFrame:
    """(id, community) with communities numbered from 0: largest first, of equals the one with the smallest member."""
    from .traverse import _numbered

    sizes = member.groupBy("community").agg(F.struct((-F.count("*")).alias("size"), F.min("id").alias("least")).alias("order"))
    return member.join(_numbered(sizes, 0).select("community", "rank"), "community").select("id", F.col("rank").alias("community"))


def remap(member: DataFrame, before: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, community): the new communities (numbers) under the ids of the earlier ones that they share most members
    with; each earlier id goes once, to the largest overlap first (of equals the smallest old, then new); the others
    take the lowest free numbers.

    A pair that is the best for both its sides is what taking pairs in order would take, so each round takes all such
    pairs at once.
    """
    left = cut(overlap(before, member), "overlaps")
    order = F.struct(-F.col("shared"), F.col("old"), F.col("new"))
    taken = cut(left.limit(0).select("old", "new"), "taken")
    for _ in range(rounds):
        best = left.groupBy("old").agg(F.min_by("new", order).alias("new")).join(left.groupBy("new").agg(F.min_by("old", order).alias("old")), ["old", "new"])
        best = cut(best.select("old", "new"), "taken")
        if not best.limit(1).count():
            break
        taken = cut(taken.unionByName(best), "taken")
        left = cut(left.join(best.select("old"), "old", "left_anti").join(best.select("new"), "new", "left_anti"), "overlaps")
    else:
        raise RuntimeError(f"ids aren't matched in {rounds} rounds")
    rest = member.select(F.col("community").alias("new")).distinct().join(taken, "new", "left_anti")
    n = taken.count() + rest.count()
    free = member.sparkSession.range(n).select(F.col("id").alias("number")).join(taken.select(F.col("old").cast("long").alias("number")), "number", "left_anti")
    place = lambda df, column: df.withColumn("order", F.struct(F.col(column).alias("v")))
    from .traverse import _numbered

    given = _numbered(place(rest, "new"), 0).select("new", "rank").join(_numbered(place(free, "number"), 0).select("number", "rank"), "rank").select(F.col("number").alias("old"), "new")
    ids = taken.select(F.col("old").cast("long").alias("old"), "new").unionByName(given)
    return member.join(ids, member["community"] == ids["new"]).select("id", F.col("old").alias("community"))


def surviving_labels(labels: DataFrame, before: DataFrame, member: DataFrame) -> DataFrame:
    """The rows of ``labels`` (community, name) that still name their community: its members are the same, or those it
    shares with the earlier one of this id are more than half of both."""
    old, new = before.groupBy("community").agg(F.count("*").alias("o")), member.groupBy("community").agg(F.count("*").alias("n"))
    shared = overlap(before, member).where("old = new").select(F.col("old").alias("community"), "shared")
    fits = shared.join(old, "community").join(new, "community").where("(shared = o and shared = n) or (2 * shared > o and 2 * shared > n)")
    return labels.join(fits.select("community"), "community", "left_semi")


def placeholder_names(member: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, name): the saved name, else ``Community N``."""
    own = member.select("community").distinct().join(labels.select("community", "name"), "community", "left")
    return own.select("community", F.coalesce("name", F.concat(F.lit("Community "), F.col("community").cast("string"))).alias("name"))


def wiki(nodes: DataFrame, edges: DataFrame, member: DataFrame, community, boundary: int = 50) -> DataFrame:
    """(part, src, dst, relation): a community's page: its members, the edges inside, and the first ``boundary`` edges
    that cross its border, in graph order."""
    own = member.where(F.col("community") == community).select("id")
    there = nodes.join(own, "id", "left_semi").select(F.lit("member").alias("part"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("relation"))
    flag = lambda c: own.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_in"))
    met = edges.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").where("src_in or dst_in")
    inside = met.where("src_in and dst_in").select(F.lit("internal").alias("part"), "src", "dst", "relation")
    across = met.where("src_in is null or dst_in is null").orderBy("pos", "src", "dst", "relation").limit(boundary).select(F.lit("boundary").alias("part"), "src", "dst", "relation")
    return there.unionByName(inside).unionByName(across)


def modularity(weights: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition (id, community)."""
    of = lambda c: member.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))
    met = weights.join(of("a"), "a", "left").join(of("b"), "b", "left")
    sums = cut(met.groupBy("ca", "cb", (F.col("a") == F.col("b")).alias("loop")).agg(F.sum("weight").alias("weight")), "sums")  # the weights are met once
    m2 = sums.agg((2 * F.sum("weight")).alias("m2"))
    inside = sums.agg((2 * F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight"))), F.lit(0.0))).alias("inside"))
    ends = sums.select(F.col("ca").alias("community"), "weight").unionByName(sums.where(~F.col("loop")).select(F.col("cb").alias("community"), "weight"))
    tot = ends.where("community is not null").groupBy("community").agg(F.sum("weight").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("squares"))
    return m2.crossJoin(inside).crossJoin(tot).select((F.col("inside") / F.col("m2") - resolution * F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))  # one row each


def cohesion(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(community, size, cohesion): linked pairs of a community over all its pairs; 1 for a single node."""
    sizes = member.groupBy("community").agg(F.count("*").alias("size"))
    pairs = edges.where("src <> dst").join(member.select(F.col("id").alias("src"), "community"), "src").join(member.select(F.col("id").alias("dst"), F.col("community").alias("c2")), "dst").where("community = c2")
    linked = pairs.select("community", F.least("src", "dst"), F.greatest("src", "dst")).distinct().groupBy("community").agg(F.count("*").alias("linked"))
    return sizes.join(linked, "community", "left").select("community", "size", F.when(F.col("size") < 2, 1.0).otherwise(F.coalesce("linked", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2)).alias("cohesion"))


def external_votes(edges: DataFrame, member: DataFrame, external: DataFrame) -> DataFrame:
    """(id, community) of external nodes (id): that of most of their neighbours; of equals the smallest."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionAll(edges.select(F.col("dst").alias("id"), F.col("src").alias("n")))
    votes = both.join(external.select("id"), "id", "left_semi").join(member.select(F.col("id").alias("n"), "community"), "n").groupBy("id", "community").agg(F.count("*").alias("v"))
    return votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("v"), F.col("community"))).alias("community"))


def overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new, shared): members that communities of two partitions share; the basis of stable ids."""
    met = before.select("id", F.col("community").alias("old")).join(after.select("id", F.col("community").alias("new")), "id")
    return met.groupBy("old", "new").agg(F.count("*").alias("shared"))


#: A directory that more than this share of a community's files lie in stands before its name.
NAME_SHARE = 0.6


def names(nodes: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """(community, name): its member with the most edges that isn't external, of equals the smallest id, without
    leading dots and ``()``; after the directory that most of its files share."""
    from .degree import degrees

    external = F.coalesce("external", F.lit(False)) if "external" in nodes.columns else F.lit(False)
    file = F.coalesce("file", F.lit(""))
    met = member.join(nodes.select("id", "label", external.alias("external"), file.alias("file")), "id").join(degrees(edges.where("src <> dst")), "id", "left").fillna(0, ["degree"])
    label = F.regexp_replace(F.regexp_replace(F.trim("label"), r"^[.]+", ""), r"\(\)$", "")
    label = F.when(F.coalesce(label, F.lit("")) == "", F.col("id")).otherwise(label)
    best = met.groupBy("community").agg(F.min_by(label, F.struct("external", -F.col("degree"), F.col("id"))).alias("label"), F.count("*").alias("n"), F.count_if(F.col("file") != "").alias("placed"))
    dirs = met.where("file <> ''").groupBy("community", dirname(F.col("file")).alias("dir")).agg(F.count("*").alias("k")).groupBy("community").agg(F.min_by(F.struct("dir", "k"), F.struct(-F.col("k"), F.col("dir"))).alias("d"))
    own = best.join(dirs, "community", "left")
    shared = (F.col("n") > 1) & (F.col("d.dir") != "") & (F.col("d.k") > NAME_SHARE * F.col("placed"))
    return own.select("community", F.when(shared, F.concat_ws(": ", "d.dir", "label")).otherwise(F.col("label")).alias("name"))
