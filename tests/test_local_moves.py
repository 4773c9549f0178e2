"""Communities of groups that fit a task: the same moves as by tables, and few tables written."""

import random

from pyspark.sql import functions as F

from lattica.operators import communities, local_moves


def test_hash_equals_sparks(spark):
    rows = spark.range(200).select(F.xxhash64(F.col("id").cast("string")).alias("h"), *(F.xxhash64(F.col("id").cast("string"), F.lit(r)).alias(f"r{r}") for r in (0, 1, 77))).toPandas()
    for r in (0, 1, 77):
        assert (local_moves.mixed(rows["h"].to_numpy(), r) == rows[f"r{r}"].to_numpy()).all()


def test_tasks_and_tables_move_alike(spark):
    r = random.Random(5)
    pairs = {(3, 3): 2.0} | {(i, i + 1): 0.5 for i in range(35)}
    for _ in range(90):
        a, b = sorted(r.sample(range(12), 2))
        g = 12 * r.randrange(3)
        pairs[g + a, g + b] = pairs.get((g + a, g + b), 0) + r.choice([0.5, 1.0, 1.5])
    weights = spark.createDataFrame([(f"v{a:02d}", f"v{b:02d}", x) for (a, b), x in pairs.items()], "a string, b string, weight double")
    start = spark.createDataFrame([(f"v{i:02d}", f"s{i % 5}") for i in range(30)], "id string, community string")
    of = lambda df: {x.id: x.community for x in df.collect()}
    tasks = of(communities.leiden(weights, start=start))
    assert len(tasks) == 36 and tasks == of(communities.leiden(weights, start=start, fits=0))


def test_levels_of_many_groups_write_few_tables(spark, monkeypatch):
    """Whatever their rounds: by tables each took one table at least."""
    clique = lambda g: [(f"c{g:02d}n{i}", f"c{g:02d}n{j}", 1.0) for j in range(6) for i in range(j)]
    links = [x for g in range(20) for x in clique(g)] + [(f"c{g:02d}n0", f"c{g + 1:02d}n1", 0.5) for g in range(19) if g % 4 < 3] + [("z", "z", 1.0)]
    weights = spark.createDataFrame(links, "a string, b string, weight double")
    calls, own = [], communities.cut
    monkeypatch.setattr(communities, "cut", lambda df, name="step": calls.append(name) or own(df, name))
    got = {}
    for x in communities.leiden(weights).collect():
        got.setdefault(x.community, set()).add(x.id)
    assert len(calls) <= 4
    assert got == {"z": {"z"}} | {f"c{g:02d}n0": {f"c{g:02d}n{i}" for i in range(6)} for g in range(20)}
    assert communities.leiden(weights.limit(0)).count() == 0


def test_a_round_of_moves_shuffles_links_once(spark, monkeypatch):
    """To the node that moves; communities and strengths go to links where these lie, and strengths only once a node."""
    import contextlib
    import io

    plans, own = [], communities._best_moves

    def seen(*args):
        df = own(*args)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain()
        plans.append(text.getvalue().split("AdaptiveSparkPlan", 1)[1])
        return df

    monkeypatch.setattr(communities, "_best_moves", seen)
    monkeypatch.setattr(communities, "ROWS", 20)
    clique = lambda g: [(f"c{g}n{i}", f"c{g}n{j}", 1.0) for j in range(5) for i in range(j)]
    weights = spark.createDataFrame(clique(0) + clique(1) + [("c0n0", "c1n0", 1.0)], "a string, b string, weight double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {x.id: x.community for x in communities.partition(weights).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {f"c{g}n{i}": f"c{g}n0" for g in range(2) for i in range(5)}
    for plan in plans:
        assert plan.count("Exchange hashpartitioning(a#") == 1 and "SortMergeJoin [b#" not in plan
        wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(wide) <= 5
