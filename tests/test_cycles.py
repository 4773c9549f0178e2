"""Cycles: how much is read and looked for again."""

import random

from pyspark.sql import functions as F

from lattica.operators import cycles


def test_the_edges_of_a_loop_are_made_once(spark):
    n = 9
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(x):
        made.add(1)
        return x

    name = lambda i: f"n{i % n}"
    rows = [(i, name(i), name(i + 1)) for i in range(n)] + [(n, "n0", "n5")]
    plain = spark.createDataFrame(rows, "pos long, src string, dst string").withColumn("relation", F.lit("imports"))
    edges = plain.withColumn("src", same.asNondeterministic()("src"))
    ids = spark.createDataFrame([(name(i),) for i in range(n)], "id string")
    got = [tuple(r) for r in cycles.cycle_path(edges, ids, "n0").orderBy("step").collect()]
    assert got == list(enumerate(["n0", "n5", "n6", "n7", "n8", "n0"]))
    assert made.value <= 2 * len(rows)  # each hop of two walks made them anew


def test_a_tier_begins_with_the_groups_of_the_last(spark, monkeypatch):
    r = random.Random(5)
    rows = [(f"v{r.randrange(25):02d}", f"v{r.randrange(25):02d}", r.choice(cycles.RUNS)) for _ in range(70)]
    df = spark.createDataFrame(rows, "src string, dst string, runs string")
    own, given = cycles.strong_components, []

    def counted(edges, *args):
        given.append(edges.where("src <> dst").distinct().count())
        return own(edges, *args)

    monkeypatch.setattr(cycles, "strong_components", counted)
    got = {(t.tier, t.component, t.size) for t in cycles.tiered_cycles(df).collect()}
    want, seen, whole = set(), set(), []
    for k, tier in enumerate(cycles.RUNS):
        pairs = {(a, b) for a, b, x in rows if cycles.RUNS.index(x) <= k and a != b}
        reach = {a: {a} for p in pairs for a in p}
        for _ in reach:
            for a, b in pairs:
                reach[a] |= reach[b]
        for group in {frozenset(b for b in reach[a] if a in reach[b]) for a in reach}:
            if len(group) > 1 and group not in seen:
                seen.add(group)
                want.add((tier, min(group), len(group)))
        whole.append(len(pairs))
    assert got == want and len(want) > 1
    assert given[-1] < whole[-1] / 2
