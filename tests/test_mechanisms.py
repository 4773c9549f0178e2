"""Mechanisms that take more than a join: components by labels, refinement, refreshed indexes, similarity joins, budgets."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lattica.operators import communities, cycles

SF = "/root/testdata/sf0.001"


def counted(monkeypatch, module):
    calls, own = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, name="step": calls.append(name) or own(df, name))
    return calls


def test_components_of_a_long_ring_take_few_jobs(spark, monkeypatch):
    n = 10_000
    ring = spark.range(n).select(F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", (F.col("id") + 1) % n).alias("dst"))
    calls = counted(monkeypatch, cycles)
    got = cycles.strong_components(ring).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [("n00000", n)]
    assert len(calls) < 120  # tables written; a step of the ring each would be 20,000


def test_refinement_merges_only_well_connected_parts(spark):
    """Replays the merges one by one and tests both conditions before each."""
    r = random.Random(3)
    pairs = defaultdict(float)
    for c in range(4):
        for _ in range(60):
            a, b = r.sample(range(c * 15, c * 15 + 15), 2)
            pairs[min(a, b), max(a, b)] += r.choice([0.5, 1.0, 1.5])
    for _ in range(25):
        a, b = sorted(r.sample(range(60), 2))
        pairs[a, b] += 0.5
    pairs[5, 5] = 2.0
    name = lambda i: f"v{i:02d}"
    weights = spark.createDataFrame([(name(a), name(b), w) for (a, b), w in pairs.items()], "a string, b string, weight double")
    member = spark.createDataFrame([(name(i), "left" if i < 30 else "right") for i in range(60)], "id string, community string")
    merges = communities.refinement(weights, member).collect()
    of = {m.id: m.community for m in merges}
    near, k = defaultdict(dict), defaultdict(float)
    for (a, b), w in pairs.items():
        a, b = name(a), name(b)
        k[a] += w
        k[b] += w
        if a != b:
            near[a][b] = near[b][a] = w
    m2, parts = sum(k.values()), {i: {i} for i in of}
    total = lambda part: sum(k[v] for v in of if of[v] == of[next(iter(part))])
    tight = lambda part: sum(w for v in part for u, w in near[v].items() if u not in part and of[u] == of[v]) + 1e-9 >= sum(k[v] for v in part) * (total(part) - sum(k[v] for v in part)) / m2
    done = sorted((m for m in merges if m.round is not None), key=lambda m: (m.round, m.part, m.rank))
    assert len(done) > 20
    for m in done:
        into = parts[m.part]
        assert parts[m.id] == {m.id} and tight({m.id}) and tight(into) and of[m.id] == of[m.part]
        gain = sum(near[m.id].get(u, 0) for u in into) - k[m.id] * sum(k[u] for u in into) / m2
        assert gain >= -1e-9
        into.add(m.id)
        parts[m.id] = into
    # nothing more can merge
    for v in of:
        if parts[v] == {v} and tight({v}):
            for into in {id(p): p for u, p in parts.items() if of[u] == of[v] and v not in p}.values():
                w = sum(near[v].get(u, 0) for u in into)
                assert not w or not tight(into) or w - k[v] * sum(k[u] for u in into) / m2 < 1e-9


def test_refinement_parts_cliques_of_one_community(spark):
    """Connected, but badly: a bridge between two cliques doesn't keep them together."""
    own = lambda x: [(f"{x}{i}", f"{x}{j}", 1.0) for i in range(5) for j in range(i + 1, 5)]
    weights = spark.createDataFrame([*own("p"), *own("q"), ("p0", "q0", 1.0), *own("r"), *own("s")], "a string, b string, weight double")
    member = spark.createDataFrame([(f"{x}{i}", "all" if x in "pq" else x) for x in "pqrs" for i in range(5)], "id string, community string")
    got = communities.refine(weights, member).collect()
    for part in {r.community for r in got}:
        assert len({r.id[0] for r in got if r.community == part}) == 1


def _cosines(vectors, floor):
    out = {}
    unit = {i: {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()} for i, v in vectors.items()}
    for x in unit:
        for y in unit:
            if x < y:
                s = sum(w * unit[y].get(t, 0) for t, w in unit[x].items())
                if s >= floor:
                    out[x, y] = round(s, 6)
    return out


@pytest.mark.parametrize("floor,block", [(0.3, 2048), (0.8, 3)])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, floor, block):
    """Common terms, rare terms, copies; lists longer than a block are met block by block."""
    from lattica.operators import simjoin

    monkeypatch.setattr(simjoin, "BLOCK", block)
    r = random.Random(7)
    vectors = {i: {f"t{min(int(r.expovariate(0.15)), 39)}": r.choice([0.5, 1.0, 2.0]) for _ in range(r.randint(1, 12))} for i in range(120)}
    vectors |= {200 + i: dict(vectors[3]) for i in range(15)}
    rows = [(i, t, w) for i, v in vectors.items() for t, w in v.items()]
    got = simjoin.similar_pairs(spark.createDataFrame(rows, "cid long, term string, w double"), floor).collect()
    assert len(got) == len({(g.x, g.y) for g in got})
    assert {(g.x, g.y): round(g.score, 6) for g in got} == _cosines(vectors, floor)
    assert simjoin.similar_pairs(spark.createDataFrame([], "cid long, term string, w double"), floor).count() == 0


def test_pairs_that_share_one_rare_term_are_not_met_whole(spark, monkeypatch):
    """Each vector shares a rare term with the next, and its common ones with few: their bands or cells rule them out."""
    from lattica.operators import simjoin

    r = random.Random(11)
    vectors = {i: {f"r{i}": 1.0, f"r{(i + 1) % 60}": 1.0, f"own{i}": 0.5} | {f"c{r.randrange(40)}": 0.6 for _ in range(6)} for i in range(60)}
    vectors |= {100 + i: vectors[i] | {"more": 0.05} for i in range(3)}
    rows = [(i, t, w) for i, v in vectors.items() for t, w in v.items()]
    written, own = [], simjoin.cut
    monkeypatch.setattr(simjoin, "cut", lambda df, name="step": (lambda d: written.append((name, d.count())) or d)(own(df, name)))
    got = simjoin.similar_pairs(spark.createDataFrame(rows, "cid long, term string, w double"), 0.8).collect()
    assert {(g.x, g.y): round(g.score, 6) for g in got} == _cosines(vectors, 0.8)
    assert len(got) == 3
    assert [n for name, n in written if name == "pairs"][0] < 20  # 63 meet by a rare term


def test_similar_documents_with_ids_of_several_rows_equal_sql(spark, tmp_path):
    """Rows of one id are one document; texts without terms are none."""
    import duckdb

    from lattica import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("doc_id", F.when(F.col("doc_id") % 7 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id")))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 11 == 3, F.lit("12 !")).otherwise(F.col("text")))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().execute(queries.ORACLE_SQL["similar_documents"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = queries.QUERIES["similar_documents"](spark, str(tmp_path)).select("doc_id", "class", "links").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_index_refreshed_in_batches_equals_a_fresh_one(spark):
    from lattica.operators import search, segments

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("cid"), F.col("source").alias("name"), F.col("lang").alias("path"), F.col("text").alias("body")).where("cid < 90").cache()
    index = segments.SegmentedIndex(search.plain_terms, fan=2)
    for k in range(4):  # some come first with another text, and change in a later batch
        early = docs.where(F.col("cid") % 4 == k).withColumn("body", F.when(F.col("cid") % 3 == 0, F.lit("other the words")).otherwise(F.col("body")))
        again = docs.where((F.col("cid") % 4 == k - 1) & (F.col("cid") % 3 == 0))
        index.refresh(early.unionByName(again), docs.where((F.col("cid") % 4 == k - 2) & (F.col("cid") % 5 == 0)).select("cid"))
    assert len(index.segments) <= 3
    final = docs.where("not (cid % 4 < 2 and cid % 5 = 0) and not (cid % 4 = 3 and cid % 3 = 0)").unionByName(docs.where("cid % 4 = 3 and cid % 3 = 0").withColumn("body", F.lit("other the words")))
    fresh = search.index(final, search.plain_terms)
    tidy = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert tidy(index.postings()) == tidy(fresh[0]) and tidy(index.lengths()) == tidy(fresh[1])
    got, want = (sorted((x.cid, round(x.score, 9), x.matched) for x in df.collect()) for df in (index.scores(["the", "a", "other"]), search.bm25f(*fresh, ["the", "a", "other"])))
    assert got == want


def test_running_sums_by_ranges(spark):
    from lattica.operators import traverse

    rows = [(k % 7, f"x{k:03d}", (k * 37) % 11) for k in range(500)]
    got = traverse.running_sum(spark.createDataFrame(rows, "a int, b string, c int"), F.col("c"), F.desc("a"), F.col("b")).collect()
    total = 0
    for n, (g, w) in enumerate(zip(sorted(got, key=lambda g: g.n), sorted(rows, key=lambda r: (-r[0], r[1])), strict=True), 1):
        total += w[2]
        assert (g.n, tuple(g.whole), g.own, g.sum) == (n, w, w[2], total)


def test_poll_sees_files_that_are_written_anew(spark, tmp_path):
    import os

    from lattica.streaming import watch

    root, state = tmp_path / "src", f"file://{tmp_path}/state"
    root.mkdir()
    seen = lambda: {(r.file.rsplit("/", 1)[1], r.change) for r in watch.poll(spark, f"file://{root}", state).collect()}
    (root / "a.py").write_text("one")
    (root / "b.py").write_text("two")
    assert seen() == {("a.py", "new"), ("b.py", "new")} and seen() == set()
    (root / "a.py").write_text("ONE")
    os.utime(root / "a.py", (2_000_000_000, 2_000_000_000))
    (root / "b.py").unlink()
    (root / "c.py").write_text("three")
    assert seen() == {("a.py", "changed"), ("b.py", "removed"), ("c.py", "new")} and seen() == set()


def test_did_you_mean_equals_difflib(spark):
    from difflib import SequenceMatcher

    from lattica.code_queries import QUERIES

    names = {r.r_name for r in spark.read.parquet(f"{SF}/region.parquet").collect()}
    got = [str(r) for r in QUERIES["did_you_mean"](spark, SF).collect()]
    best = max(names, key=lambda n: SequenceMatcher(None, n.lower(), "amerca").ratio())
    assert best == "AMERICA" and got and best in got[0]


def _forest(pairs):
    below, ids = defaultdict(list), sorted({x for p in pairs for x in p})
    parent = {c: p for p, c in pairs}
    for p, c in pairs:
        below[p].append(c)
    out, stack = {}, [(i, 0) for i in reversed(ids) if i not in parent]
    while stack:
        v, d = stack.pop()
        out[v] = [parent.get(v), d, len(out), 1]
        stack += [(c, d + 1) for c in sorted(below[v], reverse=True)]
    for v in sorted(out, key=lambda v: -out[v][2]):
        if out[v][0] is not None:
            out[out[v][0]][3] += out[v][3]
    return {v: tuple(x) for v, x in out.items()}


def test_labels_of_a_forest_equal_a_walk(spark, monkeypatch):
    """A chain of 300, a node with 300 children, random trees; tables written grow with the logarithm."""
    from lattica.operators import hierarchy

    r = random.Random(5)
    pairs = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(300)] + [("hub", f"h{k}") for k in range(300)] + [(f"t{r.randrange(max(0, k - 30), k)}", f"t{k}") for k in range(1, 200)]
    calls = counted(monkeypatch, hierarchy)
    edges = spark.createDataFrame([*pairs, *pairs[:5], (None, "x"), ("y", None)], "src string, dst string")
    got = hierarchy.labels(edges).cache()
    assert {x.id: (x.parent, x.depth, x.pre, x.size) for x in got.collect()} == _forest(pairs)
    assert len(calls) < 20
    want = _forest(pairs)
    monkeypatch.setattr(hierarchy, "BLOCK", 16)
    tops = ["c000", "c290", "hub", "t3", "h1", "none"]
    met = {tuple(x) for x in hierarchy.below(got, spark.createDataFrame([(t,) for t in tops + tops[:1]], "id string")).collect()}
    assert met == {(t, v, want[v][1] - want[t][1]) for t in tops if t in want for v in want if want[t][2] < want[v][2] < want[t][2] + want[t][3]}


def test_labels_of_what_is_no_forest(spark):
    from lattica.operators import hierarchy

    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    for rows in ([("a", "c"), ("b", "c")], [("a", "a")], [("r", "s"), ("a", "b"), ("b", "c"), ("c", "a")]):
        with pytest.raises(ValueError):
            hierarchy.labels(frame(rows))
    assert hierarchy.labels(frame([])).count() == 0


@pytest.mark.parametrize("cutoff,block", [(0.9, 2048), (0.7, 7), (0.45, 2048), (1.0, 2048)])
def test_similar_names_equal_all_pairs(spark, monkeypatch, cutoff, block):
    from difflib import SequenceMatcher

    from lattica.operators import names

    monkeypatch.setattr(names, "BLOCK", block)
    r = random.Random(11)
    made = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 14))) for _ in range(40)]
    for x in made[:25]:
        k = r.randrange(len(x) + 1)
        made += [x[:k] + r.choice(["", "z", x[:1]]) + x[k + 1 :], x + x, x[::-1]]
    made += ["", "a" * 250, "a" * 240 + "b", "ab", "ba"]
    left, right = set(made[: len(made) * 2 // 3] + made[-5:]), set(made[len(made) // 3 :])
    frame = lambda xs: spark.createDataFrame([(x, 1) for x in xs] + [(None, 2)] + [(x, 3) for x in list(xs)[:9]], "name string, left int")
    ratio = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    want = {(a, b): ratio(a, b) for a in left for b in right if ratio(a, b) >= cutoff}
    got = names.similar_names(frame(left), frame(right), cutoff).collect()
    assert len(got) == len(want) and {(g.a, g.b): g.ratio for g in got} == want


def test_similar_client_names_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    from lattica.queries import QUERIES

    own = sorted({x.name for x in spark.read.parquet(f"{SF}/clients.parquet").collect() if x.name is not None})
    want = set()
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            m = SequenceMatcher(None, a, b, autojunk=False)
            if m.real_quick_ratio() >= 0.9 and m.quick_ratio() >= 0.9 and m.ratio() >= 0.9:
                want.add((a, b, round(m.ratio(), 9)))
    assert want and {(g.a, g.b, g.ratio) for g in QUERIES["similar_client_names"](spark, SF).collect()} == want


def _nearest_by_hand(vectors, queries, k):
    import numpy as np

    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = np.round(x @ x[np.searchsorted(ids, q)], 9)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("block,lists", [(16, 8), (512, 1), (3, 40)])
def test_nearest_equals_brute_force(spark, monkeypatch, block, lists):
    """Clusters, a third of all vectors equal, ties, and rows that are no vectors; blocks far from a query aren't met."""
    import numpy as np

    from lattica.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "QUERIES", 4)
    r = np.random.default_rng(5)
    base = r.normal(size=(8, 6)) * 10
    vectors = {i: (base[i % 8] + r.normal(size=6)).tolist() for i in range(400)} | {1000 + i: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] for i in range(200)}
    bad = [(None, [1.0] * 6), (2001, None), (2002, [1.0] * 5), (2003, [0.0] * 6), (2004, [1.0] * 5 + [None]), (2005, [1.0] * 5 + [float("nan")]), (2006, [float("inf")] * 6), (2007, [])]
    rows = spark.createDataFrame([*vectors.items(), *bad, (5, vectors[5])], "id long, embedding array<double>").repartition(5)
    asked = rows.where("id % 10 = 0 or id > 2000")
    index = nearest.build(rows, 6, lists)
    assert index.blocks.agg(F.sum("n")).first()[0] == len(vectors)
    got = defaultdict(list)
    for g in nearest.nearest(index, asked, 6, 5).orderBy("query", "rank").collect():
        got[g.query].append((g.id, g.score))
    want = _nearest_by_hand(vectors, [i for i in vectors if i % 10 == 0], 5)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)


def test_nearest_leaves_far_blocks_out(spark):
    import numpy as np

    from lattica.operators import nearest

    r = np.random.default_rng(1)
    base = r.normal(size=(40, 64))
    rows = spark.createDataFrame([(i, (base[i % 40] + r.normal(size=64) * 0.05).tolist()) for i in range(4000)], "id long, embedding array<double>")
    index = nearest.build(rows, 64, 40)
    ready, left, _ = nearest.plan(index, rows.where("id % 50 = 0"), 64, 10)
    pairs = ready.count() * index.blocks.count()
    assert left.count() < pairs / 4
    few = nearest.build(rows.where("id < 3"), 64)
    assert [(g.query, g.id) for g in nearest.nearest(few, rows.where("id = 1"), 64).orderBy("rank").collect()] in ([(1, 0), (1, 2)], [(1, 2), (1, 0)])
    none = rows.limit(0)
    assert nearest.nearest(nearest.build(none, 64), rows, 64).count() == 0 and nearest.nearest(few, none, 64).count() == 0


def test_rounds_of_communities_write_little(spark, monkeypatch):
    """A round of moves writes one table, a round of the refinement two."""
    clique = lambda g: [(f"c{g}n{i}", f"c{g}n{j}", 1.0) for i in range(5) for j in range(i)]
    weights = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in clique(0) + clique(1) + clique(2)] + [("c0n0", "c1n1", 0.5), ("c1n0", "c2n1", 0.5), ("c2n0", "c2n0", 1.0)], "a string, b string, weight double")
    calls = counted(monkeypatch, communities)
    member = communities.partition(weights)
    assert {(r.id[:2], r.community) for r in member.collect()} == {(f"c{g}", f"c{g}n0") for g in range(3)}
    assert calls.count("moves") > 3 and len(calls) <= calls.count("moves") + 4
    calls.clear()
    assert communities.refinement(weights, member).where("part <> id").count() == 12
    assert calls.count("moves") == calls.count("parts") > 1


def test_vectors_of_near_copies_go_once_to_each_part(spark, monkeypatch):
    """Sixty near copies are 1,770 pairs; their vectors go to a few parts, not once to each pair."""
    from lattica.operators import simjoin

    r = random.Random(12)
    base = {f"t{i}": 1.0 + r.random() for i in range(20)}
    vectors = {i: base | {f"own{i}": 0.3} for i in range(60)} | {100 + i: {f"x{i}": 1.0, f"x{i + 1}": 0.4} for i in range(20)}
    rows = [(i, t, w) for i, v in vectors.items() for t, w in v.items()]
    own = simjoin._products
    monkeypatch.setattr(simjoin, "PART", 16)
    shipped = spark.sparkContext.accumulator(0)

    def counting(floor):
        run = own(floor)

        def counted(pairs, vectors):
            shipped.add(vectors.num_rows)
            return run(pairs, vectors)

        return counted

    monkeypatch.setattr(simjoin, "_products", counting)
    got = simjoin.similar_pairs(spark.createDataFrame(rows, "cid long, term string, w double"), 0.8).collect()
    assert {(g.x, g.y): round(g.score, 6) for g in got} == _cosines(vectors, 0.8) and len(got) >= 1770
    assert 60 <= shipped.value <= 60 * 4 + 20
