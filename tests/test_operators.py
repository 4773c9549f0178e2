"""Operators on hand-made graphs, and those that SQL can't express against brute force."""

import json
import math
import random

import pytest

from pyspark.sql import functions as F

from lattica.operators import communities, cycles, review, scope, search, spans, traverse
from lattica.sources import graph_json, python_code
from lattica.streaming import watch


def edges_of(spark, pairs, relation="calls"):
    return spark.createDataFrame([(k, a, b, relation, "EXTRACTED") for k, (a, b) in enumerate(pairs)], "pos long, src string, dst string, relation string, confidence string")


def test_hop_records_follow_queue_and_edge_order(spark):
    random.seed(3)
    pairs = [(f"n{random.randrange(40)}", f"n{random.randrange(40)}") for _ in range(90)]
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    want, queue = {"n0": (0, None)}, ["n0"]
    for a in queue:
        for b in out.get(a, []):
            if b not in want and want[a][0] < 4:
                want[b] = (want[a][0] + 1, a)
                queue.append(b)
    got = traverse.hop_records(edges_of(spark, pairs), spark.createDataFrame([("n0", 0)], "id string, rank long"), 4)
    rows = got.orderBy("rank").collect()
    assert {r.id: (r.distance, r.via) for r in rows} == want and [r.id for r in rows] == queue
    assert [r.id for r in traverse.shortest_path(edges_of(spark, pairs), "n0", queue[-1], 4).orderBy("step").collect()][-1] == queue[-1]
    assert traverse.shortest_path(edges_of(spark, pairs), "n0", "nowhere", 4).count() == 0


def test_strong_components_on_random_graphs(spark):
    random.seed(5)
    pairs = [(f"n{random.randrange(60)}", f"n{random.randrange(60)}") for _ in range(85)] + [("n1", "n1")]
    reach = {}
    for s in {x for p in pairs for x in p}:
        seen, todo = set(), [s]
        while todo:
            for a, b in pairs:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        reach[s] = seen
    want = {}
    for a in reach:
        group = {b for b in reach[a] if a in reach.get(b, ())} | {a}
        if len(group) > 1:
            want[a] = min(group)
    got = cycles.strong_components(edges_of(spark, pairs))
    assert {r.id: r.component for r in got.collect()} == want
    first = min(want.values())
    path = [r.id for r in cycles.cycle_path(edges_of(spark, pairs), got.where(F.col("component") == first), first).orderBy("step").collect()]
    assert path[0] == path[-1] == first and len(path) > 2 and all(p in pairs for p in zip(path, path[1:]))
    assert cycles.strong_components(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "c")])).count() == 0


def test_import_tiers(spark):
    rows = [("a", "b", "module-level"), ("b", "a", "module-level"), ("c", "d", "module-level"), ("d", "c", "deferred"), ("e", "f", "module-level"), ("f", "e", "type-checking")]
    got = cycles.tiered_cycles(spark.createDataFrame(rows, "src string, dst string, runs string")).collect()
    assert {(r.tier, r.component, r.size) for r in got} == {("module-level", "a", 2), ("deferred", "c", 2), ("type-checking", "e", 2)}


def test_greedy_pick_equals_one_pass(spark):
    random.seed(7)
    rows = sorted({(f"s{random.randrange(30)}", f"d{random.randrange(12)}", f"f{random.randrange(9)}", f"g{random.randrange(5)}", random.randrange(8)) for _ in range(400)})
    for per_target, limit in ((2, 20), (1, 5), (3, 9)):
        kept, pairs, targets = [], set(), {}
        for r in sorted(rows, key=lambda r: (-r[4], r[0], r[1], r[2], r[3])):
            pair = tuple(sorted(r[2:4]))
            if len(kept) < limit and pair not in pairs and targets.get(r[1], 0) < per_target:
                kept.append(r)
                pairs.add(pair)
                targets[r[1]] = targets.get(r[1], 0) + 1
        unique = {(r[0], r[1]): r for r in rows}
        frame = spark.createDataFrame(list(unique.values()), "src string, dst string, src_file string, dst_file string, score int")
        kept, pairs, targets = [], set(), {}
        for r in sorted(unique.values(), key=lambda r: (-r[4], r[0], r[1])):
            pair = tuple(sorted(r[2:4]))
            if len(kept) < limit and pair not in pairs and targets.get(r[1], 0) < per_target:
                kept.append(r)
                pairs.add(pair)
                targets[r[1]] = targets.get(r[1], 0) + 1
        assert sorted(tuple(r) for r in review.diverse(frame, per_target, limit).collect()) == sorted(kept)


def test_bulk_commits_say_nothing(spark):
    rows = [(f"c{k}", f) for k in range(5) for f in ("a", "b")] + [("bulk", f"x{k}") for k in range(31)] + [("bulk", "a"), ("bulk", "b")]
    got = review.co_change(spark.createDataFrame(rows, "commit string, file string")).collect()
    assert [tuple(r) for r in got] == [("a", "b", 5, 1.0)]


def test_layers(spark):
    rows = [("src/app/a", "src/lib/b"), ("src/app/api/x", "src/app/y"), ("src/app/api/x", "other/z"), ("src/lib/b", "src/app/a"), ("free/q", "src/app/a")]
    frame = spark.createDataFrame(rows, "src_file string, dst_file string")
    rules = {"src/app": ["*"], "src/app/api": ["src/lib"], "src/lib": []}
    assert {(r.from_layer, r.to_layer) for r in review.layer_violations(frame, rules).collect()} == {("src/app/api", "src/app"), ("src/lib", "src/app")}
    assert review.layer_violations(frame, rules, strict=True).count() == 3


def test_scope_words_and_dangling_ends(spark):
    s = scope.parse_scope("+vendored, -tests src/** !src/gen/ all")
    assert s.include == ["src"] and s.exclude == ["src/gen"] and s.tests and s.vendored and s.external
    nodes = spark.createDataFrame([(0, "a", "src/a.py"), (1, "t", "tests/test_a.py"), (2, "v", "vendor/v.js")], "pos long, id string, file string")
    view = scope.scoped(nodes, edges_of(spark, [("a", "t"), ("a", "v"), ("a", "ghost"), ("ghost", "ghost2")]), "-tests")
    assert sorted((r.src, r.dst) for r in view.edges.collect()) == [("a", "ghost"), ("ghost", "ghost2")]
    assert {r.reason: r.n for r in view.left_out().collect()} == {"tests": 1, "vendored": 1}


def test_router_prefixes(spark):
    routers = spark.createDataFrame([("app", "/"), ("api", "/v1"), ("users", ""), ("x", "/x"), ("y", "/y")], "router string, own string")
    mounts = spark.createDataFrame([("app", "api", "/api"), ("api", "users", "/users"), ("app", "users", "/people"), ("x", "y", ""), ("y", "x", "")], "parent string, child string, prefix string")
    got = sorted((r.router, r.prefix) for r in traverse.compose_prefixes(routers, mounts).collect())
    assert ("users", "/api/v1/users") in got and ("users", "/people") in got and ("api", "/api/v1") in got and ("x", "/x") in got and ("y", "/y") in got


def test_route_patterns(spark):
    row = spark.createDataFrame([("/u/{id}/:name/<int:k>/",)], "p string").select(spans.normalize_pattern(F.col("p")).alias("p"), spans.request_path(F.lit("http://localhost:80/a/${x}?q=1")).alias("r")).first()
    assert row.p == "/u/{}/{}/{}" and (row.r.kind, row.r.path) == ("path", "/a/{}")


def test_identifier_terms(spark):
    words = [("getUserName",), ("get_user_name",), ("GetUserName",), ("HTTPServer2 parsing 42",), (None,)]
    got = [r.t for r in spark.createDataFrame(words, "w string").select(search.code_terms(F.col("w")).alias("t")).collect()]
    assert got[0] == got[1] == got[2] == ["getusername", "get", "user", "nam"] and got[4] == []
    assert "42" not in got[3] and "pars" in got[3] and "http" in got[3]


def test_related_by_cosine(spark):
    random.seed(2)
    texts = {k: [random.choice("abcdefghij") * 2 for _ in range(12)] for k in range(30)}
    chunks = spark.createDataFrame([(k, "", "", " ".join(w)) for k, w in texts.items()], "cid long, name string, path string, body string")
    got = {r.cid: r.score for r in search.related(search.index(chunks, search.plain_terms)[0], 0, top=30).collect()}
    df = {w: sum(w in t for t in texts.values()) for t in texts.values() for w in t}
    vec = {k: {w: (1 + math.log(t.count(w))) * math.log(1 + (30 - df[w] + 0.5) / (df[w] + 0.5)) for w in t} for k, t in texts.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vec.items()}
    for k, score in got.items():
        assert abs(score - sum(x * vec[0].get(w, 0) for w, x in vec[k].items()) / norm[k] / norm[0]) < 1e-9


def test_two_cliques_are_two_communities(spark):
    pairs = [(f"{s}{i}", f"{s}{j}") for s in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    weights = spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs], "a string, b string, weight double")
    member = communities.partition(weights)
    assert {r.id: r.community for r in member.collect()} == {f"{s}{i}": f"{s}0" for s in "ab" for i in range(5)}
    assert communities.modularity(weights, member).first().modularity > 0.4


def test_tolerant_graph(spark, tmp_path):
    doc = {"vertices": [{"id": 0, "name": "zero", "source_location": "L12-L30", "cluster": 4}, {"name": "b", "path": "x/b.py", "line": 3, "external": True}, {}], "links": [{"source": 0, "to": "b", "type": "imports"}, {"from": "b", "dst": 0, "confidence": "INFERRED"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = graph_json.read_graph(spark, str(tmp_path / "g.json"))
    assert [(r.id, r.label, r.file, r.line, r.community, r.external) for r in nodes.orderBy("pos").collect()] == [("0", "zero", "", 12, 4, False), ("b", "b", "x/b.py", 3, None, True), ("?", "?", "", None, None, False)]
    assert [(r.src, r.dst, r.relation, r.confidence) for r in edges.orderBy("pos").collect()] == [("0", "b", "imports", None), ("b", "0", "->", "INFERRED")]
    (tmp_path / "bad.json").write_text("[1, 2")
    assert graph_json.read_graph(spark, str(tmp_path / "bad.json"))[0].count() == 0
    assert graph_json.read_rules('{"layers": {"./src/": ["lib/"], "n": 3}}') == {"src": ["lib"]}


def test_python_facts(spark):
    text = "import os\nfrom .a import b as c\n\n@dec\nclass A:\n    def m(self):\n        return os.getcwd()\n\ndef f():\n    def g(): c()\n    return g\n"
    got = python_code.python_facts(spark.createDataFrame([("x.py", text), ("bad.py", "def ("), ("none.py", None)], "file string, text string")).collect()
    defs = {(r.kind, r.qualname, r.region_start, r.def_line) for r in got if r.kind in ("class", "method", "function")}
    assert defs == {("class", "A", 4, 5), ("method", "A.m", 6, 6), ("function", "f", 9, 9), ("function", "f.g", 10, 10)}
    assert {(r.qualname, r.name) for r in got if r.kind == "import"} == {("os", "os"), (".a:b", "c")}
    assert [r.file for r in got if r.kind == "error"] == ["bad.py"] and {r.name for r in got if r.kind == "call"} == {"getcwd", "c"}


def test_bursts_on_a_stream_equal_a_batch(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "k", "a"), ("2024-01-01 00:00:01", "k", "b"), ("2024-01-01 00:00:10", "k", "a"), ("2024-01-01 00:00:10", "z", "c")]
    batch = spark.createDataFrame(rows, "ts string, k string, i string").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = watch.bursts(stream, F.col("k"), F.col("i")).writeStream.outputMode("complete").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    pick = lambda df: sorted((r.key, r.n, tuple(r["items"])) for r in df.collect())
    assert pick(spark.table("bursts")) == pick(watch.bursts(batch, F.col("k"), F.col("i"))) == [("k", 1, ("a",)), ("k", 2, ("a", "b")), ("z", 1, ("c",))]


def weights_of(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in pairs], "a string, b string, weight double")


def clique(names):
    return [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]


def test_leiden_finds_a_ring_of_cliques(spark):
    """Eight cliques in a ring: one community for each, all connected, and no less modular than brute force finds."""
    groups = [[f"c{g}n{k}" for k in range(5)] for g in range(8)]
    pairs = [p for g in groups for p in clique(g)] + [(groups[g][0], groups[(g + 1) % 8][1]) for g in range(8)]
    w = weights_of(spark, pairs)
    member = communities.leiden(w)
    got = {}
    for r in member.collect():
        got.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
    kept = communities.settle(w, edges_of(spark, pairs))
    assert {(r.id, r.community) for r in kept.collect()} == {(r.id, r.community) for r in member.collect()}
    assert {r.id for r in communities.by_size(kept).where("community = 0").collect()} == set(groups[0])


def test_refine_cuts_what_isnt_connected(spark):
    chain = [(f"a{k:02d}", f"a{k + 1:02d}") for k in range(30)]
    w = weights_of(spark, chain + [("x", "y"), ("y", "a00")])
    member = spark.createDataFrame([(f"a{k:02d}", "one") for k in range(31)] + [("x", "one"), ("y", "two")], "id string, community string")
    got = {r.id: r.community for r in communities.refine(w, member).collect()}
    assert got["x"] == "x" and got["y"] == "y"
    places = {}
    for k in range(31):
        places.setdefault(got[f"a{k:02d}"], []).append(k)
    assert len(places) < 20 and all(own == list(range(own[0], own[-1] + 1)) for own in places.values())  # stretches of the chain


def test_split_cuts_large_communities_once_more(spark):
    groups = [[f"c{g}n{k}" for k in range(6)] for g in range(3)]
    pairs = [p for g in groups for p in clique(g)] + [("c0n0", "c1n0"), ("c1n1", "c2n0")]
    all_in_one = spark.createDataFrame([(n, "c0n0") for g in groups for n in g], "id string, community string")
    got = {}
    for r in communities.split(weights_of(spark, pairs), edges_of(spark, pairs), all_in_one).collect():
        got.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_remap_is_greedy_by_overlap(spark):
    random.seed(9)
    old = {f"n{k}": random.randrange(12) for k in range(300)}
    new = {n: (c if random.random() < 0.6 else random.randrange(15)) for n, c in old.items() if random.random() < 0.95} | {f"m{k}": 20 for k in range(5)}
    shared = {}
    for n, c in new.items():
        if n in old:
            shared[old[n], c] = shared.get((old[n], c), 0) + 1
    ids, used = {}, set()
    for (o, c), _ in sorted(shared.items(), key=lambda x: (-x[1], x[0])):
        if c not in ids and o not in used:
            ids[c] = o
            used.add(o)
    free = (k for k in range(100) if k not in used)
    for c in sorted(set(new.values())):
        if c not in ids:
            ids[c] = next(free)
    frame = lambda m: spark.createDataFrame(list(m.items()), "id string, community long")
    assert {r.id: r.community for r in communities.remap(frame(new), frame(old)).collect()} == {n: ids[c] for n, c in new.items()}


def test_relation_weights_by_hand(spark):
    """Fixed weights: what joins what, how surely, and where both lie."""
    nodes = spark.createDataFrame([("f", "m.py", "src/a/m.py"), ("g", "g()", "src/a/g.py"), ("h", "h()", "lib/h.py"), ("t", "t()", "tests/t.py"), ("i", "i()", "src/a/m.py")], "id string, label string, file string").withColumn("external", F.lit(False))
    rows = [("i", "f", "contains", None, 1.0), ("g", "i", "inherits", None, 1.5 * 1.25), ("g", "f", "imports", None, 0.7 * 1.25), ("h", "i", "imports_from", "EXTRACTED", 0.4 * 0.6), ("h", "g", "calls", "INFERRED", 0.5 * 0.6), ("t", "h", "extends", None, 0.5 * 0.6 * 0.1), ("i", "i", "calls", None, 0.0)]
    edges = spark.createDataFrame([(k, a, b, r, c) for k, (a, b, r, c, _) in enumerate(rows)], "pos long, src string, dst string, relation string, confidence string")
    got = {(r.a, r.b): round(r.weight, 9) for r in communities.edge_weights(nodes, edges).collect()}
    assert got == {tuple(sorted((a, b))): round(w, 9) for a, b, _, _, w in rows if a != b}


def test_stems_and_vendored_names(spark):
    want = {"retries": "retry", "retried": "retry", "classes": "class", "parses": "pars", "parsed": "pars", "parse": "pars", "bus": "bus", "this": "this", "class": "class", "users": "user", "names": "nam", "running": "runn", "ring": "ring", "red": "red", "used": "used", "ease": "eas", "dies": "die", "ied": "ied"}
    frame = spark.createDataFrame([(w,) for w in want], "w string").select("w", search.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in frame.collect()} == want
    from lattica.functions.paths import is_minified, is_test_path, is_vendored

    paths = {"_vendor/x.py": 1, "lib/site-packages/a.py": 1, "external/a.py": 0, "a/decorate-BgofJUJ5.js": 1, "main.3f2a1b9c.js": 1, "main.12345678.js": 0, "my-component.js": 0, "a.min.css": 1, "vendored/z": 1}
    assert {r.p: r.v for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", is_vendored(F.col("p")).alias("v")).collect()} == {p: bool(v) for p, v in paths.items()}
    tests = {"a/jvmTest/x.kt": 1, "Foo.Tests.Xml/a.cs": 1, "src/OwnerControllerTests.java": 1, "src/TypeSpec.java": 0, "x_tests.py": 1, "conftest.py": 1, "src/contest.py": 0, "e2e/a.ts": 1, "a.spec.ts": 1}
    assert {r.p: r.v for r in spark.createDataFrame([(p,) for p in tests], "p string").select("p", is_test_path(F.col("p")).alias("v")).collect()} == {p: bool(v) for p, v in tests.items()}
    long = spark.createDataFrame([("a.js", "x" * 400), ("a.js", "x\n" * 400), ("a.py", "x" * 400), ("a.css", None)], "p string, t string").select(is_minified(F.col("p"), F.col("t")).alias("m"))
    assert [r.m for r in long.collect()] == [True, False, False, False]


def test_scope_flags(spark):
    assert scope.parse_scope("+Minified -TEST +externals src/** !docs/").__dict__ == {"include": ["src"], "exclude": ["docs"], "tests": False, "external": True, "vendored": True}
    with pytest.raises(ValueError, match="tset"):
        scope.parse_scope("-tset")
    assert "dispatches_to" in scope.relations("calls") and "references" not in scope.relations("types") and "http_calls" in scope.relations("code")


def test_dangling_meets_each_end_once(spark):
    """Ends without a node, null ends, repeated edges and nodes."""
    from lattica.operators import degree

    nodes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([(1, "a", "b"), (2, "x", "b"), (3, "a", "y"), (4, "x", "y"), (5, "x", "y"), (6, None, "a"), (7, "c", None)], "pos long, src string, dst string")
    found = degree.dangling(nodes, edges)
    assert sorted(r.pos for r in found.collect()) == [2, 3, 4, 5, 6, 7]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_modularity_meets_the_weights_once(spark):
    """Loops and strangers to the partition count in all weights."""
    from lattica.operators import communities

    weights = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("c", "c", 3.0), ("c", "z", 4.0)], "a string, b string, weight double")
    member = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, community int")
    got = communities.modularity(weights, member)
    # all weights 10; inside 5; community 1: 2 + 2 + 1, community 2: 1 + 3 + 4
    assert abs(got.first().modularity - (10 / 20 - (5**2 + 8**2) / 20**2)) < 1e-12
    assert "LogicalRDD" not in got._jdf.queryExecution().optimizedPlan().toString()  # the written sums are read, not the weights met again


def test_index_shuffles_chunks_not_postings(spark):
    """Chunks that lie in one partition are dealt by cid before they are split; their terms aren't shuffled."""
    chunks = spark.createDataFrame([(k % 30, "some name", "a/path", f"word{chr(97 + k % 7)} word word") for k in range(40)], "cid long, name string, path string, body string").coalesce(1)
    postings, lengths = search.index(chunks, search.plain_terms)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(cid" in plan
    got = {(r.term, r.cid): (r.tf_name, r.tf_path, r.tf_body) for r in postings.collect()}
    assert got["word", 0] == (0, 0, 4) and got["word", 29] == (0, 0, 2) and got["name", 3] == (2, 0, 0)  # ten ids come twice
    assert got["a", 12] == (0, 1, 0) and lengths.count() == 40


def test_surprises_judge_a_node_once(spark):
    """What a score asks of one node only lies below the joins, not in the step that reads every edge."""
    nodes = spark.createDataFrame([("a", "f", "x/a.py", 1), ("b", "g", "y/b.js", 2)], "id string, label string, file string, community long")
    found = review.surprises(nodes, edges_of(spark, [("a", "b"), ("a", "b"), ("b", "b")]), 60)
    assert [(r.src, r.dst, r.score) for r in found.collect()] == [("a", "b", 6)]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert r"\.([^./]+)$" not in above and "label" not in above


def test_diverse_surprises_meet_nodes_once_for_each_end(spark):
    """The files come along with the score: the same rows as when they are looked up again, with fewer joins."""
    from lattica.queries import QUERIES
    from lattica.sources.tables import graph_view

    nodes, edges = graph_view(spark, "/root/testdata/sf0.001")
    file = lambda end: nodes.select(F.col("id").alias(end), F.col("file").alias(f"{end}_file"))
    again = review.surprises(nodes, edges, 60).join(file("src"), "src").join(file("dst"), "dst").select("src", "dst", "src_file", "dst_file", "score")
    found = QUERIES["diverse_surprises"](spark, "/root/testdata/sf0.001")
    assert found.count() and sorted(map(tuple, found.collect())) == sorted(map(tuple, review.diverse(again).collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
