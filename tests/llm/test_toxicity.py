import zlib

import numpy as np

from lattica.llm import toxicity


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos) / (len(pos) * len(neg))


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, d).toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all() and (got.predicted == (got.score >= 0.3)).all()
    m = got.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    y, s = m.toxic.values, m.score.values
    assert auc(y, s) > 0.95
    assert m.predicted[y == 1].mean() > 0.85 and m.predicted[y == 0].mean() < 0.02


def test_pairs_weigh_beyond_their_parts():
    """Toxic only if an insult meets a group: no additive weights can tell."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        other = rng.integers(2, 30, 5)
        rows.append(np.unique(np.concatenate([[0] * a, [1] * b, other]).astype(np.int64)))
        labels.append(float(a == b))
    m = toxicity.train(rows, np.array(labels), np.arange(30), epochs=40)
    scores = np.array([m.score(r) for r in rows])
    assert auc(np.array(labels), scores) > 0.95


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (5, 0), (999, 1), (7, 1)], "doc_id long, toxic int")
    for train in (labels, labels.where("false"), labels.where("toxic = 1")):
        got = toxicity.scores(odd_docs, toxicity.learn(odd_docs, train)).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1  # no words: one score
    assert toxicity.scores(no_docs, toxicity.learn(no_docs, labels)).count() == 0
    assert toxicity.drop_toxic(odd_docs, labels).columns == odd_docs.columns


def test_terms_and_scores_by_loops(spark):
    """The terms kept, and the score as a sum over pairs of a document's terms."""
    import math
    import re
    from itertools import combinations

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = toxicity.learn(docs, labels, keep=200)
    of = {}
    for r in docs.collect():
        words = set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.text or "").lower()))
        of[r.doc_id] = {zlib.crc32(b"w" + w.encode()) for w in words} | {zlib.crc32(b"p" + w[:n].encode()) for w in words for n in range(3, 7) if len(w) > n}
    seen = [(of[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    p = (sum(y for _, y in seen) + 0.5) / (len(seen) + 1)
    n, a = {}, {}
    for terms, y in seen:
        for t in terms:
            n[t] = n.get(t, 0) + 1
            a[t] = a.get(t, 0) + y
    z = {t: abs(a[t] - k * p) / math.sqrt(k * p * (1 - p)) for t, k in n.items() if k >= toxicity.LEAST}
    cut = sorted(z.values(), reverse=True)[199]
    assert {t for t in z if z[t] > cut + 1e-9} <= set(m.terms.tolist()) <= {t for t in z if z[t] >= cut - 1e-9} and len(m.terms) == 200
    place = {t: k for k, t in enumerate(m.terms.tolist())}
    for r in toxicity.scores(docs.where("doc_id % 17 = 3"), m).collect():
        own = sorted(place[t] for t in of[r.doc_id] if t in place)
        s = m.bias + sum(m.weights[k] for k in own) + sum(float(m.factors[i] @ m.factors[j]) for i, j in combinations(own, 2))
        assert abs(1 / (1 + math.exp(-max(-30, min(30, s)))) - r.score) < 1e-6


def test_repeated_ids_count_once(spark):
    """Rows and labels of one id many times over are one row to learn from."""
    docs = spark.createDataFrame([(1, "bad word here")] * 50 + [(k, f"fine text {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 30 + [(1, 0)] + [(k, 0) for k in range(2, 40)], "doc_id long, toxic int")
    once = docs.dropDuplicates(["doc_id"]), labels.groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    a, b = toxicity.learn(docs, labels), toxicity.learn(*once)
    assert a.bias == b.bias and a.terms.tolist() == b.terms.tolist()
