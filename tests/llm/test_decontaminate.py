import re

from lattica.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def expected(rows, items, size=13):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(map(str, out))


def read(df):
    return sorted(str((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]))) for r in df.collect())


ITEMS = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 20), (5, "a b c d"), (6, "ONE, two! three?"), (7, "never seen here"), (11, "d A b")]


def test_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert read(d.contamination(odd_docs, items)) == expected(rows, ITEMS)
    assert read(d.contamination(odd_docs, items, limit=5)) == expected(rows, ITEMS)  # several blocks
    assert read(d.contamination(odd_docs, items, window=2)) == expected(rows, ITEMS, 2)
    assert d.contamination(no_docs, items).count() == 0
    assert read(d.contamination(odd_docs, items.where("false"))) == expected(rows, [])
    assert d.drop_contaminated(odd_docs, items).columns == odd_docs.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha gap beta y"), (2, "alpha beta"), (3, "beta alpha"), (4, "alpha a b c d beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    near = {r.doc_id: (r.n_hit, r.n_near) for r in d.contamination(docs, items, slop=2).collect()}
    assert near[1] == (0, 1) and near[2] == (2, 0) and near[4] == (0, 0) and near[3][0] == 0


def test_one_index_serves_several_test_sets(spark, real_docs):
    """The written index holds every term's postings; test sets that come later need no text."""
    import random

    index = d.written(d.build_index(real_docs), "index")
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    random.seed(2)
    for size, limit in ((13, 10**6), (4, 50)):
        texts = [" ".join(words(t)[k : k + random.randrange(1, 30)]) for _, t in random.sample(rows, 12) for k in (3, 40) if t]
        items = list(enumerate(texts))
        found = d.hits(index, spark.createDataFrame(items, "item_id long, text string"), size, limit=limit)
        assert read(found) == expected(rows, items, size)


def test_segments_hold_all_postings():
    import pyarrow as pa

    texts = ["b a, A c", "", "\x1c a-\u00e9 B\x00b", " ", "x" * 70000 + " a"]
    n_words, terms, ends, docs, positions = d.segment(pa.array([t.encode() for t in texts], pa.binary()).slice(0))
    want = {}
    for i, t in enumerate(texts):
        for k, w in enumerate(words(t)):
            want.setdefault(w, []).append((i, k))
    begins = [0, *ends[:-1]]
    got = {t: list(zip(docs[a:b].tolist(), positions[a:b].tolist())) for t, a, b in zip(terms.to_pylist(), begins, ends)}
    assert got == want and terms.to_pylist() == sorted(want) and n_words.tolist() == [len(words(t)) for t in texts]
    part = pa.array([t.encode() for t in texts], pa.binary()).slice(2, 2)
    assert d.segment(part)[0].tolist() == [len(words(t)) for t in texts[2:4]]


def test_a_full_block_is_small():
    """What a worker holds of a block of 200,000 words of test items is arrays of some tens of megabytes."""
    import pickle
    import random

    random.seed(1)
    own = [(str(k), [b"w%d" % random.randrange(150_000) for _ in range(1000)]) for k in range(200)]
    windows = d.Windows(own, 13)
    windows.rank(d.np.zeros(len(windows.vocabulary), d.np.int64))
    assert len(windows.terms) > 190_000 and len(pickle.dumps(windows)) < 20e6


def test_packed_lists_round_trip():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 4000):
        ends = np.sort(rng.choice(np.arange(1, n + 1), min(n, 1 + n // 7), replace=False)).astype(np.int32)
        if n:
            ends[-1] = n
        ends = np.unique(ends)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else np.empty(0, np.int64)
        docs, positions = rng.integers(0, 1000, n).astype(np.int32), rng.integers(0, 2**31 - 1, n).astype(np.int32)
        got = d.lists_of(d.packed(ends, begins[:1]), d.packed(docs, begins), d.packed(positions, d._anew(begins, docs)))
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, (ends, docs, positions)))
