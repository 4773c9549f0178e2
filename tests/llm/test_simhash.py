import re

import numpy as np
import pytest
import xxhash

from lattica.llm import simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(data)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(str((i, f"{fps[k]:016x}", least.get(find(k)))) for k, (i, _) in enumerate(rows))


def read(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_real_documents(spark, real_docs):
    assert read(simhash.op4_simhash_golay(spark, "/root/testdata/sf0.001")) == expected([(r.doc_id, r.text) for r in real_docs.collect()])


def test_odd_documents(odd_docs, no_docs):
    assert read(simhash.near_duplicates(odd_docs)) == expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = {i for _, _, i in map(eval, read(simhash.near_duplicates(odd_docs)))}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(ids)


def test_all_pairs_within_three_bits_meet_in_a_key():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    other = base.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    index, key, own = simhash.keys(np.concatenate([base, other]))
    mine, theirs = [set() for _ in range(8000)], [set() for _ in range(8000)]
    for i, k, o in zip(index.tolist(), key.tolist(), own.tolist()):
        (mine if o else theirs)[i].add(k)
    assert all(mine[k] & theirs[k + 4000] for k in range(4000))
    assert all(mine[k + 4000] & theirs[k] for k in range(4000))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(find(k), set()).add(k)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(("few", "many"), [(512, 8192), (3, 7)])
def test_crowded_keys_lose_no_link(spark, monkeypatch, few, many):
    """Many different near copies around a few centres, with keys taken as crowded from few pairs on, and with their
    fingerprints in one block or in many."""
    monkeypatch.setattr(simhash, "CROWDED", 16)
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "MANY", many)
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 2**63, 4).tolist():
        for _ in range(60):
            x = centre
            for bit in rng.integers(0, 63, int(rng.integers(0, 4))).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    from lattica.llm.components import connected_components

    pairs, crowd = simhash.links(frame)
    assert crowd.count()
    least = frame.withColumn("least", frame["fp"])
    rooted = simhash._rooted(least, connected_components(pairs), "test-rooted")
    again = {r.node: r.root for r in connected_components(simhash._across(crowd, rooted)).collect()}
    of = {r.fp: again.get(r.root, r.root) for r in rooted.collect()}
    groups = {}
    for k, f in enumerate(fps):
        groups.setdefault(of.get(f, f), set()).add(k)
    assert sorted(map(sorted, groups.values())) == brute_components(fps)


def test_isolated_pairs_are_linked(spark):
    """Pairs at exactly three bits that share no key with a third fingerprint, many with one bit in each segment."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 1000).tolist()
    want = set()
    for k, x in enumerate(base):
        bits = [int(rng.integers(at, at + n - (at + n == 64))) for at, n in simhash.SEGMENTS] if k % 2 else rng.choice(63, 3, replace=False).tolist()
        y = x ^ sum(1 << b for b in bits)
        want.add((min(x, y), max(x, y)))
    frame = spark.createDataFrame([(f,) for pair in want for f in pair], "fp long")
    pairs, _ = simhash.links(frame)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()} == want
