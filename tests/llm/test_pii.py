import hashlib
import re

from lattica.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if valid(k, m.group())]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


TRICKY = [
    "a@b.c@d.e x@y z@w.v. a@b@c.d _@q.r..s %+-@-.- a@b.c_x@y.z",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 1.2.3.4. 0000255.1.1.1 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112222 4111111111111111-4111111111111111 4222222222222",
    "+49 (30) 123-456.78 +1 +1 2 +123456789 +1234567890123456 ++49 301234567) +(49) 30 + 49",
    "é@b.c \U0001f600 a@b.c \U0001f600\U0001f600 1.2.3.4 +49 30 1234567 4111111111111111",
    "1" * 60000,
    "a" * 60000 + "@",
    "." .join(["1"] * 20001),
    "+" + "1 " * 20000,
    "1-" * 30000,
]


def test_base_spans(spark, real_docs, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100 + r.doc_id, r.text) for r in real_docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame, own in ((docs, rows), (odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()])):
        got = pii.personal_data(frame).collect()
        assert len(got) == len(own)
        want = sorted(str((i, listed(base(t)))) for i, t in own)
        assert sorted(str((r.doc_id, listed([(pii.KINDS[x.kind], x.s, x.e) for x in r.base]))) for r in got) == want
        texts = dict(own)
        for r in got:
            assert all((texts[r.doc_id] or "")[x.s : x.e] == x.m for x in r.base)
    assert pii.personal_data(no_docs).count() == 0


def test_query(spark, real_docs):
    want = {r.doc_id: base(r.text) for r in real_docs.collect()}
    for r in pii.op7_pii(spark, "/root/testdata/sf0.001").collect():
        own = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed(own).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in own) for k in pii.KINDS]
        assert set(listed(own).split(",")) <= set(r.spans.split(","))


def test_bootstrapped_instances(spark):
    """Seeds behind ``phone:`` make the pattern; a number that no base pattern accepts is found by it."""
    rows = [(k, f"call phone: +49 30 12345{k:02d} today") for k in range(12)] + [(50, "please call phone: 0301234599 today"), (51, "item no 0309876543 sold"), (52, "call phone: 0301234599 tomorrow")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[x.kind], x.m) for x in r.added] for r in pii.personal_data(docs).collect() if r.added}
    assert got == {50: [("phone", "0301234599")], 52: [("phone", "0301234599")]}


def test_many_unseen_and_patterns_of_discovered(spark):
    """Few seeds and more unseen numbers; those found activate ``fon:``; odd instances keep ``ref:`` quiet."""
    rows = [(k, f"call phone: +49 30 12345{k:02d} today") for k in range(6)]
    rows += [(100 + k, f"call phone: 03012345{k:02d} today") for k in range(20)] + [(200 + k, f"my fon: 03012345{k:02d} ok") for k in range(8)]
    rows += [(300, "my fon: 0307777777 ok")]
    rows += [(400 + k, f"see ref: +49 40 12345{k:02d} x{k}") for k in range(5)] + [(500 + k, f"see ref: AB-{k}234-XY y{k}") for k in range(20)] + [(600, "see ref: 0408888888 z")]
    got = {r.doc_id: [(pii.KINDS[x.kind], x.m) for x in r.added] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.added}
    want = {100 + k: [("phone", f"03012345{k:02d}")] for k in range(20)} | {200 + k: [("phone", f"03012345{k:02d}")] for k in range(8)} | {300: [("phone", "0307777777")]}
    assert got == want


def patterns(left, right, m):
    left, right = left.lower(), right.lower()
    ws = left.split()
    own = [("l", ws[-1])] if ws else []
    if len(ws) > 1:
        own.append(("ll", " ".join(ws[-2:])))
    after = re.match(r"\S*\s+(\S+)", right)
    if after:
        own.append(("r", after[1]))
    key = re.match("([A-Za-z_]+[=:])", m)
    if key:
        own.append(("k", key[1].lower()))
    mask = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", m))
    if ws and len(mask) <= pii.CONTEXT:
        own.append(("s", ws[-1] + " " + mask))
    return own


def fits(kind, m):
    bare = re.sub("^[A-Za-z_]+[=:]", "", m)
    shaped = re.search(pii.SHAPES[kind], bare) is not None
    return shaped and (kind != "card" or luhn(re.sub("[^0-9]", "", bare)))


def discovered(rows, least=5, share=0.9, rounds=3):
    """The scored graph by plain loops."""
    edges, seeds, based = {}, {}, set()
    for kind, m, left, right in rows:
        if kind >= 0:
            seeds[m] = max(kind, seeds.get(m, -1))
            based.add(m)
        elif re.search(pii.SECRETS, m):
            seeds[m] = max(pii.SECRET, seeds.get(m, -1))
        for p in patterns(left, right, m):
            edges.setdefault(p, {}).setdefault(m, set()).add(kind >= 0)
    edges = {p: own for p, own in edges.items() if len(own) >= least}
    known, reached = dict(seeds), {}
    for _ in range(rounds):
        reached = {}
        for p, own in edges.items():
            for k, kind in enumerate(pii.ALL_KINDS):
                of = sum(known.get(m) == k for m in own)
                n = sum(m in known or not fits(kind, m) for m in own)
                if of >= least and of / (n + 0.5) >= share:
                    for m, kinds in own.items():
                        if False in kinds and True not in kinds and fits(kind, m):
                            reached[m] = max(reached.get(m, (0, 0)), (of / (n + 0.5), k))
        known = dict(seeds) | {m: k for m, (_, k) in reached.items() if m not in seeds}
    return {m: (k, round(s, 9)) for m, (s, k) in reached.items()}


def test_scored_graph_equals_loops(spark):
    """On the generated documents and a made-up mix of contexts."""
    import random

    random.seed(11)
    rows, words = [], ["call", "fax:", "at", "token", "=", "ref", "id", "card"]
    for k in range(400):
        value = random.choice([f"+49 30 {random.randrange(10**7, 10**8)}", f"030{random.randrange(10**6)}", "%040x" % random.getrandbits(160), "%030X" % random.getrandbits(120), f"u{k}@host{k}.example", f"u{k % 9}@host", f"4111-1111.{k % 7}111-1111", f"10.0.0.{k % 256}", f"10.0.{k % 50}"])
        first = "token =" if re.fullmatch("[0-9a-fA-F]{30,}", value) and random.random() < 0.9 else "fax:" if value[:1] in "+0" and random.random() < 0.9 else random.choice(words)
        rows.append((k, f"{random.choice(words)} {first} {value} {random.choice(words)} x"))
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), real):
        spans = pii.placed(pii.hits(docs)).persist()
        got = {r.m: (r.kind, round(r.score, 9)) for r in pii.discover(spans).collect()}
        want = discovered([(r.kind, r.m, r.left, r.right) for r in spans.collect()])
        assert got == want and got
        spans.unpersist()


def test_unseen_secrets_of_the_documents(spark):
    """Credentials reached through the context that those in a strict format share, and nothing else."""
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer('(?i)token = "([0-9a-f]{40})"', t)}
    got = set()
    for r in pii.op7_pii(spark, path).collect():
        added = [x.split(":") for x in r.spans.split(",") if x.startswith("secret:")]
        assert len(added) == r.n_added
        got |= {(r.doc_id, int(a), int(b)) for _, a, b in added}
    assert got == want and got


def test_many_matches_in_one_text(spark):
    """Positions and candidates of a text with thousands of matches; candidates never overlap base spans."""
    text = " ".join(f"n{k}1234567 a{k}@b.example é 10.0.0.{k % 256}/24 +49 30 {1000000 + k}" for k in range(4000))
    rows = pii.placed(pii.hits(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert all(text[r.s : r.e] == r.m for r in rows)
    base_ = sorted((r.s, r.e) for r in rows if r.kind >= 0)
    assert len(base_) == 12000 and [(k, a, b) for k, a, b in base(text)] == sorted(((pii.KINDS[r.kind], r.s, r.e) for r in rows if r.kind >= 0), key=lambda x: (pii.KINDS.index(x[0]), x[1]))
    assert sum(r.kind < 0 for r in rows) == 4000
