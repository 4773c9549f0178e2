import math
import re

from pyspark.sql import functions as F

from lattica.llm import urls

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.COM/en/7x?q=1#f", "x://y://example.com/en/8", "http://example.com?/en/", "http://example.com#/en/", "http://com/en/", "http://notcom/en/", "http://a.com/en", "http://É.com/en/é", "ftp://b.example.net/de/8/9", "http://net/de/\n/x", "http://x.org/es/" + "a" * 5000]


def expected(url):
    u = url or ""
    if "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(FOLD)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_rules_on_real_and_odd_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, 0, 0) for r in pages.collect()] + [(10_000 + k, u, 0, 0) for k, u in enumerate(ODD)] + [(10_000, None, 0, 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host int, suffix int")
    model = urls.train(frame.select("url", urls.rule_label(F.col("url")).alias("label")))
    got = urls.judge(frame, model).collect()
    rates = [{r[0]: r[1] for r in own.collect()} for own in model.rates]
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = expected(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if by_hand(model, r.url, rates) > 0.5 else "allow"))
        assert abs(by_hand(model, r.url, rates) - r.score) < 1e-9
    assert urls.judge(frame.where("false"), model).count() == 0


def entropy(x):
    return round(-sum(x.count(c) / len(x) * math.log2(x.count(c) / len(x)) for c in sorted(set(x))), 6) if x else 0.0


def ratio(x):
    return len(re.findall("[0-9]", x)) / len(x) if x else 0.0


def by_hand(model, url, rates):
    """The score by features and trees in plain Python."""
    host, path, _, _ = expected(url)
    u = url or ""
    query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
    last = re.search(r"([^/]*)/?\Z", path)[1]
    tld, two = host.split(".")[-1], ".".join(host.split(".")[-2:])
    f = {"length": len(u), "host_length": len(host), "path_length": len(path), "query_length": len(query), "depth": sum(x != "" for x in path.split("/")), "digits": ratio(u), "host_digits": ratio(host), "path_digits": ratio(path)}
    f |= {"last_digits": len(re.findall("[0-9]", last)), "entropy": entropy(u), "host_entropy": entropy(host), "parameters": len(re.findall("[?&][^=&#]*=", u)), "hyphens": host.count("-"), "labels": sum(x != "" for x in host.split("."))}
    f |= {"longest_label": max(map(len, host.split("."))), "punctuation": len(re.findall("[^A-Za-z0-9]", u)), "tld_rate": rates[0].get(tld, model.prior), "suffix_rate": rates[1].get(two, model.prior), "segment_rate": rates[2].get(path.split("/")[1] if path[:1] == "/" else "", model.prior), "last_lead": ord(last[0]) if last else 0}
    z = model.base
    for node in model.trees:
        while isinstance(node, tuple):
            node = node[2] if f[node[0]] <= node[1] + 1e-12 else node[3]
        z += node
    return 1 / (1 + math.exp(-z))


def test_trees_on_held_out_hosts(spark):
    """Learned from the labelled URLs of some hosts, the trees rank those of others; by several features, not one."""
    labelled = F.col("label").isNotNull()
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", urls.rule_label(F.col("url")).alias("label"))
    part = F.pmod(F.crc32(urls.host(F.col("url")).cast("binary")), F.lit(4))
    model = urls.train(pages.where(part != 2).select("url", "label"))
    held = pages.where(part == 2)
    scored = urls.judge(held, model).select("page_id", "score").join(held.where(labelled), "page_id").toPandas()
    pos, neg = scored.score[scored.label == 1].values, scored.score[scored.label == 0].values
    auc = sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos) / (len(pos) * len(neg))
    assert auc > 0.9, auc
    assert len(model.used()) >= 6 and scored.score.round(6).nunique() >= 50


def test_labels_decide_what_is_learned(spark):
    """Labels by another property of the URL: the trees follow it on hosts that they haven't seen."""
    rows = [(f"http://h{k}.example.org/" + ("a/" * (k % 5)) + (f"x{k}{k}{k}" if k % 3 else "page") + ("?a=1&b=2" if k % 2 else ""), int(k % 3 > 0)) for k in range(600)]
    model = urls.train(spark.createDataFrame(rows, "url string, label int"))
    got = urls.judge(spark.createDataFrame([(1, "http://other.example.org/a/x777777"), (2, "http://other.example.org/a/page?a=1&b=2")], "page_id long, url string"), model).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow"}


def test_no_labelled_rows(spark):
    none = spark.createDataFrame([("http://a/", None), (None, 1)], "url string, label int")
    model = urls.train(none)
    got = urls.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), model).first()
    assert got.verdict == "allow" and got.score <= 0.5
