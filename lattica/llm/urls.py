"""URL filters: host and path rules, then gradient-boosted trees on lexical features; DataFrame operations only.

Features are columns over the URL: lengths of its parts, depth, digit ratios, character entropies, parameter counts,
hyphens, and how often sampled labelled URLs of the same host suffix or first path segment are blocked. The labelled
URLs are those on which the rules decide: a bounded sample of them is cut into quantile bins and counted by bin vector
in Spark, and trees are boosted on those counts. The trees judge every URL that no rule fits; they become one nested
CASE expression, so that scoring runs inside whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled URLs that are learned from, at most: those with the smallest hash.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE = 16, 24, 4, 0.2
#: The share of the features that each tree may split on, drawn anew for each: no single one decides alone.
COLUMNS = 0.5
FEATURES = ("length", "host_length", "path_length", "query_length", "depth", "digits", "host_digits", "path_digits", "last_digits", "entropy", "host_entropy", "parameters", "hyphens", "labels", "longest_label", "punctuation", "last_lead", "tld_rate", "suffix_rate", "segment_rate")
#: Labelled URLs that a suffix's block rate is smoothed with.
SMOOTH = 20


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, or null. A rule fits its host, all subdomains, and paths that
    start with its path."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def suffix(host_: Column, labels: int = 2) -> Column:
    """The last labels of a host."""
    return F.substring_index(host_, ".", -labels)


def _entropy(x: Column) -> Column:
    """Bits a character; a run of equal characters in the sorted string is one character: -sum(p log2 p) over runs."""
    n = F.length(x)
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(x, "")), ""), F.lit(r"(?s)(.)\1*"), 0)
    bits = F.aggregate(runs, F.lit(0.0), lambda s, r: s - F.length(r) / n * F.log2(F.length(r) / n))
    return F.round(F.when(n > 0, bits).otherwise(0.0), 6)  # equal for equal URLs, whatever the order of the sum


def _digits(x: Column) -> Column:
    return F.when(F.length(x) > 0, F.length(F.regexp_replace(x, "[^0-9]", "")) / F.length(x)).otherwise(0.0)


def features(url: Column, host_: Column, path_: Column) -> dict[str, Column]:
    """Lexical features; a null URL counts as empty."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    last = F.regexp_extract(path_, r"(?s)([^/]*)/?$", 1)
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(host_).cast("double"),
        "path_length": F.length(path_).cast("double"),
        "query_length": F.length(query).cast("double"),
        "depth": F.size(F.filter(F.split(path_, "/"), lambda x: x != "")).cast("double"),
        "digits": _digits(u),
        "host_digits": _digits(host_),
        "path_digits": _digits(path_),
        "last_digits": F.regexp_count(last, F.lit("[0-9]")).cast("double"),
        "entropy": _entropy(u),
        "host_entropy": _entropy(host_),
        "parameters": F.regexp_count(u, F.lit(r"[?&][^=&#]*=")).cast("double"),
        "hyphens": F.regexp_count(host_, F.lit("-")).cast("double"),
        "labels": F.regexp_count(host_, F.lit(r"[^.]+")).cast("double"),
        "longest_label": F.array_max(F.transform(F.split(host_, "[.]"), lambda x: F.length(x))).cast("double"),
        "punctuation": F.regexp_count(u, F.lit(r"[^A-Za-z0-9]")).cast("double"),
        "last_lead": F.ascii(last).cast("double"),
    }


def rule_label(url: Column, rules=RULES) -> Column:
    """1 where the longest fitting rule blocks a URL, 0 where it allows it, null where no rule fits."""
    verdict = rule_of(host(url), path(url), rules)["verdict"]
    return F.when(verdict.isNotNull(), (verdict == "block").cast("int"))


@dataclass
class Trees:
    """A base score, and trees as nested (feature, cut, left, right) with leaf values; left if value <= cut."""

    base: float
    trees: list
    rates: tuple[DataFrame, ...] = ()
    prior: float = 0.0

    def used(self) -> set[str]:
        """The features that some tree splits on."""
        found, todo = set(), list(self.trees)
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                found.add(node[0])
                todo += node[2:]
        return found

    def score(self, columns: dict[str, Column]) -> Column:
        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, cut, left, right = node
            return F.when(columns[feature] <= cut, of(left)).otherwise(of(right))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))


def boost(bins: np.ndarray, counts: np.ndarray, positives: np.ndarray, cuts: list[np.ndarray], names=FEATURES, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, columns: float = COLUMNS, seed: int = 5) -> Trees:
    """Logistic boosting on distinct bin vectors with their counts of rows and of rows to block."""
    rng = np.random.default_rng(seed)
    total, pos = counts.sum(), positives.sum()
    share = (pos + 0.5) / (total + 1)
    z = np.full(len(counts), np.log(share / (1 - share)))
    base, grown = float(np.log(share / (1 - share))), []

    def grow(own: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        G, H = g[own].sum(), h[own].sum()
        best = (1e-6, None)
        if left:
            for k in drawn:
                width = len(cuts[k]) + 1
                gs, hs = np.cumsum(np.bincount(bins[own, k], g[own], width)), np.cumsum(np.bincount(bins[own, k], h[own], width))
                for cut in range(width - 1):
                    a, b = gs[cut] ** 2 / (hs[cut] + 1), (G - gs[cut]) ** 2 / (H - hs[cut] + 1)
                    gain = a + b - G**2 / (H + 1)
                    if gain > best[0] and hs[cut] > 1e-3 and H - hs[cut] > 1e-3:
                        best = (gain, (k, cut))
        if best[1] is None:
            value = -rate * G / (H + 1)
            z[own] += value
            return float(value)
        k, cut = best[1]
        low = bins[own, k] <= cut
        return (names[k], float(cuts[k][cut]), grow(own[low], g, h, left - 1), grow(own[~low], g, h, left - 1))

    for _ in range(trees if len(counts) else 0):
        p = 1 / (1 + np.exp(-z))
        drawn = np.sort(rng.permutation(bins.shape[1])[: max(1, round(columns * bins.shape[1]))])
        grown.append(grow(np.arange(len(counts)), counts * p - positives, counts * p * (1 - p), depth))
    return Trees(base, grown)


#: Parts of a URL whose block rates are features: the last label of the host, the last two, the path's first segment.
RATES = ("tld_rate", "suffix_rate", "segment_rate")


def _part(name: str) -> Column:
    return suffix(F.col("host"), 1 if name == "tld_rate" else 2) if name != "segment_rate" else F.regexp_extract("path", r"(?s)^/([^/]*)", 1)


def _met(urls: DataFrame, rates: tuple[DataFrame, ...], prior: float) -> DataFrame:
    """``urls`` (host, path, ...) with the block rates of their parts, which are no more than the sample's rows."""
    for name, own in zip(RATES, rates):
        urls = urls.withColumn("_part", _part(name)).join(F.broadcast(own.withColumnRenamed("part", "_part")), "_part", "left").withColumn(name, F.coalesce(name, F.lit(prior))).drop("_part")
    return urls


def train(urls: DataFrame, sample: int = SAMPLE, bins: int = BINS) -> Trees:
    """Trees from labelled rows (url, label 0 or 1; 1: block); at most ``sample`` of them, by hash of the URL.

    Rows with a null url or label are left out. Without rows the score is one half or less for every URL.
    """
    own = urls.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", F.col("label").cast("int").alias("label"), F.xxhash64("url").alias("h"))
    n = own.count()  # a bound on the hash first, so that no task sorts more than about the sample
    low = -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * 1.25 * sample / max(n, 1)))
    own = written(own.where(F.col("h") <= low).orderBy("h", "url", "label").limit(sample).select("url", "label", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), "labelled-urls")
    prior = own.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    rates = tuple(written(own.groupBy(_part(name).alias("part")).agg(((F.sum("label") + SMOOTH * prior) / (F.count("*") + SMOOTH)).alias(name)), name) for name in RATES)
    wide = _met(own.select("label", "host", "path", *(c.alias(k) for k, c in features(F.col("url"), F.col("host"), F.col("path")).items())), rates, prior)
    cuts = []
    for edges in wide.agg(*(F.array_sort(F.array_distinct(F.percentile_approx(k, [i / bins for i in range(1, bins)], 10_000))).alias(k) for k in FEATURES)).first():
        cuts.append(np.array(edges if edges is not None else [], float))
    place = lambda k, e: sum(((F.col(k) > float(x)).cast("int") for x in e), F.lit(0)).alias(k)
    vectors = wide.select("label", *(place(k, e) for k, e in zip(FEATURES, cuts))).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()  # no more rows than the sample
    vectors.sort()
    model = boost(np.array([x[: len(FEATURES)] for x in vectors], np.int64).reshape(-1, len(FEATURES)), np.array([x.n for x in vectors], float), np.array([x.pos for x in vectors], float), cuts)
    model.rates, model.prior = rates, prior
    return model


def judge(pages: DataFrame, model: Trees, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url).

    The longest fitting rule decides; else URLs with a score above one half are blocked. A null URL or one without
    ``://`` has an empty host and path. Repeated rows have equal results. Other columns are ignored.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    own = own.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    columns = features(F.col("url"), F.col("host"), F.col("path"))
    lexical = _met(own.select("page_id", "url", "host", "path", *(c.alias(k) for k, c in columns.items())), model.rates, model.prior)
    scored = lexical.select("page_id", "url", "host", "path", model.score({k: F.col(k) for k in FEATURES}).alias("score"), rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    return scored.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; the URLs that rules decide teach the trees that judge the others."""
    pages = table(spark, sf_dir, "pages")
    model = train(pages.select("url", rule_label(F.col("url")).alias("label")))
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
