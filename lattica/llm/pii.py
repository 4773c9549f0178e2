"""Personal data: base patterns, and bootstrapped contextual extraction; DataFrame operations only.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. They, and credentials in a few strict
formats (kind ``secret``), are the seeds of a graph of lexical patterns and instances. A lexical pattern is the word
before an identifier, the two words before it, the word after it, the key in front of it (``tel:``), or the word before
with the identifier's mask (digits and letters by class); an instance is a seed, or another run of characters with
digits or ``@`` that no base pattern accepts. Spark scores the graph for some rounds: a pattern is as reliable for a
kind as the share that are of it among its distinct instances of any kind and those that can't be of this one. A
pattern with enough scored instances and a high share passes its reliability on to its other instances of a fitting
shape, which count as scored in the next round. An instance that no base pattern accepts is an unseen identifier of a
kind if such a pattern reaches it; a credential in a strict format needs the pattern as well.

Positions are sums over the pieces between matches, made by window functions over the rows of a text's matches, so the
work is in proportion to a text's length, however many matches it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Kinds of the base patterns, and the kind that only bootstrapping adds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
# The contract's patterns. Where a match could begin anywhere in a run, it can only begin at the run's first
# character or right after the last match; so long runs without a match take linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can have a match at all.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Runs between white space that have a digit or an at sign.
CANDIDATE = r"(?:(?<![^\s])|\G)[^\s0-9@]*+[0-9@][^\s]*+"
_CANDIDATE_GATE = r"(?s)[0-9].*[0-9].*[0-9].*[0-9]|@"
#: A candidate has at least so many characters and digits.
LEAST_LENGTH, LEAST_DIGITS = 7, 4
#: What a loosely written identifier looks like; another run in a pattern speaks against the kind.
SHAPES = {
    "email": "@",
    "ip": "^(?=.*[0-9])[\\[(]?[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,}[\\])]?(?:/[0-9]+)?$",
    "card": r"^(?:[0-9][^0-9A-Za-z@]{0,2}){12,19}$",
    "phone": r"^[+(]{0,2}(?:[0-9][^0-9A-Za-z@]{0,2}){7,15}$",
    "secret": r"^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9_.+/=-]{12,}$",
}
#: Credentials in strict formats: the seeds of their kind. Hexadecimal digests are as long as SHA-1 or SHA-256.
SECRETS = r"^(?:AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|[0-9a-f]{40}|[0-9a-f]{64})$"
#: Code points of context on either side.
CONTEXT = 40
#: A pattern passes its reliability on from so many distinct seeds and this share on.
LEAST_SEEDS, LEAST_SHARE = 5, 0.9
ROUNDS = 3
#: Parts that a pattern's or an instance's edges are dealt to, so that a common one isn't one task.
SALTS = 16
_HIT = "array<struct<kind:int,skip:int,m:string,left:string,right:string>>"


def _hits(text: Column, kind: int, pattern: str, gate: str) -> Column:
    """(kind, skip, m, left, right) of all leftmost, non-overlapping matches: ``skip`` code points lie between the
    match before and this one; left and right are the context up to the next matches."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    n = F.size(matches)
    sides = F.zip_with(F.slice(pieces, 1, n), F.slice(pieces, 2, n), lambda a, b: F.struct(F.length(a).alias("skip"), F.substring(a, -CONTEXT, CONTEXT).alias("left"), F.substring(b, 1, CONTEXT).alias("right")))
    found = F.zip_with(sides, matches, lambda x, m: F.struct(F.lit(kind).alias("kind"), x["skip"].alias("skip"), m.alias("m"), x["left"].alias("left"), x["right"].alias("right")))
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(_HIT))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def hits(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hits) of every row: all raw matches of the base patterns, and all candidates (kind -1)."""
    text = F.col("t")
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    found = F.concat(*(_hits(text, i, PATTERNS[k], GATES[k]) for i, k in enumerate(KINDS)), _hits(text, -1, CANDIDATE, _CANDIDATE_GATE))
    return own.select("row", "doc_id", F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(_HIT)).alias("hits"))


def placed(found: DataFrame) -> DataFrame:
    """(row, doc_id, kind, s, e, m, left, right): the base spans, and the candidates that overlap none of them
    (kind -1), trimmed of punctuation; a row for each."""
    raw = found.select("row", "doc_id", F.posexplode("hits").alias("i", "x")).select("row", "doc_id", "i", "x.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = raw.withColumn("e", F.sum(F.col("skip") + F.length("m")).over(upto).cast("int")).withColumn("s", F.col("e") - F.length("m"))
    base = F.lit(False)
    for i, kind in enumerate(KINDS):
        base = base | ((F.col("kind") == i) & _valid(kind, F.col("m")))
    head, tail = F.regexp_extract("m", r"^[^A-Za-z0-9+@_]*", 0), F.regexp_extract("m", r"[^A-Za-z0-9)_=]*$", 0)
    bare = F.substring(F.col("m"), F.length(head) + 1, F.length("m") - F.length(head) - F.length(tail))
    other = F.col("kind") == -1
    trimmed = at.where(base | other).select(
        "row", "doc_id", "kind", F.when(other, F.col("s") + F.length(head)).otherwise(F.col("s")).alias("s"), F.when(other, F.col("e") - F.length(tail)).otherwise(F.col("e")).alias("e"), F.when(other, bare).otherwise(F.col("m")).alias("m"), "left", "right"
    )
    digits = F.length(F.regexp_replace("m", "[^0-9]", ""))
    long = trimmed.where((F.col("kind") >= 0) | ((F.length("m") >= LEAST_LENGTH) & ((digits >= LEAST_DIGITS) | F.contains("m", F.lit("@")))))
    # of a row's spans in order, a candidate must begin after every base span before it and end before every one after it
    is_base = F.col("kind") >= 0
    before = Window.partitionBy("row").orderBy("s", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("s"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    met = long.withColumn("b", F.max(F.when(is_base, F.col("e"))).over(before)).withColumn("a", F.min(F.when(is_base, F.col("s"))).over(after))
    free = (F.coalesce("b", F.lit(0)) <= F.col("s")) & (F.col("a").isNull() | (F.col("a") >= F.col("e")))
    return met.where(is_base | free).drop("a", "b")


def _patterns() -> Column:
    """The lexical patterns of a span with its context."""
    left = F.lower(F.regexp_extract("left", r"([^\s]+)\s*$", 1))
    two = F.lower(F.regexp_replace(F.regexp_extract("left", r"([^\s]+\s+[^\s]+)\s*$", 1), r"\s+", " "))
    right = F.lower(F.regexp_extract("right", r"^[^\s]*\s+([^\s]+)", 1))
    key = F.lower(F.regexp_extract("m", r"^([A-Za-z_]+[=:])", 1))
    mask = F.regexp_replace(F.regexp_replace("m", "[0-9]+", "9"), "[A-Za-z]+", "a")
    named = lambda tag, x: F.when(x != "", F.concat(F.lit(tag + " "), x))
    shaped = F.when((left != "") & (F.length(mask) <= CONTEXT), F.concat(F.lit("s "), left, F.lit(" "), mask))
    return F.filter(F.array(named("l", left), named("ll", two), named("r", right), named("k", key), shaped), lambda p: p.isNotNull())


def _odd(kind: int) -> Column:
    """Whether a run, without its key, can't be of the kind even when loosely written."""
    bare = F.regexp_replace("m", "^[A-Za-z_]+[=:]", "")
    shape = SHAPES[ALL_KINDS[kind]]
    if ALL_KINDS[kind] == "card":  # its check digit tells a number that is none
        return ~(bare.rlike(shape) & F.call_function("luhn_check", F.regexp_replace(bare, "[^0-9]", "")))
    return ~bare.rlike(shape)


def _salted(edges: DataFrame, on: str, other: str, few: DataFrame, how: str = "inner") -> DataFrame:
    """``edges`` joined with ``few`` (a row for each ``on``); edges of one ``on`` are dealt by ``other``."""
    many = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(many, [on, "salt"], how).drop("salt")


def discover(spans: DataFrame, least_seeds: int = LEAST_SEEDS, least_share: float = LEAST_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(m, kind, score): the instances that reliable patterns make identifiers of a kind, from the rows of ``placed``.

    A pattern's share for a kind is the number of its instances of that kind over those that say something (half an
    instance more, so that few seeds are worth less): those known to be of any kind, and those that can't be of this
    one. Others may be what is looked for, and don't count.
    """
    kinds = range(len(ALL_KINDS))
    kind = F.when(F.col("kind") >= 0, F.col("kind")).when(F.col("m").rlike(SECRETS), SECRET).otherwise(-1)
    rows = spans.select(F.explode(_patterns()).alias("p"), "m", kind.alias("kind"), (F.col("kind") >= 0).alias("base"))
    edges = written(rows.groupBy("p", "m").agg(F.max("kind").alias("kind"), F.max("base").alias("base")), "pattern-instances")  # copies count once
    # discovered instances count towards the seeds: only patterns with too few instances of any sort never pass anything on
    size = written(edges.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= least_seeds).select("p"), "patterns")
    open_ = written(_salted(edges, "p", "m", size).select("p", "m", "base", *(_odd(k).alias(f"odd{k}") for k in kinds)), "open-patterns")
    seeds = written(edges.where("kind >= 0").groupBy("m").agg(F.max("kind").alias("kind")), "seeds")
    known = seeds
    for _ in range(rounds):
        met = _salted(open_, "m", "p", known, "left")
        by_kind = F.array(*(F.struct(F.lit(k).alias("kind"), F.count_if(F.col("kind") == k).alias("k"), F.count_if(F.col("kind").isNotNull() | F.col(f"odd{k}")).alias("n")) for k in kinds))
        weighed = met.groupBy("p").agg(by_kind.alias("x")).select("p", F.explode("x").alias("x")).select("p", "x.*").where(F.col("k") >= least_seeds)
        weighed = weighed.withColumn("share", F.col("k") / (F.col("n") + 0.5)).where(F.col("share") >= least_share).select("p", F.struct("share", "kind").alias("w"))
        best = weighed.groupBy("p").agg(F.max("w").alias("w"))  # of shares of nine tenths only one kind can have one
        fits = F.element_at(F.array(*(~F.col(f"odd{k}") for k in kinds)), F.col("w.kind") + 1)
        passed = _salted(open_.where("not base"), "p", "m", best).where(fits).groupBy("m").agg(F.max("w").alias("w"))
        reached = written(passed.select("m", F.col("w.kind").alias("kind"), F.col("w.share").alias("score")), "instances")
        fresh = reached.join(seeds.select("m"), "m", "left_anti").select("m", "kind")
        known = seeds.unionByName(fresh)
    return reached


_SPANS = "array<struct<kind:int,s:int,e:int,m:string>>"


def personal_data(docs: DataFrame, **bootstrap) -> DataFrame:
    """(doc_id, base, added) for every row of ``docs`` (doc_id, text): arrays of (kind, s, e, m).

    base has what the base patterns find, added what bootstrapping discovers beside them, by kind (its place in
    ``ALL_KINDS``) and start; positions are code points. Null and empty texts have neither. Repeated rows have equal
    results, and count once as evidence. Other columns are ignored.
    """
    found = written(hits(docs), "hits")
    spans = written(placed(found.where("size(hits) > 0")), "spans")
    unseen = discover(spans, **bootstrap)
    base = spans.where("kind >= 0").select("row", "kind", "s", "e", "m", F.lit(True).alias("own"))
    other = _salted(spans.where("kind < 0").select("row", "s", "e", "m"), "m", "row", unseen.select("m", "kind"))
    one = F.struct("kind", "s", "e", "m")
    grouped = base.unionByName(other.withColumn("own", F.lit(False))).groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("own"), one))).alias("base"), F.array_sort(F.collect_list(F.when(~F.col("own"), one))).alias("added"))
    none = F.array().cast(_SPANS)
    with_spans = found.where("size(hits) > 0").select("row", "doc_id").join(grouped, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))
    return found.where("size(hits) = 0").select("doc_id", none.alias("base"), none.alias("added")).unionByName(with_spans)


def _listed(x: Column) -> Column:
    names = F.array(*(F.lit(k) for k in ALL_KINDS))
    return F.array_join(F.transform(x, lambda y: F.concat_ws(":", F.element_at(names, y["kind"] + 1), y["s"].cast("string"), y["e"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; ``n_added`` of the spans are discovered ones."""
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
