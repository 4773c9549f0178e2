"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

A document's hash is the MD5 of its id, read as a string of hex digits. Sizes are summed by source and by the
first three digits (4,096 buckets); the running sum over a source's buckets shows which bucket its budget falls
in. Only that *boundary* bucket is summed again by the next three digits, and so on, until boundaries hold one
hash. A document is taken if its hash lies below its source's threshold, so a larger budget takes a superset,
nothing is sorted, and a rerun takes the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Hex digits that each level of the histogram adds, and the most levels: together nearly all 32 digits.
DIGITS = 3
LEVELS = 10
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A
    target stops at ``repeats`` times its source's size; what is in excess is shared again by weight until none
    is above. With sources in order of size over weight, those up to some rank are at their stop and the others
    have the same target per weight, so running sums give the end of that sharing at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("i", (F.row_number().over(order) - 1) % len(weights))
    weighed = weighed.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("i") + 1)).withColumn("stop", F.col("source_size") * float(repeats))
    rank = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, all_ = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0))
    # the level if all before this one are at their stop and the rest share what is left; a running sum each
    level = (F.sum("source_size").over(all_) * share - before("stop")) / (F.sum("weight").over(all_) - before("weight"))
    ranked = weighed.withColumn("level", level).withColumn("free", F.when(F.col("level") <= F.col("stop") / F.col("weight"), F.col("level")))
    # the first rank whose level its own stop allows holds for all; null: every source is at its stop
    ranked = ranked.withColumn("held", F.first("free", ignorenulls=True).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("held").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("held") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, full, below) from sized (source, size, hash) and budgets (source, source_size, target).

    ``full`` is how often every document of the source is taken; those with a hash of at most ``below`` (null:
    none) are taken once more.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    open_ = budgets.select("source", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("left"), F.lit("").alias("prefix"), F.lit(None).cast("string").alias("below"))
    open_ = written(open_, "open")
    done = []
    for level in range(1, LEVELS + 1):
        within = sized
        if level > 1:
            edge_of = open_.select(F.col("source").alias("s"), "prefix")
            within = sized.join(edge_of, F.col("source").eqNullSafe(F.col("s")) & (F.substring("hash", 1, DIGITS * (level - 1)) == F.col("prefix")), "left_semi")
        sums = within.groupBy("source", F.substring("hash", 1, DIGITS * level).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("h0"), F.max("hash").alias("h1"))
        running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        met = running.join(open_.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "right")
        fits = F.coalesce(F.col("upto") <= F.col("left"), F.lit(False))
        # per source: the last hash of the buckets that fit as a whole, and the first bucket that doesn't
        edge = F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), (F.col("h0") == F.col("h1")).alias("single")), F.when(~fits, F.col("bucket")))
        state = met.groupBy(F.col("s").alias("source"), "full", "left", F.col("below").alias("b")).agg(F.max(F.when(fits, F.col("h1"))).alias("h"), edge.alias("e"))
        state = written(state.select("source", "full", F.coalesce("h", "b").alias("below"), (F.col("left") - F.col("e.before")).alias("left"), F.col("e.bucket").alias("prefix"), F.coalesce(F.col("e.single"), F.lit(True)).alias("done")), "open")
        done.append(state.where("done").select("source", "full", "below"))
        open_ = state.where("not done").drop("done")
        if not open_.limit(1).count():
            break
    else:
        done.append(open_.select("source", "full", "below"))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def _hash() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def _times() -> Column:
    return (F.col("__full") + F.coalesce(F.col("hash") <= F.col("__below"), F.lit(False)).cast("long")).alias("times")


def plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of every row, and a row for each source: __of, source_size, target, __full, __below."""
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), _hash().alias("hash")), "sized")
    sizes = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    budgets = written(targets(sizes, weights, share, repeats), "targets")
    cuts = thresholds(sized.select("source", "size", "hash"), budgets).select(F.col("source").alias("__of"), F.col("full").alias("__full"), F.col("below").alias("__below"))
    return sized, written(budgets.join(cuts, F.col("source").eqNullSafe(F.col("__of"))).drop("source"), "cuts")


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, times) for every row of ``docs`` (doc_id, source, text).

    size counts the words between white space; null or blank texts have none and take nothing. The words that a
    source's documents take stay below its target by less than one document's size. A null source is a source of
    its own; a null doc_id hashes as an empty string; repeated rows share a hash and so are taken or left
    together. No rows, no result. Other columns are ignored.
    """
    sized, cuts = plan(docs, weights, share, repeats)
    met = sized.join(cuts, F.col("source").eqNullSafe(F.col("__of")))
    return met.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"), _times())


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them.

    Rows without words take nothing of a target and come as often as their source's other rows of their hash; null
    sources are one source; null ids share a hash, as repeated ids do, and are taken together. No rows, no result.
    Other columns, whatever their names, come through.
    """
    _, cuts = plan(docs, weights, share, repeats)
    keep = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), _hash().alias("hash"))
    met = keep.join(cuts, F.col("source").eqNullSafe(F.col("__of"))).select("row", _times().cast("int").alias("times")).where("times > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS stop FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(stop) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, CASE WHEN level <= stop / weight THEN level END AS free FROM l),
t AS (SELECT source, source_size, CASE WHEN held IS NULL THEN stop ELSE least(stop, held * weight) END AS target
      FROM (SELECT *, (SELECT free FROM f WHERE free IS NOT NULL ORDER BY stop / weight, source ASC NULLS LAST LIMIT 1) AS held FROM f)),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS full_,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (full_ + CASE WHEN upto <= target - full_ * source_size THEN 1 ELSE 0 END) AS taken FROM c
"""
