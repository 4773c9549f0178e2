"""Line deduplication by overlapping three-line windows; DataFrame operations only.

Every three consecutive lines of a document are hashed. Windows that occur again anywhere are found by one
aggregation over the hashes, which also gives their first occurrence (smallest document id, then line). The lines
that later occurrences cover are merged and removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, at, h1, h2): a row for each window; ``at`` is its first line, from 0. h1 and h2 are two 64-bit
    hashes, together wide enough that different windows of any corpus differ."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x, F.length(x)).alias("b"))).alias("l"))
    starts = F.when(F.size("l") >= size, F.sequence(F.lit(0), F.size("l") - size)).otherwise(F.array().cast("array<int>"))
    at = hashed.select("doc_id", "l", F.explode(starts).alias("at"))
    part = [F.element_at("l", F.col("at") + i + 1) for i in range(size)]
    return at.select("doc_id", "at", F.xxhash64(*(x["a"] for x in part)).alias("h1"), F.xxhash64(*(x["b"] for x in part)).alias("h2"))


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, gone): for each document with lines to remove, their numbers in ascending order."""
    own = windows(docs, size)
    first = F.min(F.struct("doc_id", "at")).alias("first")
    again = own.groupBy("h1", "h2").agg(F.count("*").alias("n"), first).where("n > 1").select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"))
    met = own.join(written(again, "repeated-windows"), ["h1", "h2"])
    same = F.col("doc_id").eqNullSafe(F.col("first_doc"))
    # a window that overlaps its own first occurrence covers only the lines after that one
    start = F.when(same, F.greatest("at", F.col("first_at") + size)).otherwise(F.col("at"))
    later = met.where(~(same & (F.col("at") == F.col("first_at")))).select("doc_id", F.explode(F.sequence(start, F.col("at") + size - 1)).alias("line"))
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every row of ``docs`` (doc_id, text).

    A null text counts as one empty line and comes back empty. Texts of fewer than ``size`` lines have no window
    and stay as they are. Of equal windows, the one of the smallest (doc_id, line) is first and stays; a null
    doc_id is the smallest. Rows of equal doc_id are one document in that what is removed from one is removed
    from all; in them equal windows at the same line are one occurrence. Other columns are ignored.
    """
    gone = covered(docs, size).select(F.col("doc_id").alias("__id"), "gone")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    met = own.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.element_at(lines, i + 1)), "\n"))
    return met.select("doc_id", kept.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.size(F.array_intersect(F.coalesce("gone", F.array().cast("array<int>")), F.sequence(F.lit(0), F.size(lines) - 1))).cast("long").alias("n_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later occurrences of three-line windows; the kept text as its MD5 and length."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(l[i:i + 2], chr(10))) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
f AS (SELECT h, min((doc_id, pos)) AS first, count(*) AS n FROM w GROUP BY h HAVING count(*) > 1),
x AS (SELECT w.doc_id, w.pos, f.first[1] AS fd, f.first[2] AS fa FROM w JOIN f ON w.h = f.h),
g AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(pos, fa + 3) ELSE pos END, pos + 3)) AS line FROM x WHERE NOT (doc_id = fd AND pos = fa)),
r AS (SELECT d.doc_id, len(l) AS n_lines, list_filter(range(0, len(l)), lambda i: NOT list_contains(coalesce(a.gone, []), i)) AS kept, l FROM d LEFT JOIN (SELECT doc_id, list(line) AS gone FROM g GROUP BY doc_id) a ON d.doc_id = a.doc_id),
k AS (SELECT doc_id, n_lines, len(kept) AS n_kept, array_to_string(list_transform(kept, lambda i: l[i + 1]), chr(10)) AS t FROM r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_lines - n_kept AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM k
"""
