"""Change feeds: bursts of events per key, and tables kept up to date from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.snapshot import cut


def bursts(events: DataFrame, key: Column, item: Column, at: str = "ts", quiet: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n, items): events of a key that follow each other within ``quiet`` make one burst.

    On a stream the watermark ``late`` bounds the state; a batch gives the same rows.
    """
    marked = events.withWatermark(at, late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window(at, quiet).alias("w"), key.alias("key"))
    return grouped.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(item)).alias("items")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "items")


def changes(stamps: DataFrame, known: DataFrame) -> DataFrame:
    """(file, change): files (file, size, hash) that are new, changed or removed since ``known``; of equal content none."""
    a, b = stamps.select("file", F.col("hash").alias("now"), F.lit(True).alias("here")), known.select("file", F.col("hash").alias("was"), F.lit(True).alias("there"))
    met = a.join(b, "file", "full_outer")
    change = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("was")), "changed")
    return met.select("file", change.alias("change")).where("change is not null")


def upsert(table: DataFrame, fresh: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """``table`` with the rows of ``fresh`` in place of those of the same key, and without ``removed`` (key)."""
    out = table.join(fresh.select(key).distinct(), key, "left_anti")
    if removed is not None:
        out = out.join(removed.select(key), key, "left_anti")
    return out.select(table.columns).unionByName(fresh.select(table.columns))


def feed(spark: SparkSession, root: str, pattern: str = "*", each: int = 1000) -> DataFrame:
    """A stream of (file, ts, size, text) of the files that appear below a folder, ``each`` a batch.

    Spark's file source remembers in the checkpoint which paths it has seen, so a restarted stream goes on where it
    ended; a file that is written anew under its name isn't seen again: ``poll`` sees it.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    made = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", each).load(root)
    return made.select(F.col("path").alias("file"), F.col("modificationTime").alias("ts"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def poll(spark: SparkSession, root: str, state: str, pattern: str = "*") -> DataFrame:
    """(file, change) of the files that are new, changed or removed since the last poll with this ``state``, a folder.

    Files are known by path, time and length. Each poll writes what it has seen to a folder of its own below ``state``
    and only then counts, so a poll that fails is made again, and a new session goes on where another ended.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    now = listed.select(F.col("path").alias("file"), F.xxhash64("modificationTime", "length").alias("hash"))
    try:
        seen = spark.read.schema("file string, hash long, poll int").parquet(state)
        last = seen.agg(F.max("poll")).first()[0]
    except AnalysisException:  # no poll yet
        seen, last = spark.createDataFrame([], "file string, hash long, poll int"), None
    last = -1 if last is None else last
    met = cut(changes(now, seen.where(F.col("poll") == last).select("file", "hash")), "changes")
    now.withColumn("poll", F.lit(last + 1)).unionByName(spark.createDataFrame([(None, None, last + 1)], "file string, hash long, poll int")).write.partitionBy("poll").mode("append").parquet(state)
    return met.where("file is not null")


def judge_changes(known: DataFrame, batch: DataFrame) -> DataFrame:
    """(file, change) of a batch of files (file, text; null text: removed) against the shapes known (file, shape):
    new, structural, cosmetic or removed. A removed file that wasn't known is nothing."""
    from ..sources.git import shapes

    now = shapes(batch).withColumnRenamed("shape", "now").join(batch.select("file", F.col("text").isNull().alias("gone")).distinct(), "file")
    met = now.join(known.select("file", F.col("shape").alias("was"), F.lit(True).alias("known")), "file", "left")
    change = F.when(F.col("gone"), F.when(F.col("known"), "removed")).when(F.col("known").isNull(), "new").when(F.col("was") == F.col("now"), "cosmetic").otherwise("structural")
    return met.select("file", change.alias("change")).where("change is not null")


def apply_batch(known: DataFrame, batch: DataFrame) -> DataFrame:
    """The shapes (file, shape) after a batch: removed files go, others have their new shape. For ``foreachBatch``,
    written as a table of its own each time."""
    from ..sources.git import shapes

    fresh = shapes(batch.where("text is not null"))
    return known.join(batch.select("file").distinct(), "file", "left_anti").select("file", "shape").unionByName(fresh)
