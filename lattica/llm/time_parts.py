"""Adaptive time partitions by two-level ranking, and their rewriting when rows have come.

A table is laid out by a moment in time: years, and in those of too many rows months, days, hours; neighbours that
are small share a leaf. A leaf's rows in order fill files of a fixed number of rows. To number a giant leaf's rows
without sorting it in one task, it is subdivided: rows whose hash falls in one of a fixed share of
values are pivots, the pivots of a leaf cut its order into *buckets* of about a quarter of a file, buckets are counted, and
a prefix sum over the counts gives each bucket's offset; ``row_number`` runs inside buckets only. Pivots are drawn
from all rows, repeated ones as well, so any group of equal moments, or of equal rows, is cut too.

The number of rows in a file is a fixed share of the table's, so the nodes that split, the leaves, files and pivots
are as many for any size of the table: what the driver sees and what is broadcast is bounded by ``limit`` alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SharedFiles, fresh_path, table, written

#: Files that a layout has about, and buckets in a file.
FILES = 650
FINER = 4
#: What a node of the calendar is called inside its parent, and a number of its own for each level, from (year, month, day, hour).
LEVELS = ("year", "month", "day", "hour")
NULL = "null"


@dataclass
class Leaf:
    name: str
    level: int
    members: list[int]


def _nodes(moment: Column) -> list[Column]:
    """Numbers of the year, month, day and hour that hold a moment: like 2024, 202403, 20240305, 2024030507."""
    date = F.year(moment) * 10_000 + F.month(moment) * 100 + F.dayofmonth(moment)
    return [F.year(moment).cast("long"), F.floor(date / 100).cast("long"), date.cast("long"), date.cast("long") * 100 + F.hour(moment)]


def runs(siblings: list[tuple[int, int]], limit: int) -> tuple[list[tuple[list[int], int]], list[int]]:
    """(runs, split) of (node, rows) in time order: neighbours within ``limit`` together, in runs of (nodes, rows), and
    those above it. An empty node joins or starts a run like any other."""
    out: list[tuple[list[int], int]] = []
    split, before = [], None
    for node, n in siblings:
        if n > limit:
            split.append(node)
            before = None
        elif before is not None and before[1] + n <= limit:
            before[0].append(node)
            out[-1] = before = (before[0], before[1] + n)
        else:
            before = ([node], n)
            out.append(before)
    return out, split


def _children(node: int, level: int) -> list[int]:
    """All months of a year, days of a month, hours of a day."""
    from calendar import monthrange

    n = [12, 0, 24][level] or monthrange(node // 100, node % 100)[1]
    return [node * 100 + k for k in (range(n) if level == 2 else range(1, n + 1))]


def _name(members: list[int], level: int) -> str:
    digits = str(members[0]).zfill(4 + 2 * level)
    parents = [digits[:4], *(digits[i : i + 2] for i in range(4, len(digits), 2))][:level]
    width = 2 if level else 4
    return "/".join([*parents, f"{digits[-width:]}-{str(members[-1]).zfill(width)[-width:]}"])


def leaves_of(hours: DataFrame, limit: int) -> list[Leaf]:
    """The leaves of a table of (year, month, day, hour, n): the nodes as numbers, and the rows of that hour.

    The driver gets the rows of the years, and of the children of nodes above ``limit``, of which a level has
    fewer than rows / limit. Runs without rows are no leaves; hours above ``limit`` are leaves of their own.
    """
    out: list[Leaf] = []
    parents: list[int] | None = None
    for level, column in enumerate(LEVELS):
        within = hours if parents is None else hours.where(F.col(LEVELS[level - 1]).isin(parents))
        found = {r[0]: r.n for r in within.groupBy(column).agg(F.sum("n").alias("n")).where("n > 0").collect()}
        if parents is None:
            families = [range(min(found), max(found) + 1)] if found else []
        else:
            families = [_children(p, level - 1) for p in parents]
        parents = []
        for family in families:
            whole, split = runs([(k, found.get(k, 0)) for k in family], limit)
            out += [Leaf(_name(members, level), level, members) for members, n in whole if n]
            if level == 3:
                out += [Leaf(_name([k], 3), 3, [k]) for k in split]
            else:
                parents += split
        if not parents:
            break
    return out


def _led(rows: DataFrame, leaves: list[Leaf]) -> DataFrame:
    """``rows`` with leaf, the name; each level's nodes are joined on their number, as a broadcast of bounded size."""
    spark, found = rows.sparkSession, []
    for level, column in enumerate(LEVELS):
        members = [(m, leaf.name) for leaf in leaves if leaf.level == level for m in leaf.members]
        if members:
            rows = rows.join(F.broadcast(spark.createDataFrame(members, f"{column} long, leaf{level} string")), column, "left")
            found.append(F.col(f"leaf{level}"))
    return rows.withColumn("leaf", F.coalesce(*found, F.lit(NULL)))


def _bucket(key: Column, pivots: Column) -> Column:
    """How many of the sorted ``pivots`` are at most ``key``, by binary search; null pivots are none."""
    size = F.coalesce(F.size(pivots), F.lit(0))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1)
    middle = lambda s: F.floor((s.lo + s.hi) / 2).cast("int")
    left = lambda s: F.struct((middle(s) + 1).alias("lo"), s.hi.alias("hi"))
    right = lambda s: F.struct(s.lo.alias("lo"), middle(s).alias("hi"))
    step = lambda s, _: F.when(s.lo >= s.hi, s).when(F.get(pivots, middle(s)) <= key, left(s)).otherwise(right(s))
    return F.when(F.size(pivots) > 0, F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), step, lambda s: s.lo)).otherwise(0)


def ranked(rows: DataFrame, leaves: list[Leaf], limit: int) -> DataFrame:
    """``rows`` with leaf and part: the number, from 1, of the file in the leaf that takes the row.

    ``rows`` is as ``keyed`` gives it.
    """
    pivots = _led(rows.where("pivot"), leaves).groupBy("leaf").agg(F.sort_array(F.collect_set("key")).alias("pivots"))
    placed = _led(rows, leaves).join(F.broadcast(written(pivots, "pivots")), "leaf", "left").withColumn("bucket", _bucket(F.col("key"), F.col("pivots"))).drop("pivots")
    counts = written(placed.groupBy("leaf", "bucket").agg(F.count("*").alias("n")), "buckets")
    before = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("leaf", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("leaf", "bucket").orderBy("key"))
    at = placed.withColumn("at", inside).join(F.broadcast(offsets), ["leaf", "bucket"])
    return at.withColumn("part", F.floor((F.col("offset") + F.col("at") - 1) / limit) + 1).select("row", "key", "new", "leaf", "part")


def _parts(placed: DataFrame) -> DataFrame:
    """(leaf, part, n, new, sum1, sum2): what a file holds, whatever its rows' order; equal sums of two hashes count as equal rows."""
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    return placed.groupBy("leaf", "part").agg(F.count("*").alias("n"), F.sum(F.col("new").cast("long")).alias("new"), total(F.xxhash64("row")).alias("sum1"), total(F.xxhash64(F.lit("again"), "row")).alias("sum2"))


def _apart(names: list[str], wanted: str) -> str:
    """``wanted``, or with underscores behind it if a column has that name."""
    while wanted.lower() in (n.lower() for n in names):
        wanted += "_"
    return wanted


def _write(placed: DataFrame, root: str, columns: list[str]) -> None:
    """One Parquet file for each leaf and part below ``root``, its rows in order of key; a leaf's slashes are dots in folders."""
    leaf, part = _apart(columns, "leaf"), _apart(columns, "part")
    own = placed.select(F.translate("leaf", "/", ".").alias("__leaf"), F.col("part").alias("__part"), "key", "row").repartition("__leaf", "__part").sortWithinPartitions("__leaf", "__part", "key")
    own.select(F.col("__leaf").alias(leaf), F.col("__part").alias(part), "row.*").write.mode("append").option("maxRecordsPerFile", 0).partitionBy(leaf, part).parquet(root)


def _files(spark: SparkSession, root: str, schema, key: str) -> DataFrame:
    """(leaf, part, path, n_rows, ids_sha256) of each file below ``root``, read back in the order of its rows."""
    leaf, part = _apart(schema.names, "leaf"), _apart(schema.names, "part")
    from pyspark.sql.types import LongType, StringType, StructType

    whole = StructType([*schema.fields]).add(leaf, StringType()).add(part, LongType())
    read = spark.read.schema(whole).parquet(root).select(F.translate(leaf, ".", "/").alias("leaf"), F.col(part).alias("part"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col(key).cast("string").alias("id"))

    def digest(batches) -> Iterator:
        import pyarrow as pa

        def row(now, n, sha):
            return pa.RecordBatch.from_pydict({"leaf": [now[0]], "part": [now[1]], "path": [now[2]], "n_rows": [n], "ids_sha256": [sha.hexdigest()]}, schema=pa.schema([("leaf", pa.string()), ("part", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("ids_sha256", pa.string())]))

        now, n, sha = None, 0, None
        for b in batches:
            paths, ids, at = b.column(2).to_pylist(), b.column(3).to_pylist(), 0
            while at < len(paths):
                if now is None or paths[at] != now[2]:
                    if now is not None:
                        yield row(now, n, sha)
                    now, n, sha = (b.column(0)[at].as_py(), b.column(1)[at].as_py(), paths[at]), 0, hashlib.sha256()
                to = at
                while to < len(paths) and paths[to] == now[2]:
                    to += 1
                sha.update((b"," if n else b"") + ",".join(i or "" for i in ids[at:to]).encode())
                n, at = n + to - at, to
        if now is not None:
            yield row(now, n, sha)

    one_each = read.repartition("path").sortWithinPartitions("path", "at").select("leaf", "part", "path", "id")
    return one_each.mapInArrow(digest, "leaf string, part long, path string, n_rows long, ids_sha256 string")


def keyed(df: DataFrame, moment: Column, order: list[str], started: Column, limit: int) -> DataFrame:
    """(row, key, pivot, new, year, month, day, hour) of each row, written once: both layouts see the same numbers.

    key orders rows by moment, ``order``, then a hash of all columns, and a number where whole rows are equal; nulls
    come first. pivot: true for one row in ``limit`` / ``FINER`` by hash, so there are about ``FINER`` for each file.
    new: not ``started``.
    """
    every = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    own = df.select(every.alias("row"), moment.cast("timestamp_ntz").alias("moment"), F.struct(*(F.col(f"`{c}`") for c in order)).alias("order"), F.coalesce(~started, F.lit(True)).alias("new"), F.monotonically_increasing_id().alias("salt"))
    key = F.struct("moment", "order", F.xxhash64("row").alias("hash"), "salt").alias("key")
    pivot = F.pmod(F.xxhash64("moment", "order", "salt"), F.lit(max(1, limit // FINER))) == 0
    return written(own.select("row", key, pivot.alias("pivot"), "new", *(n.alias(c) for n, c in zip(_nodes(F.col("moment")), LEVELS))), "keyed")


def layouts(df: DataFrame, moment: Column, order: list[str], started: Column, key: str, limit: int | None = None, path: str | None = None) -> DataFrame:
    """Lays out the rows of ``df`` that are ``started``, then all, in one folder; a row for each file that is there then.

    Returns leaf, part, n_rows, n_new (rows that are not ``started``), columns, ids_sha256 (of ``key`` in the file's order,
    joined by commas, null as nothing), path, rewritten (false: the file is one of the first layout, which held
    the same rows of that leaf and part). Files of the first layout that don't recur are removed after the new
    ones are written. ``limit``, rows of a file at most, is by default 1 + rows / ``FILES``. A null ``moment`` goes to the leaf
    ``null``; null fields of ``order`` come first; repeated rows are kept; an empty table has no files. Further
    columns, whatever their names, are in the files.
    """
    spark, path = df.sparkSession, path or fresh_path(df.sparkSession, "layout")
    limit = limit or 1 + df.count() // FILES
    rows = keyed(df, moment, order, started, limit)
    hours = written(rows.where("year is not null").groupBy(*LEVELS).agg(F.count(F.when(~F.col("new"), 1)).alias("started"), F.count("*").alias("n")), "hours")
    first = written(ranked(rows.where(~F.col("new")), leaves_of(hours.select(*LEVELS, F.col("started").alias("n")), limit), limit), "placed")
    _write(first, path, df.columns)
    last = written(ranked(rows, leaves_of(hours, limit), limit), "placed")
    before, after = _parts(first), _parts(last)
    same = ["leaf", "part", "n", "sum1", "sum2"]
    parts = written(after.join(before.select(*same, F.lit(False).alias("rewritten")), same, "left").select("leaf", "part", F.col("new").alias("n_new"), F.coalesce("rewritten", F.lit(True)).alias("rewritten")), "parts")
    at = spark.read.schema(_whole(df)).parquet(path).select(F.col("_metadata.file_path").alias("path"))
    old = {r.path for r in at.distinct().collect()}  # bounded by the number of files
    stay = {(r.leaf.replace("/", "."), r.part) for r in parts.where(~F.col("rewritten")).collect()}
    _write(last.join(F.broadcast(parts.where("rewritten").select("leaf", "part")), ["leaf", "part"], "left_semi"), path, df.columns)
    files = SharedFiles(path)
    for p in old:
        name = "/".join(p.split("/")[-3:])
        leaf, part = (x.split("=", 1)[1] for x in name.split("/")[:2])
        if (leaf, int(part)) not in stay:
            files.remove(name)
    return _files(spark, path, df.schema, key).join(parts, ["leaf", "part"]).select("leaf", "part", "n_rows", "n_new", F.lit(",".join(df.columns)).alias("columns"), "ids_sha256", "path", "rewritten")


def _whole(df: DataFrame):
    from pyspark.sql.types import LongType, StringType, StructType

    return StructType([*df.schema.fields]).add(_apart(df.columns, "leaf"), StringType()).add(_apart(df.columns, "part"), LongType())


def click_moment() -> Column:
    """The moment of a click: its ts, of some moved back or floored to Monday, by the checksum of its id."""
    k = "pmod(crc32(cast(cast(click_id as string) as binary)), 128)"
    back = f"cast(({k} + 6) * ({k} + 6) * ({k} + 6) as int)"
    ts = "cast(ts as timestamp_ntz)"
    return F.expr(f"case when {k} < 16 then {ts} - make_dt_interval({back}) when {k} > 111 then cast(trunc(cast({ts} as date), 'week') as timestamp_ntz) else {ts} end")


def op12_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of ``clicks``: first of what arrived before March, then of all rows."""
    started = F.col("arrived_at").cast("timestamp_ntz") < F.expr("timestamp_ntz'2024-03-01 00:00:00'")
    return layouts(table(spark, sf_dir, "clicks"), click_moment(), ["arrived_at", "click_id"], started, "click_id")
