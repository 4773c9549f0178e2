"""Nearest neighbours by cosine: an inverted file whose blocks carry exact bounds, so that what it leaves out can't be near.

Vectors of length one have ``cosine = 1 - distance² / 2``. Each belongs to the list of its nearest centroid, and the
vectors of a list, in the order of their distances to it, fill blocks. A query at distance ``d`` from the centroid is at
least ``|d - r|`` from a vector at distance ``r``, so a block from ``near`` to ``far`` is read only if that leaves room
below the query's bound, which the blocks beside the query give first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.snapshot import cut

#: Vectors of a block, and queries of one.
BLOCK, QUERIES = 512, 128
#: Vectors, at most, of which the centroids are made; all others only look for theirs.
SAMPLE = 16_384
#: Room for rounding: scores are compared after nine decimals.
SLACK = 1e-6

_BLOCK = "block long, list int, near double, far double, n int, ids binary, data binary"


@dataclass
class InvertedFile:
    """``blocks`` is the written table of vectors, ``centroids`` a matrix of as many rows as there are lists."""

    blocks: DataFrame
    centroids: np.ndarray

    @property
    def bands(self) -> DataFrame:
        """(block, list, near, far, n): what is known of the blocks without their vectors."""
        return self.blocks.select("block", "list", "near", "far", "n")


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """(id, embedding as doubles), one row for an id (the smallest vector): vectors of ``size`` finite components of which
    one isn't zero. Others, and rows without an id, have no direction or name and are nobody's neighbour."""
    e = F.col("embedding")
    whole = (F.size(e) == size) & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("id").isNotNull() & e.isNotNull() & whole)
    return rows.groupBy(F.col("id").cast("long").alias("id")).agg(F.min(e.cast("array<double>")).alias("embedding"))


def _unit(column) -> np.ndarray:
    """The vectors of an Arrow column of lists, each of length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T, 0))


def _centroids(rows: DataFrame, lists: int, rounds: int) -> np.ndarray:
    """Centroids of at most ``SAMPLE`` vectors, which the driver holds; none if there are no vectors."""
    n = rows.count()
    if not n:
        return np.zeros((0, 1))
    share = int(min(1.0, SAMPLE / n) * 1_000_000)
    picked = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < max(share, 1))
    x = _unit(pa.chunked_array(picked.limit(SAMPLE).select("embedding").toArrow()["embedding"].chunks, type=pa.list_(pa.float64())).combine_chunks())
    x = np.unique(x, axis=0)
    lists = min(lists, len(x))
    at = x[np.random.default_rng(0).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = _distances(x, at).argmin(axis=1)
        sums, counts = np.zeros_like(at), np.bincount(own, minlength=lists)
        np.add.at(sums, own, x)
        at = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], at)
    return at


def _packed(rows: DataFrame, centroids: np.ndarray, size: int, name: str) -> DataFrame:
    """Blocks of at most ``size`` of ``rows`` (id, embedding), written. Rows are spread over tasks by their ids, so a list of any size is
    packed by all tasks; each sorts what it has by list and distance, and blocks are slices of that order."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(1))
                far = _distances(x, centroids)
                own = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(x)), own]), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "list", "far", "data"]
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, None

        def block(of, at, n):
            far = of[2][at : at + n]
            return {"block": base + made, "list": of[1][at], "near": far[0], "far": far[-1], "n": n, "ids": np.array(of[0][at : at + n], np.int64).tobytes(), "data": b"".join(of[3][at : at + n])}

        schema = pa.schema([("block", pa.int64()), ("list", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
        for b in batches:
            of = [c.to_pylist() for c in b.columns]
            if held:
                of = [h + o for h, o in zip(held, of)]
            ends = [i for i in range(1, len(of[1])) if of[1][i] != of[1][i - 1]] + [len(of[1])]
            at = 0
            for end in ends:
                while at < end and (end - at >= size or end < len(of[1])):
                    n = min(size, end - at)
                    yield pa.RecordBatch.from_pylist([block(of, at, n)], schema)
                    made, at = made + 1, at + n
            held = [o[at:] for o in of]
        if held and held[0]:
            yield pa.RecordBatch.from_pylist([block(held, 0, len(held[0]))], schema)

    owned = rows.select("id", "embedding").mapInArrow(assign, "id long, list int, far double, data binary")
    return cut(owned.sortWithinPartitions("list", "far", "id").mapInArrow(pack, _BLOCK), name)


def build(vectors: DataFrame, size: int, lists: int = 128, rounds: int = 8) -> InvertedFile:
    """An inverted file of ``vectors`` (id, embedding), all that are ``usable``. One shuffle, by id."""
    rows = cut(usable(vectors, size), "usable")
    at = _centroids(rows, lists, rounds)
    return InvertedFile(_packed(rows.repartition("id"), at, BLOCK, "blocks"), at)


def _scored(pairs: DataFrame, k: int, own: bool) -> DataFrame:
    """(qblock, query, id, score): of each pair of a block of queries and a block, the ``k`` best of each query
    that reach its bound; equal scores by id. A query isn't its own neighbour, unless ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q, ids = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
                s = np.frombuffer(row["qdata"]).reshape(len(q), -1) @ np.frombuffer(row["data"]).reshape(len(ids), -1).T
                least = np.frombuffer(row["bounds"])
                keep = s >= least[:, None] - SLACK
                if not own:
                    keep &= q[:, None] != ids
                i, j = np.nonzero(keep)
                score = np.round(s[i, j], 9) + 0.0
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                starts = np.searchsorted(i, np.arange(len(q)))
                top = np.arange(len(i)) - starts[i] < k
                i, j, score = i[top], j[top], score[top]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["qblock"])), pa.array(q[i]), pa.array(ids[j]), pa.array(score)], ["qblock", "query", "id", "score"])

    return pairs.select("qblock", "qids", "qdata", "bounds", "ids", "data").mapInArrow(run, "qblock long, query long, id long, score double")


def _bounded(asked: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """Blocks of queries with the score each query has to reach, as doubles in its queries' order; -1 where nothing is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                known = {x["query"]: x["bound"] for x in r["known"] or ()}
                out.append(np.array([known.get(i, -1.0) for i in np.frombuffer(r["qids"], np.int64).tolist()]).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*b.schema.names[:-1], "bounds"])

    named = asked.select(F.col("block").alias("qblock"), F.col("list").alias("home"), F.col("near").alias("qnear"), F.col("far").alias("qfar"), F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    nothing = F.lit(None).cast("array<struct<query:bigint,bound:double>>")
    met = named.withColumn("known", nothing) if bounds is None else named.join(bounds.groupBy("qblock").agg(F.collect_list(F.struct("query", "bound")).alias("known")), "qblock", "left")
    return met.mapInArrow(run, "qblock long, home int, qnear double, qfar double, qids binary, qdata binary, bounds binary")


def _rooms(asked: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(qblock, list, low, high): distances from the list's centroid between which a block can hold what a query of the block needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                bounds = np.frombuffer(row["bounds"])
                d = _distances(np.frombuffer(row["qdata"]).reshape(len(bounds), -1), centroids)
                reach = np.sqrt(np.maximum(2 - 2 * (bounds - SLACK), 0))[:, None] + SLACK
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(centroids), row["qblock"])), pa.array(np.arange(len(centroids), dtype=np.int32)), pa.array((d - reach).min(axis=0)), pa.array((d + reach).max(axis=0))], ["qblock", "list", "low", "high"]
                )

    return asked.select("qblock", "qdata", "bounds").mapInArrow(run, "qblock long, list int, low double, high double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def plan(index: InvertedFile, queries: DataFrame, size: int, k: int, probes: int = 4, own: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of queries with their bounds, pairs (qblock, block) left to compare, and what the first ``probes`` found."""
    asked = _packed(usable(queries, size), index.centroids, QUERIES, "queries")
    blind = _bounded(asked, None)
    gap = F.greatest(F.col("near") - F.col("qfar"), F.col("qnear") - F.col("far"), F.lit(0.0))
    beside = blind.select("qblock", "qnear", "qfar", F.col("home").alias("list")).join(index.bands, "list").withColumn("r", F.row_number().over(Window.partitionBy("qblock").orderBy(gap, "block")))
    first = beside.where(F.col("r") <= probes).select("qblock", "block")
    found = cut(_scored(first.join(blind, "qblock").join(index.blocks, "block"), k, own), "probed")
    bounds = _best(found, k).where(F.col("rank") == k).select("qblock", "query", F.col("score").alias("bound"))
    ready = cut(_bounded(asked, bounds), "bounded")
    room = _rooms(ready, index.centroids).join(index.bands, "list").where((F.col("far") >= F.col("low")) & (F.col("near") <= F.col("high")))
    left = cut(room.select("qblock", "block").join(first, ["qblock", "block"], "left_anti"), "pairs")
    return ready, left, found


def nearest(index: InvertedFile, queries: DataFrame, size: int, k: int = 10, probes: int = 4, own: bool = False) -> DataFrame:
    """(query, rank, id, score): of each query (id, embedding) the ``k`` vectors of the highest cosine, to nine decimals, equal ones by id. Exact.

    Queries come in blocks of those with the same list. The ``probes`` blocks beside each give its queries bounds; a query for which they
    hold fewer than ``k`` vectors has none and meets every block. Rows shuffled are the index once, the blocks of queries once for each
    block they meet, and at most ``k`` results for a query and block. Without vectors or queries there are no rows.
    """
    if not len(index.centroids):
        return index.blocks.sparkSession.createDataFrame([], "query long, rank int, id long, score double")
    ready, left, found = plan(index, queries, size, k, probes, own)
    rest = _scored(left.join(ready, "qblock").join(index.blocks, "block"), k, own)
    return _best(found.unionByName(rest), k).select("query", "rank", "id", "score")
