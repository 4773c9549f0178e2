"""Centroid clustering by Delta Lloyd: exact integer k-means that only looks again at what has changed.

Vectors are written once, bucketed by a row number. Each round writes the owners (row, cluster, distance) anew,
bucketed in the same way, so that joining them to the vectors shuffles nothing. In a round, a vector whose owner
hasn't moved is compared with the moved centroids only; one whose owner has moved, with all. Vectors that change
owner carry their components along in the round's table, and signed sums of these (minus for the old cluster,
plus for the new) bring the clusters' sums and counts, which the driver keeps (``k`` rows), up to date. All
arithmetic is on integers, so the result equals Lloyd's, ties included.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table

#: Components are limited to this absolute value after scaling, so that squared distances of vectors of 64 fit 64 bits.
LIMIT = 2**27
#: Rows that numpy compares at a time.
BLOCK = 4096


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``row`` and read again; joins on ``row`` need no shuffle."""
    spark, called = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "row").option("path", fresh_path(spark, name)).saveAsTable(called)
    return spark.table(called)


def integer_vectors(df: DataFrame, column: str = "embedding", key: str = "vec_id", size: int = 64, scale: int = 1024) -> DataFrame:
    """(row, id, v) of the rows whose vector has exactly ``size`` components, none null or non-finite; v is
    floor(scale * x) of each, as long integers between -``LIMIT`` and ``LIMIT``. row is a number of its own for each
    row, within 64 bits."""
    x = F.col(column).cast("array<double>")
    good = (F.size(x) == size) & ~F.exists(x, lambda e: F.coalesce(F.isnan(e) | (F.abs(e) == float("inf")), F.lit(True)))
    v = F.transform(x, lambda e: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(e * float(scale)))).cast("long"))
    return df.where(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), v.alias("v"))


def _nearest(v: np.ndarray, centroids: np.ndarray, those: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> None:
    """Gives rows of ``v`` to one of ``those`` centroids that is nearer than their owner, or as near with a smaller number."""
    for c in those:
        d = v - centroids[c]
        d = np.einsum("ij,ij->i", d, d)
        better = (cluster < 0) | (d < distance) | (d == distance) & (c < cluster)
        cluster[better], distance[better] = c, d[better]


def _compare(centroids: np.ndarray, moved: np.ndarray):
    """The function for mapInArrow that gives every vector its nearest centroid, from (row, v, cluster, distance)."""
    every = np.arange(len(centroids))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(batch.num_rows, -1)
                cluster = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False).astype("i8")
                distance = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
                before = cluster.copy()
                anew = (before < 0) | moved[before]
                cluster[anew] = -1
                for rows, those in ((np.flatnonzero(anew), every), (np.flatnonzero(~anew), np.flatnonzero(moved))):
                    c, d = cluster[rows], distance[rows]
                    _nearest(v[rows], centroids, those, c, d)
                    cluster[rows], distance[rows] = c, d
                gone = cluster != before
                lengths = np.where(gone, v.shape[1], 0)
                carried = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("i4")), pa.array(v[gone].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype("i4")), pa.array(distance), pa.array(before.astype("i4"), mask=~gone), carried], names=["row", "cluster", "distance", "before", "v"])

    return run


def delta_lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", buckets: int | None = None) -> tuple[DataFrame, DataFrame, list[tuple[int, ...]]]:
    """(owners, vectors, centroids): owners (row, cluster, distance) and vectors (row, id, v), bucketed alike by row.

    ``vectors`` is as ``integer_vectors`` gives it. Centroids start as the ``k`` vectors of the smallest hash of
    ``salt`` and id (null ids last; rows of one id by their components), each row counting, repeated ones as well; with
    fewer vectors than ``k`` there are as many centroids. After each of ``rounds`` assignments centroids with vectors
    become their floored mean; then vectors are assigned once more. If no centroid moves, later rounds can't change
    anything and are left out. No vectors, no rows. The driver holds k centroids, sums and counts.
    """
    spark = vectors.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = _bucketed(vectors.repartition(buckets, "row"), "vectors", buckets)
    first = kept.orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], "i8").reshape(len(first), len(first[0].v) if first else 0)
    sums, counts = [[0] * centroids.shape[1] for _ in first], [0] * len(first)
    moved, owners, width = np.ones(len(first), bool), None, centroids.shape[1]
    for last in [False] * rounds + [True]:
        if not moved.any():
            break
        met = kept.select("row", "v", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")) if owners is None else kept.select("row", "v").hint("merge").join(owners, "row")
        written = _bucketed(met.mapInArrow(_compare(centroids, moved), "row long, cluster int, distance long, before int, v array<long>"), "owners", buckets)
        owners = written.select("row", "cluster", "distance")
        if last:
            break
        changed = written.where(F.size("v") > 0)  # minus for the old owner, of which there is none at first
        signed = changed.select("v", F.explode(F.array(F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign")), F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")))).alias("t")).where("t.c >= 0")
        transfers = signed.groupBy("t.c").agg(F.sum("t.sign").alias("n"), *(F.sum((F.col("t.sign") * F.col("v")[i]).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)))
        for r in transfers.collect():  # at most k rows
            counts[r.c] += r.n
            sums[r.c] = [s + int(r[f"s{i}"]) for i, s in enumerate(sums[r.c])]
        now = np.array([[s // n for s in sums[c]] if (n := counts[c]) else list(centroids[c]) for c in range(len(first))], "i8").reshape(centroids.shape)
        moved, centroids = (now != centroids).any(axis=1), now
    if owners is None:
        owners = kept.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return owners, kept, [tuple(map(int, c)) for c in centroids]


def clustered(df: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", size: int = 64, scale: int = 1024, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    A row whose vector is null, of another length, or has a null or non-finite component is left out; components
    beyond ``LIMIT`` after scaling count as that. Repeated rows each come back. Columns other than ``key`` and
    ``column`` are ignored, whatever their names.
    """
    spark = df.sparkSession
    owners, kept, centroids = delta_lloyd(integer_vectors(df, column, key, size, scale), k, rounds, salt)
    spread = {r.cluster: int(r.d) for r in owners.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # at most k rows
    hashed = [(c, spread.get(c, 0), sum(spread.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    by_cluster = spark.createDataFrame(hashed, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return kept.select("row", F.col("id").alias("vec_id")).hint("merge").join(owners, "row").join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of every vector of ``embeddings``."""
    return clustered(table(spark, sf_dir, "embeddings"))
