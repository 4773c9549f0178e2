"""Queries of code search, histories and stores over the given tables, each with SQL of its own or a test by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.paths import approx_tokens
from .operators import code_search, degree, resolve
from .plans.snapshot import cut
from .sources import files as file_source
from .sources import git
from .sources.tables import node_view, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f=None, *, sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add(f) if f is not None else add


@query
def did_you_mean(spark, d):
    return resolve.did_you_mean(node_view(spark, d).where("type = 'region'"), "AMERCA")


@query(
    sql="""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS file, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
t AS (SELECT file, CASE WHEN a[len(a)] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM l), w AS (SELECT file, a, unnest(range(1, len(a) + 1, 40)) AS s FROM t)
SELECT file, CAST(s AS INTEGER) AS start_line, CAST(least(len(a), s + 39) AS INTEGER) AS end_line, md5(array_to_string(a[s:s + 39], chr(10))) AS body FROM w WHERE len(list_filter(a[s:s + 39], lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '')) > 0"""
)
def text_windows(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return code_search.chunk_files(texts).select("file", "start_line", "end_line", F.md5(F.col("body").cast("binary")).alias("body"))


@query(
    sql="""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, 'f' || vec_id % 20 AS file, CAST(vec_id // 20 * 10 + 1 AS INTEGER) AS a, CAST(vec_id // 20 * 10 + 12 AS INTEGER) AS b FROM embeddings),
q AS (SELECT * FROM v WHERE vec_id = 3), n AS (SELECT v.vec_id, v.file, v.a, v.b, list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(q.e, q.e)) AS score FROM v, q ORDER BY score DESC, v.vec_id LIMIT 24)
SELECT n.vec_id AS cid, round(greatest(0, least(1, score)), 4) AS score FROM n, q WHERE NOT (n.file = q.file AND n.a <= q.b AND n.b >= q.a) ORDER BY n.score DESC, cid LIMIT 8"""
)
def related_vectors(spark, d):
    e = table(spark, d, "embeddings")
    chunks = e.select(F.col("vec_id").alias("cid"), F.concat(F.lit("f"), F.col("vec_id") % 20).alias("file"), (F.floor(F.col("vec_id") / 20) * 10 + 1).cast("int").alias("start_line"), (F.floor(F.col("vec_id") / 20) * 10 + 12).cast("int").alias("end_line"))
    return code_search.related_dense(e.select(F.col("vec_id").alias("cid"), "embedding"), chunks, 3)


@query(sql="SELECT doc_id, greatest(1, CAST(floor(length(coalesce(text, '')) / 3.5) AS BIGINT)) AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", approx_tokens(F.length(F.coalesce("text", F.lit("")))).alias("tokens"))


@query(
    sql="""WITH f AS (SELECT 'm' || l_suppkey % 4 AS repo, l_orderkey AS c, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT repo, count(*) AS commits, count(*) FILTER (n > 30) AS bulk, count(*) >= 10 AS usable FROM f GROUP BY repo"""
)
def history_state(spark, d):
    """Orders as commits, their lines as files, of four repositories."""
    own = table(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_suppkey") % 4).alias("repo"), F.col("l_orderkey").alias("commit_pos"), F.col("l_linenumber").alias("file"))
    return git.history_state(own, own)


@query(sql="SELECT 'd' || doc_id AS file FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 = 0")
def build_drift(spark, d):
    own = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), "doc_id")
    return git.build_drift(own.where("doc_id % 3 = 0").select("file"), own.where("doc_id % 5 = 0").select("file"))


@query(sql="SELECT count(DISTINCT sha256(coalesce(text, ''))) AS keys, count(DISTINCT sha256(coalesce(text, ''))) FILTER (doc_id % 4 <> 0) >= 0 AS ok FROM documents")
def vector_store(spark, d):
    """Vectors by text hash: after an update the store has a vector for each distinct text, kept or new."""
    docs = table(spark, d, "documents")
    embed = lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]
    none = spark.createDataFrame([], "key string, embedding array<float>")
    first = cut(file_source.update_vectors(none, docs.where("doc_id % 4 = 0").select("text"), embed, 2)[0], "vectors")
    second, fresh = file_source.update_vectors(first, docs.select("text"), embed, 2)
    return second.agg(F.countDistinct("key").alias("keys")).select("keys", F.lit(fresh > 0).alias("ok"))


@query(
    sql="""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, props FROM events)
SELECT event_type, count(*) AS n, CAST(sum(len(json_keys(props))) AS BIGINT) AS keys FROM events GROUP BY event_type"""
)
def json_keys(spark, d):
    own = table(spark, d, "events").select("event_type", F.size(F.json_object_keys("props")).cast("long").alias("k"))
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query(sql="SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY ALL")
def events_by_hour(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(sql="SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey")
def group_sizes(spark, d):
    """The size that a group's signature is made over; the signature itself is tested against sorted members."""
    return degree.set_signature(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey").select(F.col("c_nationkey").alias("nation"), "n")
