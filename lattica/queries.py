"""The graph engine's queries by name, and the DuckDB SQL with the same rows.

Each query applies one operator to the graph view of the tables (``sources.tables``), or to tables that have the
operator's shape. A query without SQL is one that SQL can't express; its tests compare it with brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import communities, cycles, degree, hierarchy, maintain, names, nearest, resolve, review, scope, search, segments, simjoin, spans, traverse
from .plans.snapshot import cut, shared_dir
from .sources import graph_json
from .sources.tables import NEXT_PART_SQL, VIEW_SQL, edge_view, graph_view, kept, next_part_edges, node_view, table
from .streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_DEGREES = """, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges),
deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)"""
_SPEC = "-tests, !geo/ASIA, geo, catalog/*, orders/F"
_REASON = """, judged AS (SELECT *, CASE WHEN starts_with(file, 'vendor/') THEN 'vendored' WHEN external THEN 'external' WHEN starts_with(file, 'tests/') THEN 'tests'
  WHEN NOT (starts_with(file, 'geo/') OR starts_with(file, 'catalog/') OR file = 'orders/F') OR file = 'geo/ASIA' OR starts_with(file, 'geo/ASIA/') THEN 'filtered' END AS reason FROM nodes)"""


def query(sql: str | None = None, view: bool = True):
    """Registers a query under its function's name; ``sql`` follows the graph view's WITH clause if ``view``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (VIEW_SQL if view else "") + sql
        return f

    return add


# Counts ---------------------------------------------------------------------------------------------------------


@query(_DEGREES + "SELECT t.id, degree, label, type FROM (SELECT * FROM deg ORDER BY degree DESC, id LIMIT 10) t LEFT JOIN nodes USING (id)")
def god_nodes(spark, d):
    return degree.god_nodes(*graph_view(spark, d))


@query(_DEGREES + "SELECT id, degree FROM deg")
def degrees(spark, d):
    return degree.degrees(edge_view(spark, d))


@query("SELECT * FROM (SELECT count(*) AS n_nodes, count(DISTINCT community) AS n_communities, count(*) - count(DISTINCT id) AS id_collisions FROM nodes), (SELECT count(*) AS n_edges, count(DISTINCT relation) AS n_relations FROM edges)")
def overview(spark, d):
    return degree.overview(*graph_view(spark, d))


@query("SELECT relation, confidence, count(*) AS n FROM edges GROUP BY ALL")
def relation_tally(spark, d):
    return degree.relation_tally(edge_view(spark, d))


@query("SELECT type, count(*) AS n, count(DISTINCT file) AS n_files FROM nodes GROUP BY ALL")
def node_tally(spark, d):
    return degree.node_tally(node_view(spark, d))


@query("SELECT * FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)")
def dangling_edges(spark, d):
    return degree.dangling(*graph_view(spark, d)).select("pos", "src", "dst", "relation", "confidence")


@query(
    _DEGREES
    + """SELECT * FROM (SELECT count(*) FILTER (src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)) AS dangling,
  count(*) FILTER (src = dst AND relation NOT IN ('calls', 'indirect_call')) AS self_loops, count(*) FILTER (src = dst AND relation IN ('calls', 'indirect_call')) AS recursive FROM edges),
(SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM edges GROUP BY src, dst, relation)),
(SELECT count(DISTINCT id) AS orphans FROM nodes WHERE id NOT IN (SELECT id FROM deg))"""
)
def validate(spark, d):
    return degree.validate(*graph_view(spark, d))


@query("SELECT id, label, type, file FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE relation <> 'contains' UNION ALL SELECT dst FROM edges WHERE relation <> 'contains')")
def orphans(spark, d):
    """Of the dependencies only: regions, nations and customers without orders have none."""
    nodes, edges = graph_view(spark, d)
    return degree.orphans(nodes, edges.where("relation <> 'contains'")).select("id", "label", "type", "file")


@query("SELECT src, dst, relation, count(*) AS n FROM edges GROUP BY ALL HAVING count(*) > 1")
def duplicate_edges(spark, d):
    return degree.duplicate_edges(edge_view(spark, d))


@query(
    _DEGREES
    + """SELECT community, size, rank, id, degree FROM (
  SELECT community, id, coalesce(degree, 0) AS degree, count(*) OVER (PARTITION BY community) AS size, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS rank
  FROM nodes LEFT JOIN deg USING (id) WHERE community IS NOT NULL) WHERE rank <= 3"""
)
def community_sizes(spark, d):
    return degree.community_sizes(*graph_view(spark, d))


@query(_DEGREES + "SELECT CAST(greatest(20, min(degree)) AS BIGINT) AS cut FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM deg) WHERE i >= floor(n * 0.99)")
def degree_cut(spark, d):
    return degree.degree_cut(edge_view(spark, d))


@query(
    """, f AS (SELECT id, file, string_split(file, '/')[:-2] AS dirs FROM nodes),
m AS (SELECT e.src, e.dst, a.dirs AS a, b.dirs AS b, CASE WHEN len(a.dirs) = 0 OR len(b.dirs) = 0 OR a.dirs[1] <> b.dirs[1] THEN 0 WHEN a.dirs[2] IS NULL OR b.dirs[2] IS NULL OR a.dirs[2] <> b.dirs[2] THEN 1 WHEN a.dirs[3] IS NULL OR b.dirs[3] IS NULL OR a.dirs[3] <> b.dirs[3] THEN 2 ELSE 3 END AS k
  FROM edges e JOIN f a ON e.src = a.id JOIN f b ON e.dst = b.id)
SELECT array_to_string(a[1:k + 1], '/') AS from_dir, array_to_string(b[1:k + 1], '/') AS to_dir, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM m WHERE len(a) > k AND len(b) > k GROUP BY ALL"""
)
def directory_pairs(spark, d):
    return degree.directory_pairs(*graph_view(spark, d))


@query()
def community_signatures(spark, d):
    """No SQL: the signature sums 64-bit hashes that DuckDB hasn't."""
    return degree.set_signature(node_view(spark, d).where("community is not null"), "community", "id")


def _maintained(spark, d):
    """The graph after four batches of its edges, each followed by one in which a fifth of it goes again."""
    nodes, edges = graph_view(spark, d)
    graph = maintain.MaintainedGraph(spark, f"{shared_dir(spark)}/maintained-{uuid.uuid4().hex}", nodes)
    batch, leaves = F.pmod(F.xxhash64("pos", "dst"), F.lit(4)), F.pmod("pos", F.lit(5)) == 0
    for k in range(5):
        graph.apply(edges.where((batch == k) | ((batch == k - 1) & leaves)).select("src", "dst", "relation", F.when(batch == k, 1).otherwise(-1).alias("n")))
    return graph


_STAYING = ", kept AS (SELECT * FROM edges WHERE pos % 5 <> 0), ends AS (SELECT src AS id FROM kept UNION ALL SELECT dst FROM kept) "


@query(_STAYING + "SELECT id, count(*) AS degree FROM ends GROUP BY id")
def maintained_degrees(spark, d):
    return _maintained(spark, d).degrees()


@query(
    _STAYING
    + """SELECT * FROM (SELECT count(*) FILTER (src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)) AS dangling,
  count(*) FILTER (src = dst AND relation NOT IN ('calls', 'indirect_call')) AS self_loops, count(*) FILTER (src = dst AND relation IN ('calls', 'indirect_call')) AS recursive FROM kept),
(SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM kept GROUP BY src, dst, relation)),
(SELECT count(DISTINCT id) AS orphans FROM nodes WHERE id NOT IN (SELECT id FROM ends))"""
)
def maintained_lint(spark, d):
    return _maintained(spark, d).validated()


# Scope ----------------------------------------------------------------------------------------------------------


@query(_REASON + "SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason")
def scope_left_out(spark, d):
    return scope.scoped(*graph_view(spark, d), _SPEC).left_out()


@query(_REASON + "SELECT id, type, file FROM judged WHERE reason IS NULL")
def scope_nodes(spark, d):
    return scope.scoped(*graph_view(spark, d), _SPEC).nodes.select("id", "type", "file")


@query(_REASON + "SELECT src, dst, relation FROM edges WHERE src NOT IN (SELECT id FROM judged WHERE reason IS NOT NULL) AND dst NOT IN (SELECT id FROM judged WHERE reason IS NOT NULL)")
def scope_edges(spark, d):
    return scope.scoped(*graph_view(spark, d), _SPEC).edges.select("src", "dst", "relation")


@query("SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM nodes WHERE starts_with(file, 'vendor/') GROUP BY dir ORDER BY n DESC, dir LIMIT 3")
def vendored_dirs(spark, d):
    return scope.scoped(*graph_view(spark, d), None).vendored_dirs()


@query("SELECT src, dst, relation FROM edges WHERE confidence = 'EXTRACTED'")
def strict_edges(spark, d):
    return scope.strict(edge_view(spark, d)).select("src", "dst", "relation")


@query("SELECT relation, count(*) AS n FROM edges WHERE relation IN ('references', 'calls') GROUP BY relation")
def relation_filter(spark, d):
    return scope.of_relations(edge_view(spark, d), "types, code").groupBy("relation").agg(F.count("*").alias("n"))


@query(_DEGREES + ", h AS (SELECT * FROM nodes WHERE contains(lower(label), 'order 12') OR contains(lower(id), 'order 12')) SELECT id, label, type, coalesce(degree, 0) AS degree, (SELECT count(*) FROM h) AS total FROM (SELECT * FROM h ORDER BY pos LIMIT 50) LEFT JOIN deg USING (id)")
def search_nodes(spark, d):
    return scope.search_nodes(*graph_view(spark, d), "order 12")


# Names ----------------------------------------------------------------------------------------------------------


@query(", n AS (SELECT id AS name, id, pos FROM nodes UNION ALL SELECT label, id, pos FROM nodes) SELECT name, arg_min(id, (pos, id)) AS id FROM n GROUP BY name")
def exact_index(spark, d):
    return resolve.exact_index(node_view(spark, d))


@query("SELECT id, label, type FROM nodes WHERE label = 'small ring' OR label = 'small ring'")
def by_name(spark, d):
    return resolve.by_name(node_view(spark, d), "small ring").select("id", "label", "type")


@query(", h AS (SELECT * FROM nodes WHERE contains(lower(label), 'widget')) SELECT id, label, (SELECT count(*) FROM h) AS total FROM (SELECT * FROM h ORDER BY pos LIMIT 6)")
def substring_matches(spark, d):
    return resolve.substring_matches(node_view(spark, d), "Widget").select("id", "label", "total")


@query()
def close_matches(spark, d):
    """No SQL: similarity by longest matching blocks."""
    return resolve.close_matches(node_view(spark, d).where("type = 'part'"), "smal rings")


@query()
def similar_client_names(spark, d):
    """Names of clients that are spelled alike. No SQL: the ratio of longest matching blocks; a test compares all pairs."""
    clients = table(spark, d, "clients").select("name")
    return names.similar_names(clients, clients, 0.9, ordered=True).select("a", "b", F.round("ratio", 9).alias("ratio"))


@query(", h AS (SELECT * FROM nodes WHERE label = 'red widget') SELECT arg_min(id, pos) AS id, 'label' AS how, count(*) - 1 AS others FROM h HAVING count(*) > 0")
def pick_node(spark, d):
    return resolve.pick(node_view(spark, d), "red widget")


@query("SELECT id, label, type, file, n_out, n_in, n_relations FROM nodes, (SELECT count(*) FILTER (src = 'c1') AS n_out, count(*) FILTER (dst = 'c1') AS n_in, count(DISTINCT relation) AS n_relations FROM edges WHERE src = 'c1' OR dst = 'c1') WHERE id = 'c1'")
def node_details(spark, d):
    return resolve.node_details(*graph_view(spark, d), "c1").select("id", "label", "type", "file", "n_out", "n_in", "n_relations")


@query("SELECT a.file AS src_file, b.file AS dst_file, count(*) AS n FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE relation IN ('calls', 'references') AND a.file <> b.file GROUP BY ALL")
def file_edges(spark, d):
    return resolve.file_edges(*graph_view(spark, d), ("calls", "references"))


@query("SELECT DISTINCT least(a.file, b.file) AS a, greatest(a.file, b.file) AS b FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE relation <> 'contains' AND a.file <> b.file")
def linked_files(spark, d):
    return resolve.linked_files(*graph_view(spark, d))


def _state_edges(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), "user_id").alias("src"), F.concat(F.lit("t"), "event_type", F.lit("-"), F.col("event_id") % 7).alias("dst"), F.when(F.col("value") > 150, "writes").otherwise("reads").alias("relation"))


_STATE = "WITH edges AS (SELECT event_id AS pos, 'u' || user_id AS src, 't' || event_type || '-' || event_id % 7 AS dst, CASE WHEN value > 150 THEN 'writes' ELSE 'reads' END AS relation FROM events), touch AS (SELECT src AS definition, dst AS state, bool_or(relation = 'writes') AS writes, bool_or(relation = 'reads') AS reads FROM edges GROUP BY ALL) "


@query(_STATE + "SELECT * FROM touch", view=False)
def state_touches(spark, d):
    return resolve.touches(_state_edges(spark, d))


@query(
    _STATE
    + """SELECT o.state, o.definition, CASE WHEN m.writes AND o.writes THEN 'both_write' WHEN m.writes THEN 'reads_mine' ELSE 'writes_mine' END AS effect
FROM touch o JOIN touch m ON o.state = m.state AND m.definition = 'u1' AND o.definition <> 'u1' WHERE m.writes OR o.writes ORDER BY o.state, o.definition LIMIT 15""",
    view=False,
)
def state_neighbours(spark, d):
    return resolve.state_neighbours(_state_edges(spark, d), "u1")


@query(_STATE + "SELECT relation, count(*) AS n FROM (SELECT relation FROM edges UNION ALL SELECT 'written_by' FROM edges WHERE relation = 'writes') GROUP BY relation", view=False)
def written_by(spark, d):
    return resolve.with_written_by(_state_edges(spark, d)).groupBy("relation").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT src AS owner, dst AS member FROM edges WHERE relation = 'contains'")
def members(spark, d):
    return resolve.members(edge_view(spark, d))


@query("SELECT src, dst, relation, min(pos) AS pos, arg_min(confidence, CASE confidence WHEN 'EXTRACTED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END) AS confidence, count(*) AS n FROM edges GROUP BY src, dst, relation")
def merge_edges(spark, d):
    return resolve.merge_edges(edge_view(spark, d))


@query("SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1", view=False)
def dedupe_first(spark, d):
    return resolve.first_by(table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))


def _urls(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(F.col("page_id").cast("string").alias("call"), F.lit(None).cast("string").alias("method"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(url, "://([^/?#]*)", 1).alias("file"))


_ROUTES = [("any", "ANY", "/{}/{}", "x"), ("english", "GET", "/en/{}", "y"), ("one", "GET", "/en/474", "z"), ("other", "POST", "/fr/{}/{}", "z")]


@query(
    """WITH c AS (SELECT CAST(page_id AS VARCHAR) AS call, string_split(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^/|/$', '', 'g'), '/') AS s FROM pages),
m AS (SELECT call, 'any' AS route, 0 AS score FROM c WHERE len(s) = 2 UNION ALL SELECT call, 'english', 2 FROM c WHERE len(s) = 2 AND s[1] = 'en' UNION ALL SELECT call, 'one', 4 FROM c WHERE len(s) = 2 AND s[1] = 'en' AND s[2] = '474' UNION ALL SELECT call, 'other', 2 FROM c WHERE len(s) = 3 AND s[1] = 'fr')
SELECT call, route, score, 'INFERRED' AS confidence FROM (SELECT *, rank() OVER (PARTITION BY call ORDER BY score DESC) AS r FROM m) WHERE r = 1""",
    view=False,
)
def link_calls(spark, d):
    routes = spark.createDataFrame(_ROUTES, "route string, verb string, pattern string, route_file string")
    return spans.link_calls(_urls(spark, d), routes)


_REQUESTS = ("{url}", "http://localhost:8000{path}?q=1", "${{base}}{path}#top", "{path}", "${{base}}", "${{host}}x{path}", "https://127.0.0.1", "{{api}}/v{n}{path}")


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT CAST(page_id AS VARCHAR) AS call, CASE page_id % 8 WHEN 0 THEN 'external' WHEN 4 THEN 'dynamic' WHEN 5 THEN 'dynamic' ELSE 'path' END AS kind,
  CASE page_id % 8 WHEN 1 THEN path WHEN 2 THEN path WHEN 3 THEN path WHEN 6 THEN '/' WHEN 7 THEN '/v' || page_id || path END AS path, page_id % 8 IN (2, 7) AS guessed FROM p""",
    view=False,
)
def request_paths(spark, d):
    """Requests of all kinds, made of the pages' URLs."""
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    made = [F.lit("")] * len(_REQUESTS)
    for k, form in enumerate(_REQUESTS):
        parts = [F.col("url") if x == "url" else path if x == "path" else F.col("page_id").cast("string") if x == "n" else F.lit(x[1:]) for x in _pieces(form)]
        made[k] = F.concat(*parts)
    url = F.element_at(F.array(*made), (F.col("page_id") % len(made) + 1).cast("int"))
    r = spans.request_path(url)
    return table(spark, d, "pages").select(F.col("page_id").cast("string").alias("call"), r["kind"].alias("kind"), r["path"].alias("path"), r["guessed"].alias("guessed"))


def _pieces(form):
    """The fields of a format string by name, and its literals after a ``=``."""
    import string

    for literal, name, _, _ in string.Formatter().parse(form):
        if literal:
            yield "=" + literal
        if name:
            yield name


# Walks ----------------------------------------------------------------------------------------------------------

_BOTH = ", both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(", h AS (SELECT 'r0' AS id, 0 AS distance UNION SELECT dst, distance + 1 FROM h JOIN edges ON src = id WHERE distance < 3) SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM h GROUP BY id")
def hop_distances(spark, d):
    return traverse.hop_distances(edge_view(spark, d), _seed(spark, "r0"), 3)


@query(_BOTH + ", h AS (SELECT 's1' AS id, 0 AS distance UNION SELECT b, distance + 1 FROM h JOIN both_ways ON a = id WHERE distance < 2) SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM h GROUP BY id")
def hop_distances_both(spark, d):
    return traverse.hop_distances(edge_view(spark, d), _seed(spark, "s1"), 2, "both")


@query(
    """, e AS (SELECT src, dst, pos, relation FROM edges WHERE relation = 'contains'),
h AS (SELECT 'r0' AS id, 0 AS distance, CAST(NULL AS VARCHAR) AS via, CAST(NULL AS VARCHAR) AS relation UNION ALL SELECT e.dst, h.distance + 1, h.id, e.relation FROM h JOIN e ON e.src = h.id WHERE h.distance < 3)
SELECT id, CAST(distance AS INTEGER) AS distance, via, relation FROM h"""
)
def hop_records(spark, d):
    """Over containment, a tree, in which the discovering edge is the only one; tests have other graphs."""
    e = edge_view(spark, d).where("relation = 'contains'")
    return traverse.hop_records(e, spark.createDataFrame([("r0", 0)], "id string, rank long"), 3).select("id", "distance", "via", "relation")


@query(", t AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 7) SELECT CAST(0 AS BIGINT) AS step, 'r' || r AS id FROM t UNION ALL SELECT 1, 'n' || n FROM t UNION ALL SELECT 2, 'c7' FROM t")
def shortest_path(spark, d):
    region = table(spark, d, "customer").where("c_custkey = 7").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first().n_regionkey
    return traverse.shortest_path(edge_view(spark, d), f"r{region}", "c7", 4)


@query(", h AS (SELECT 'r0' AS id, 0 AS distance UNION SELECT dst, distance + 1 FROM h JOIN edges ON src = id WHERE distance < 2) SELECT count(DISTINCT dst) AS beyond FROM edges WHERE src IN (SELECT id FROM h) AND dst NOT IN (SELECT id FROM h)")
def beyond_hops(spark, d):
    e = edge_view(spark, d)
    return traverse.beyond(e, traverse.hop_distances(e, _seed(spark, "r0"), 2))


_NEIGHBOURS = ", near AS (SELECT dst AS id, relation, 'out' AS direction FROM edges WHERE src = 's1' UNION SELECT src, relation, 'in' FROM edges WHERE dst = 's1')"


@query(_DEGREES + _NEIGHBOURS + "SELECT id, relation, direction, degree, coalesce(starts_with(file, 'tests/'), false) AS test FROM near JOIN deg USING (id) LEFT JOIN nodes USING (id) ORDER BY test, degree DESC, id, relation, direction LIMIT 200")
def neighbours(spark, d):
    return traverse.neighbours(*graph_view(spark, d), "s1")


@query(_NEIGHBOURS + "SELECT relation, direction, count(*) AS n FROM near GROUP BY ALL")
def neighbour_tally(spark, d):
    return traverse.neighbour_tally(edge_view(spark, d), "s1")


@query(
    _BOTH
    + """, h AS (SELECT 'c1' AS id, 0 AS distance UNION SELECT b, distance + 1 FROM h JOIN both_ways ON a = id WHERE distance < 2),
dist AS (SELECT id, min(distance) AS distance FROM h GROUP BY id),
m AS (SELECT arg_min({'src': src, 'dst': dst}, pos) AS e, relation, min(least(a.distance, b.distance)) AS distance FROM edges JOIN dist a ON src = a.id JOIN dist b ON dst = b.id WHERE least(a.distance, b.distance) < 2 GROUP BY least(src, dst), greatest(src, dst), relation),
r AS (SELECT e.src AS src, e.dst AS dst, relation, CAST(distance AS INTEGER) AS distance, length(e.src) + length(e.dst) + length(relation) + 42 AS s FROM m)
SELECT src, dst, relation, distance FROM (SELECT *, 98 + sum(s) OVER w - s AS before, row_number() OVER w AS n FROM r WINDOW w AS (ORDER BY distance, src, dst, relation)) WHERE n = 1 OR before / 3.5 < 1500"""
)
def subgraph(spark, d):
    return traverse.subgraph(*graph_view(spark, d), "c1")


_CARRIED = ", carried AS (SELECT src, dst FROM edges WHERE relation IN ('calls', 'references')), own AS (SELECT 'n1' AS id UNION SELECT dst FROM edges WHERE src = 'n1' AND relation = 'contains')"
_IMPACT = (
    _DEGREES
    + _CARRIED
    + """, hin AS (SELECT id, 0 AS distance FROM own UNION SELECT src, distance + 1 FROM hin JOIN carried ON dst = id WHERE distance < 3),
hout AS (SELECT id, 0 AS distance FROM own UNION SELECT dst, distance + 1 FROM hout JOIN carried ON src = id WHERE distance < 3),
hits AS (SELECT id, min(distance) AS distance, 'in' AS direction FROM hin GROUP BY id UNION ALL SELECT id, min(distance), 'out' FROM hout GROUP BY id),
best AS (SELECT id, min((distance, direction)) AS b FROM hits WHERE distance > 0 GROUP BY id),
rows AS (SELECT id, CAST(b[1] AS INTEGER) AS distance, b[2] AS direction, coalesce(degree, 0) AS degree, coalesce(starts_with(file, 'tests/'), false) AS test, coalesce(label, id) AS label FROM best LEFT JOIN deg USING (id) LEFT JOIN nodes USING (id))
"""
)


@query(_IMPACT + "SELECT * FROM rows")
def impact(spark, d):
    return traverse.impact(*graph_view(spark, d), "n1", "both")


@query(_IMPACT + "SELECT id, distance, direction, degree, test, label FROM (SELECT *, sum(length(id) + length(label) + 62) OVER w AS s, row_number() OVER w AS n FROM rows WINDOW w AS (ORDER BY distance, test, degree DESC, label, id)) WHERE n = 1 OR (98 + s) / 3.5 < 1500")
def impact_budget(spark, d):
    return traverse.impact(*graph_view(spark, d), "n1", "both", budget=1500)


@query(
    """, e AS (SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE relation = 'references'), t AS (SELECT id, starts_with(file, 'tests/') AS test FROM nodes),
callers AS (SELECT DISTINCT e.src AS id, test FROM e JOIN t ON e.src = t.id WHERE e.dst = 's1'),
calls_in AS (SELECT DISTINCT e.src AS id FROM e JOIN callers c ON e.dst = c.id AND NOT c.test JOIN t ON e.src = t.id AND t.test WHERE e.src <> 's1')
SELECT id, 'direct' AS tier FROM callers WHERE test UNION ALL SELECT id, 'through' FROM calls_in WHERE id NOT IN (SELECT id FROM callers WHERE test)"""
)
def tests_for(spark, d):
    nodes, edges = graph_view(spark, d)
    turned = edges.where("relation = 'references'").select("pos", F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "confidence")
    return traverse.tests_for(nodes, turned, "s1")


@query(", h AS (SELECT src, dst, 1 AS distance FROM edges WHERE relation = 'contains' UNION SELECT h.src, e.dst, distance + 1 FROM h JOIN edges e ON e.src = h.dst AND e.relation = 'contains' WHERE distance < 3) SELECT src, dst, CAST(min(distance) AS INTEGER) AS distance FROM h GROUP BY src, dst")
def containment_closure(spark, d):
    return traverse.closure(edge_view(spark, d).where("relation = 'contains'"), 3)


_FOREST = """, tree AS (SELECT id, CAST(NULL AS VARCHAR) AS parent, [id] AS path FROM nodes WHERE type = 'region' UNION ALL SELECT e.dst, e.src, list_append(path, e.dst) FROM tree JOIN edges e ON e.src = tree.id AND e.relation = 'contains'),
up AS (SELECT unnest(path) AS top, id, len(path) AS depth FROM tree)"""


@query(_FOREST + "SELECT tree.id, parent, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) - 1 AS pre, size FROM tree JOIN (SELECT top, count(*) AS size FROM up GROUP BY top) ON top = tree.id")
def containment_labels(spark, d):
    return hierarchy.labels(edge_view(spark, d).where("relation = 'contains'"))


@query(_FOREST + "SELECT top, up.id, up.depth - len(path) AS distance FROM up JOIN tree ON top = tree.id WHERE top <> up.id AND (starts_with(top, 'r') OR starts_with(top, 'n'))")
def below_places(spark, d):
    """What regions and nations contain, at any depth, by interval labels."""
    found = hierarchy.labels(edge_view(spark, d).where("relation = 'contains'"))
    return hierarchy.below(cut(found, "labels"), node_view(spark, d).where("type in ('region', 'nation')"))


# Cycles ---------------------------------------------------------------------------------------------------------

_NEXT = "WITH RECURSIVE " + NEXT_PART_SQL
_SCC = (
    _NEXT
    + """, e AS (SELECT DISTINCT src, dst FROM next_part WHERE src <> dst),
reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src),
scc AS (SELECT a.src AS id, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) > 1)"""
)


@query(_SCC + "SELECT id, component FROM scc", view=False)
def strong_components(spark, d):
    return cycles.strong_components(next_part_edges(spark, d))


@query(_SCC + ", sizes AS (SELECT component, count(*) AS size FROM scc GROUP BY component) SELECT component, any_value(size) AS size, count(*) AS edges FROM e JOIN scc a ON e.src = a.id JOIN scc b ON e.dst = b.id AND a.component = b.component JOIN sizes s ON s.component = a.component GROUP BY a.component".replace("SELECT component, any_value", "SELECT a.component AS component, any_value"), view=False)
def cycle_groups(spark, d):
    return cycles.cycle_groups(next_part_edges(spark, d))


@query(_NEXT + "SELECT src AS id, count(*) AS n FROM next_part WHERE src = dst GROUP BY src", view=False)
def self_loops(spark, d):
    return cycles.self_loops(next_part_edges(spark, d))


@query()
def cycle_path(spark, d):
    """No SQL: which of several shortest loops is found depends on the walk's order."""
    edges = next_part_edges(spark, d)
    groups = cycles.strong_components(edges)
    first = groups.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
    if first is None:
        return spark.createDataFrame([], "step long, id string")
    return cycles.cycle_path(edges, groups.where(F.col("component") == first.component), first.component)


@query()
def tiered_cycles(spark, d):
    """No SQL: signatures of member sets are sums of hashes."""
    e = next_part_edges(spark, d).withColumn("runs", F.when(F.col("pos") % 3 == 0, "deferred").when(F.col("pos") % 7 == 0, "type-checking").otherwise("module-level"))
    return cycles.tiered_cycles(e).select("tier", "component", "size", "signature")


# Reviews --------------------------------------------------------------------------------------------------------


@query("SELECT id, type, file FROM nodes WHERE id NOT IN (SELECT dst FROM edges WHERE relation <> 'contains' AND src <> dst)")
def unreferenced(spark, d):
    return review.unreferenced(*graph_view(spark, d)).select("id", "type", "file")


_WORDS = ("the", "and", "que", "der", "theaea", "und")


@query(
    """WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(regexp_extract_all(text, '\\.?[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM documents)
SELECT ltrim(w, '.') AS name, file, count(*) AS n, count(*) FILTER (starts_with(w, '.')) AS attributes FROM w WHERE ltrim(w, '.') IN ('the', 'and', 'que', 'der', 'theaea', 'und') GROUP BY ALL""",
    view=False,
)
def count_mentions(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return review.count_mentions(texts, spark.createDataFrame([(w,) for w in _WORDS], "name string"))


@query(", u AS (SELECT dst AS id, count(DISTINCT src) AS k FROM edges WHERE relation = 'imports' GROUP BY dst) SELECT label AS name, '' AS kind, count(DISTINCT file) AS files, count(DISTINCT id) AS definitions, CAST(coalesce(sum(k), 0) AS BIGINT) AS imported_by FROM nodes LEFT JOIN u USING (id) GROUP BY label HAVING count(DISTINCT file) >= 2")
def same_named(spark, d):
    return review.same_named(*graph_view(spark, d))


@query("WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents) SELECT sha1(t) AS fingerprint, count(*) AS copies, min(id) AS first, CAST(max(length(t)) AS BIGINT) AS size FROM b WHERE length(t) >= 1 GROUP BY t HAVING count(*) >= 2", view=False)
def identical_bodies(spark, d):
    return review.identical_bodies(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body")))


_RULES = {"geo": ["catalog"], "geo/ASIA": ["geo"], "orders": ["geo/EUROPE", "catalog/Brand#1"], "catalog": ["*"]}


@query(
    """, fe AS (SELECT DISTINCT a.file AS src_file, b.file AS dst_file FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE relation IN ('calls', 'references') AND a.file <> b.file),
l AS (SELECT *, CASE WHEN starts_with(src_file, 'geo/ASIA/') OR src_file = 'geo/ASIA' THEN 'geo/ASIA' WHEN starts_with(src_file, 'geo/') THEN 'geo' WHEN starts_with(src_file, 'orders/') THEN 'orders' WHEN starts_with(src_file, 'catalog/') THEN 'catalog' END AS from_layer,
  CASE WHEN starts_with(dst_file, 'geo/ASIA/') OR dst_file = 'geo/ASIA' THEN 'geo/ASIA' WHEN starts_with(dst_file, 'geo/') THEN 'geo' WHEN starts_with(dst_file, 'orders/') THEN 'orders' WHEN starts_with(dst_file, 'catalog/') THEN 'catalog' END AS to_layer FROM fe)
SELECT * FROM l WHERE from_layer IS NOT NULL AND to_layer IS NOT NULL AND from_layer <> to_layer AND NOT CASE from_layer WHEN 'geo' THEN starts_with(dst_file, 'catalog/') WHEN 'geo/ASIA' THEN starts_with(dst_file, 'geo/') WHEN 'orders' THEN starts_with(dst_file, 'geo/EUROPE/') OR starts_with(dst_file, 'catalog/Brand#1/') ELSE true END"""
)
def layer_violations(spark, d):
    return review.layer_violations(resolve.file_edges(*graph_view(spark, d), ("calls", "references")), _RULES)


def _commits(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"), F.concat(F.lit("s"), "l_suppkey").alias("file"))


_COCHANGE = """WITH cf AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS c, 's' || l_suppkey AS file FROM lineitem), ok AS (SELECT c FROM cf GROUP BY c HAVING count(*) <= 30), s AS (SELECT * FROM cf WHERE c IN (SELECT c FROM ok)),
revs AS (SELECT file, count(*) AS revs FROM s GROUP BY file),
p AS (SELECT x.file AS a, y.file AS b, count(*) AS shared FROM s x JOIN s y ON x.c = y.c AND x.file < y.file GROUP BY ALL HAVING count(*) >= 3),
pairs AS (SELECT a, b, shared, 2.0::DOUBLE * shared / (ra.revs + rb.revs) AS degree FROM p JOIN revs ra ON a = ra.file JOIN revs rb ON b = rb.file WHERE 2.0::DOUBLE * shared / (ra.revs + rb.revs) >= 0.05),
linked AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT 's' || s_suppkey AS x, 's' || (s_suppkey * 7 + k) % 100 AS y FROM supplier, (SELECT unnest([3, 8, 21, 40]) AS k)) WHERE x <> y)
"""


def _linked(spark, d):
    at = F.explode(F.array(*(F.lit(k) for k in (3, 8, 21, 40)))).alias("k")
    li = table(spark, d, "supplier").select("s_suppkey", at).select(F.concat(F.lit("s"), "s_suppkey").alias("x"), F.concat(F.lit("s"), (F.col("s_suppkey") * 7 + F.col("k")) % 100).alias("y"))
    return li.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@query(_COCHANGE + "SELECT a, b, shared, degree FROM pairs", view=False)
def co_change(spark, d):
    return review.co_change(_commits(spark, d), least_degree=0.05)


@query(_COCHANGE + "SELECT a, b, shared, degree FROM pairs ANTI JOIN linked USING (a, b)", view=False)
def hidden_co_change(spark, d):
    return review.hidden_co_change(review.co_change(_commits(spark, d), least_degree=0.05), _linked(spark, d))


@query(_COCHANGE + "SELECT CASE WHEN p.a = 's1' THEN p.b ELSE p.a END AS partner, shared, degree, l.a IS NOT NULL AS linked FROM pairs p LEFT JOIN linked l ON p.a = l.a AND p.b = l.b WHERE p.a = 's1' OR p.b = 's1' ORDER BY degree DESC, shared DESC, partner LIMIT 5", view=False)
def co_change_partners(spark, d):
    return review.partners(review.co_change(_commits(spark, d), least_degree=0.05), _linked(spark, d), "s1")


@query(
    _STATE
    + """, f AS (SELECT 'u' || user_id AS definition, 'd' || user_id % 5 || '/f' || user_id % 20 AS file, user_id % 3 AS community FROM (SELECT DISTINCT user_id FROM events)),
o AS (SELECT t.*, file, community FROM touch t JOIN f USING (definition))
SELECT w.state, w.definition AS writer, o.definition AS other, CAST(1 + CASE WHEN split_part(w.file, '/', 1) <> split_part(o.file, '/', 1) THEN 2 ELSE 0 END + CASE WHEN w.community IS DISTINCT FROM o.community THEN 1 ELSE 0 END AS BIGINT) AS score
FROM o w JOIN o ON w.state = o.state AND w.writes AND w.file <> o.file AND (NOT o.writes OR w.definition < o.definition)""",
    view=False,
)
def shared_state(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    files = u.select(F.concat(F.lit("u"), "user_id").alias("id"), F.concat(F.lit("d"), F.col("user_id") % 5, F.lit("/f"), F.col("user_id") % 20).alias("file"), (F.col("user_id") % 3).alias("community"))
    return review.shared_state(resolve.touches(_state_edges(spark, d)), files)


def _touching_files(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    return u.select(F.concat(F.lit("u"), "user_id").alias("id"), F.concat(F.lit("d"), F.col("user_id") % 5, F.lit("/f"), F.col("user_id") % 20).alias("file"), (F.col("user_id") % 3).alias("community"))


@query(
    _STATE
    + """, f AS (SELECT 'u' || user_id AS definition, 'd' || user_id % 5 || '/f' || user_id % 20 AS file, user_id % 3 AS community FROM (SELECT DISTINCT user_id FROM events)),
o AS (SELECT t.*, file, community FROM touch t JOIN f USING (definition))
SELECT w.state, w.file AS writer_file, o.file AS other_file, count(*) AS pairs, CAST(max(1 + CASE WHEN split_part(w.file, '/', 1) <> split_part(o.file, '/', 1) THEN 2 ELSE 0 END + CASE WHEN w.community IS DISTINCT FROM o.community THEN 1 ELSE 0 END) AS BIGINT) AS score
FROM o w JOIN o ON w.state = o.state AND w.writes AND w.file <> o.file AND (NOT o.writes OR w.file < o.file) GROUP BY ALL""",
    view=False,
)
def shared_state_files(spark, d):
    return review.shared_state_files(resolve.touches(_state_edges(spark, d)), _touching_files(spark, d))


_SURPRISES = (
    _DEGREES
    + """, n AS (SELECT nodes.*, degree, string_split(file, '/')[:-2] AS dirs FROM nodes LEFT JOIN deg USING (id)),
m AS (SELECT e.*, s.file AS sf, t.file AS tf, s.dirs AS sd, t.dirs AS td, s.community AS sc, t.community AS tc, least(s.degree, t.degree) AS lo, greatest(s.degree, t.degree) AS hi,
  CASE WHEN s.dirs[1] <> t.dirs[1] THEN 0 WHEN s.dirs[2] IS NULL OR t.dirs[2] IS NULL OR s.dirs[2] <> t.dirs[2] THEN 1 WHEN s.dirs[3] IS NULL OR t.dirs[3] IS NULL OR s.dirs[3] <> t.dirs[3] THEN 2 ELSE 3 END AS k
  FROM edges e JOIN n s ON src = s.id JOIN n t ON dst = t.id WHERE relation <> 'contains' AND s.file <> t.file),
x AS (SELECT src, dst, relation, sf, tf, CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN sd[1] <> td[1] THEN 2 WHEN len(sd) + len(td) - 2 * k >= 2 THEN 1 ELSE 0 END
  + CASE WHEN sc <> tc THEN 1 ELSE 0 END + CASE WHEN lo <= 2 AND hi >= 5 AND hi < 60 THEN 1 ELSE 0 END AS score FROM m),
best AS (SELECT src, dst, relation, CAST(max(score) AS BIGINT) AS score FROM x GROUP BY ALL)
"""
)


@query(_SURPRISES + "SELECT *, CASE WHEN score >= 5 THEN 'strong' WHEN score >= 3 THEN 'moderate' ELSE 'weak' END AS strength FROM best")
def surprises(spark, d):
    return review.surprises(*graph_view(spark, d), 60)


@query()
def diverse_surprises(spark, d):
    """No SQL: a greedy pass in which a row that the cap turns away leaves its pair of files free."""
    rows = review.crossings(*graph_view(spark, d), 60)  # copies of an edge fall in the first step of the pass
    return review.diverse(rows.select("src", "dst", "src_file", "dst_file", "score"))


# Positions ------------------------------------------------------------------------------------------------------


def _spans(spark, d):
    o = table(spark, d, "orders")
    start = (F.col("o_orderkey") % 3000).cast("int")
    return o.select(F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("file"), start.alias("region_start"), (start + F.col("o_orderkey") % 97).cast("int").alias("end_line"), (start + 1).alias("def_line"), F.concat(F.lit("o"), "o_orderkey").alias("qualname"))


def _places(spark, d):
    line = (F.col("p_partkey") * 7 % 3100).cast("int")
    return table(spark, d, "part").select(F.col("p_partkey").alias("place"), F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file"), line.alias("line"), (line + F.col("p_size")).alias("end"))


_POSITIONS = """WITH s AS (SELECT 'f' || o_custkey % 50 AS file, o_orderkey % 3000 AS region_start, o_orderkey % 3000 + o_orderkey % 97 AS end_line, o_orderkey % 3000 + 1 AS def_line, 'o' || o_orderkey AS qualname FROM orders),
p AS (SELECT p_partkey AS place, 'f' || p_partkey % 50 AS file, p_partkey * 7 % 3100 AS line, p_partkey * 7 % 3100 + p_size AS "end" FROM part)
"""


@query(_POSITIONS + "SELECT place, qualname FROM p JOIN s ON p.file = s.file AND region_start <= line AND line <= end_line", view=False)
def enclosing_spans(spark, d):
    return spans.enclosing(_spans(spark, d), _places(spark, d)).select("place", "qualname")


@query(_POSITIONS + "SELECT place, qualname FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY end_line - region_start, def_line DESC, qualname) AS r FROM p JOIN s ON p.file = s.file AND region_start <= line AND line <= end_line) WHERE r = 1", view=False)
def innermost_span(spark, d):
    return spans.innermost(_spans(spark, d), _places(spark, d), ["place"]).select("place", "qualname")


@query(
    _POSITIONS
    + """, x AS (SELECT place, (SELECT arg_max(qualname, (def_line, -CAST(substr(qualname, 2) AS BIGINT))) FROM s WHERE s.file = p.file AND def_line <= line) AS b, line, "end", p.file FROM p),
l AS (SELECT x.place, any_value(x.line) AS line, any_value(x."end") AS "end", max(CASE WHEN def_line <= x.line THEN def_line END) AS bl, min(CASE WHEN def_line > x.line THEN def_line END) AS al, any_value(x.file) AS file FROM x LEFT JOIN s ON s.file = x.file GROUP BY x.place)
SELECT place, (SELECT min(qualname) FROM s WHERE s.file = l.file AND def_line = coalesce(bl, al)) AS id, CASE WHEN bl IS NOT NULL THEN 'before' WHEN al <= "end" THEN 'inside' WHEN al IS NOT NULL THEN 'nearest' END AS how FROM l""",
    view=False,
)
def nearest_definition(spark, d):
    defs = _spans(spark, d).select(F.col("qualname").alias("id"), "file", F.col("def_line").alias("line"))
    return spans.nearest_definition(defs, _places(spark, d), ["place"]).select("place", "id", "how")


@query(
    _POSITIONS
    + """SELECT place, cid, overlap FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY exact DESC, overlap DESC, cid) AS r FROM (
SELECT place, qualname AS cid, CAST(least("end", end_line) - greatest(line, region_start) + 1 AS INTEGER) AS overlap, line = region_start AND "end" = end_line AS exact FROM p JOIN s ON p.file = s.file AND least("end", end_line) >= greatest(line, region_start))) WHERE r = 1""",
    view=False,
)
def best_overlap(spark, d):
    chunks = _spans(spark, d).select(F.col("qualname").alias("cid"), "file", F.col("region_start").alias("start_line"), "end_line")
    return spans.best_overlap(chunks, _places(spark, d).withColumnRenamed("line", "start"), ["place"]).select("place", "cid", F.col("overlap").cast("int").alias("overlap"))


# Search ---------------------------------------------------------------------------------------------------------

_TERMS = ["the", "theaea", "ed", "que", "notthere"]


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("cid"), F.col("source").alias("name"), F.concat("lang", F.lit("/"), "source").alias("path"), F.col("text").alias("body"))


def _written_index(spark, d):
    """Postings and lengths of the documents, written once a session."""
    made = lambda k: lambda spark, d: search.index(_chunks(spark, d), search.plain_terms)[k]
    return tuple(kept(spark, d, name, made(k), ("documents",)) for k, name in enumerate(("postings", "lengths")))


_INDEX = """WITH c AS (SELECT doc_id AS cid, source AS name, lang || '/' || source AS path, coalesce(text, '') AS body FROM documents),
w AS (SELECT cid, 'name' AS f, unnest(regexp_extract_all(lower(name), '[a-z]+')) AS term FROM c UNION ALL SELECT cid, 'path', unnest(regexp_extract_all(lower(path), '[a-z]+')) FROM c UNION ALL SELECT cid, 'body', unnest(regexp_extract_all(lower(body), '[a-z]+')) FROM c),
postings AS (SELECT term, cid, count(*) FILTER (f = 'name') AS tf_name, count(*) FILTER (f = 'path') AS tf_path, count(*) FILTER (f = 'body') AS tf_body FROM w GROUP BY ALL),
lengths AS (SELECT cid, len(regexp_extract_all(lower(name), '[a-z]+')) AS l_name, len(regexp_extract_all(lower(path), '[a-z]+')) AS l_path, len(regexp_extract_all(lower(body), '[a-z]+')) AS l_body FROM c),
avgs AS (SELECT count(*) AS n, greatest(1, avg(l_name)) AS an, greatest(1, avg(l_path)) AS ap, greatest(1, avg(l_body)) AS ab FROM lengths)
"""
_BM25 = (
    _INDEX
    + """, q AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM postings WHERE term IN ('the', 'theaea', 'ed', 'que', 'notthere')),
s AS (SELECT q.cid, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, 4.0::DOUBLE * tf_name / (0.7::DOUBLE + 0.3::DOUBLE * l_name / an) + 1.5::DOUBLE * tf_path / (0.7::DOUBLE + 0.3::DOUBLE * l_path / ap) + tf_body / (0.25::DOUBLE + 0.75::DOUBLE * l_body / ab) AS tf FROM q JOIN lengths USING (cid), avgs),
scored AS (SELECT cid, sum(idf * tf / (1.2::DOUBLE + tf)) AS score, count(*) AS matched FROM s GROUP BY cid)
"""
)
_RANKED = (
    _BM25
    + """, top AS (SELECT cid, path, score FROM scored JOIN c USING (cid) ORDER BY score DESC, cid LIMIT 100),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, cid) AS r, sum(score) OVER (PARTITION BY path) AS total FROM top),
lexical AS (SELECT cid, path, CASE WHEN r = 1 THEN score + 0.2::DOUBLE * (total - score) ELSE score END * pow(0.4::DOUBLE, r - 1) AS score FROM ranked)
"""
)
_NEAREST = "SELECT vec_id AS id, list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(q, q)) AS score FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3)"


@query(_INDEX + "SELECT term, cid, tf_name, tf_path, tf_body FROM postings", view=False)
def text_index(spark, d):
    return search.index(_chunks(spark, d), search.plain_terms)[0]


@query(_BM25 + "SELECT cid, round(score, 6) AS score, matched FROM scored", view=False)
def bm25_scores(spark, d):
    return search.bm25f(*_written_index(spark, d), _TERMS).select("cid", F.round("score", 6).alias("score"), "matched")


@query(_BM25 + "SELECT cid, round(score, 6) AS score, matched FROM scored", view=False)
def refreshed_scores(spark, d):
    """The same scores from an index that took the documents in four batches, a third of them first with another text,
    and dropped and took again some of them."""
    chunks, index = _chunks(spark, d), segments.SegmentedIndex(search.plain_terms, fan=2)
    of = lambda k: F.pmod(F.xxhash64("cid"), F.lit(4)) == k
    for k in range(4):
        index.refresh(chunks.where(of(k)).withColumn("body", F.when(F.pmod("cid", F.lit(3)) == 0, F.reverse("body")).otherwise(F.col("body"))))
    index.refresh(chunks.where(F.pmod("cid", F.lit(3)) == 0), chunks.where(F.pmod("cid", F.lit(5)) == 0).select("cid"))
    index.refresh(chunks.where((F.pmod("cid", F.lit(5)) == 0) & (F.pmod("cid", F.lit(3)) > 0)))
    return index.scores(_TERMS).select("cid", F.round("score", 6).alias("score"), "matched")


def _lexical(spark, d):
    chunks = _chunks(spark, d)
    return search.rerank(search.bm25f(*_written_index(spark, d), _TERMS), chunks)


@query(_RANKED + "SELECT cid, path, round(score, 6) AS score FROM lexical", view=False)
def search_ranked(spark, d):
    return _lexical(spark, d).select("cid", "path", F.round("score", 6).alias("score"))


def _near(spark, d, k):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.top_k(vectors, vectors.where("id = 3").first().embedding, k)


@query("SELECT id, round(score, 6) AS score FROM (" + _NEAREST + ") ORDER BY score DESC, id LIMIT 10", view=False)
def vector_top_k(spark, d):
    return _near(spark, d, 10).select("id", F.round("score", 6).alias("score"))


@query(
    """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT id, min(e) AS e FROM v GROUP BY id)),
s AS (SELECT q.id AS query, u.id, round(list_dot_product(q.e, u.e) / (q.n * u.n), 9) + 0 AS score FROM u q JOIN u ON q.id % 50 = 0 AND q.id <> u.id)
SELECT query, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
    view=False,
)
def nearest_vectors(spark, d):
    """Of every vector whose id is divisible by 50 the ten nearest of all others, by an inverted file."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return nearest.nearest(nearest.build(vectors, 64), vectors.where("id % 50 = 0"), 64)


@query(
    _RANKED
    + ", dense AS (" + _NEAREST + " ORDER BY score DESC, id LIMIT 50), x AS (SELECT cid, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, cid)) AS s FROM (SELECT * FROM lexical ORDER BY score DESC, cid LIMIT 50) UNION ALL SELECT id, 0.3::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM dense) SELECT cid, round(sum(s), 9) AS score FROM x GROUP BY cid",
    view=False,
)
def search_fused(spark, d):
    dense = _near(spark, d, 50).select(F.col("id").alias("cid"), "score")
    return search.fuse(_lexical(spark, d), dense, (1.0, 0.3)).select("cid", F.round("score", 9).alias("score"))


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS c, count(*) OVER (PARTITION BY term) AS df FROM t GROUP BY doc_id, term), p AS (SELECT doc_id, term, c, (1 + ln(c)) * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS w FROM f),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS n, md5(string_agg(term || ':' || c, ',' ORDER BY term)) AS h FROM p GROUP BY doc_id), k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class FROM n),
dot AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(a.w * b.w) AS dot FROM p a JOIN p b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, count(*) AS links FROM dot JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE dot / (nx.n * ny.n) >= 0.8 GROUP BY x)
SELECT k.doc_id, class, coalesce(links, 0) AS links FROM k LEFT JOIN l ON x = k.doc_id""",
    view=False,
)
def similar_documents(spark, d):
    """Documents by the cosine of their terms' weights, all pairs of 0.8 or more: the class of equal ones, and links."""
    docs = table(spark, d, "documents")
    n = docs.count()
    own = docs.select(F.col("doc_id").alias("cid"), search.plain_terms(F.col("text")).alias("terms"))
    shared = cut(docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "shared")  # ids of several rows: one document
    again = own.join(shared, F.col("cid").eqNullSafe(F.col("id")), "left_semi").groupBy("cid").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    own = own.join(shared, F.col("cid").eqNullSafe(F.col("id")), "left_anti").unionByName(again)
    found = simjoin.text_vectors(own, lambda tf, df: (1 + F.log(tf)) * F.log(1 + (n - df + 0.5) / (df + 0.5)))
    return simjoin.links(*simjoin.similar_classes(found, 0.8)).withColumnRenamed("cid", "doc_id")


@query()
def related_chunks(spark, d):
    """No SQL: candidates are cut by sums whose last digits depend on their order; tests compare with brute force."""
    return search.related(search.index(_chunks(spark, d), search.plain_terms)[0], 1).select("cid", F.round("score", 6).alias("score"))


@query()
def code_terms(spark, d):
    """No SQL: the parts of identifiers need a look-ahead that DuckDB's patterns haven't."""
    terms = table(spark, d, "documents").select(F.explode(search.code_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


# Communities ----------------------------------------------------------------------------------------------------

_WEIGHTS = """, inner_nodes AS (SELECT id, file, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, split_part(file, '/', 1) AS top, starts_with(file, 'tests/') AS test FROM nodes WHERE NOT external),
weights AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN relation IN ('contains', 'calls') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN confidence = 'INFERRED' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN s.file = t.file THEN 1.0::DOUBLE WHEN s.dir = t.dir THEN 1.25::DOUBLE WHEN s.top <> t.top THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN s.test <> t.test THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END) AS weight
  FROM edges JOIN inner_nodes s ON src = s.id JOIN inner_nodes t ON dst = t.id WHERE src <> dst GROUP BY ALL),
member AS (SELECT id, community FROM nodes WHERE community IS NOT NULL)
"""


def _member(nodes):
    return nodes.where("community is not null").select("id", "community")


@query(_WEIGHTS + "SELECT a, b, round(weight, 6) AS weight FROM weights")
def community_weights(spark, d):
    return communities.edge_weights(*graph_view(spark, d)).select("a", "b", F.round("weight", 6).alias("weight"))


@query(
    _WEIGHTS
    + """, w AS (SELECT * FROM weights WHERE a IN (SELECT id FROM member) AND b IN (SELECT id FROM member)), m AS (SELECT 2 * sum(weight) AS m2 FROM w),
i AS (SELECT 2 * coalesce(sum(weight) FILTER (x.community = y.community), 0) AS inside FROM w JOIN member x ON a = x.id JOIN member y ON b = y.id),
t AS (SELECT sum(k * k) AS squares FROM (SELECT community, sum(weight) AS k FROM (SELECT a, weight FROM w UNION ALL SELECT b, weight FROM w) JOIN member ON a = id GROUP BY community))
SELECT round(inside / m2 - squares / (m2 * m2), 6) AS modularity FROM m, i, t"""
)
def community_modularity(spark, d):
    nodes, edges = graph_view(spark, d)
    member = _member(nodes)
    weights = communities.edge_weights(nodes.where("community is not null"), edges)  # pairs of members only
    return communities.modularity(weights, member).select(F.round("modularity", 6).alias("modularity"))


@query(
    _WEIGHTS
    + """, l AS (SELECT x.community, count(DISTINCT (least(src, dst), greatest(src, dst))) AS linked FROM edges JOIN member x ON src = x.id JOIN member y ON dst = y.id AND x.community = y.community WHERE src <> dst GROUP BY x.community)
SELECT s.community, size, round(CASE WHEN size < 2 THEN 1.0::DOUBLE ELSE coalesce(linked, 0) / (size * (size - 1) / 2.0::DOUBLE) END, 9) AS cohesion FROM (SELECT community, count(*) AS size FROM member GROUP BY community) s LEFT JOIN l ON s.community = l.community"""
)
def community_cohesion(spark, d):
    nodes, edges = graph_view(spark, d)
    return communities.cohesion(edges, _member(nodes)).select("community", "size", F.round("cohesion", 9).alias("cohesion"))


@query(", member AS (SELECT id, community FROM nodes WHERE community IS NOT NULL), v AS (SELECT o.id, m.community, count(*) AS v FROM (SELECT src AS id, dst AS n FROM edges UNION ALL SELECT dst, src FROM edges) o JOIN member m ON o.n = m.id JOIN nodes x ON x.id = o.id AND x.type = 'order' GROUP BY ALL) SELECT id, community FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, community) AS r FROM v) WHERE r = 1")
def external_votes(spark, d):
    nodes, edges = graph_view(spark, d)
    return communities.external_votes(edges, _member(nodes), nodes.where("type = 'order'"))


@query("SELECT community AS old, pos % 7 AS new, count(*) AS shared FROM nodes WHERE community IS NOT NULL GROUP BY ALL")
def community_overlap(spark, d):
    nodes = node_view(spark, d)
    return communities.overlap(_member(nodes), nodes.select("id", (F.col("pos") % 7).alias("community")))


@query(
    """, f AS (SELECT DISTINCT file, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir FROM nodes), k AS (SELECT *, count(*) OVER (PARTITION BY dir) AS k FROM f)
SELECT x.file AS a, y.file AS b, round(0.1::DOUBLE / (x.k - 1), 9) AS weight FROM k x JOIN k y ON x.dir = y.dir AND x.file < y.file WHERE x.k <= 64"""
)
def directory_ties(spark, d):
    return communities.directory_ties(node_view(spark, d)).select("a", "b", F.round("weight", 9).alias("weight"))


@query()
def community_partition(spark, d):
    """No SQL: an iterative optimisation; tests check its modularity."""
    nodes, edges = graph_view(spark, d)
    return communities.partition(communities.edge_weights(nodes, edges).where("weight > 0"))


def _brand_weights(spark, d):
    """Parts that follow each other in orders, within a brand: many communities of several sizes."""
    e = next_part_edges(spark, d).where("src <> dst")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("weight"))


@query()
def community_leiden(spark, d):
    """No SQL: an iterative optimisation; tests compare its modularity and that communities are connected."""
    return communities.leiden(_brand_weights(spark, d))


@query()
def community_settled(spark, d):
    """No SQL: passes of partition and split until one gives itself again; numbered by size."""
    return communities.by_size(communities.settle(_brand_weights(spark, d), next_part_edges(spark, d)))


_BEFORE = "member AS (SELECT 'p' || p_partkey AS id, p_partkey % 10 AS old, (p_partkey * 7 + p_size) % 12 AS new FROM part), o AS (SELECT old, new, count(*) AS shared FROM member GROUP BY ALL)"


def _two_partitions(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("old"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 12).alias("new"))
    return part.select("id", F.col("old").alias("community")), part.select("id", F.col("new").alias("community"))


@query(
    "WITH RECURSIVE "
    + _BEFORE
    + """, pick AS (SELECT 0 AS step, CAST([] AS BIGINT[]) AS olds, CAST([] AS BIGINT[]) AS news, CAST(NULL AS BIGINT) AS old, CAST(NULL AS BIGINT) AS new
  UNION ALL SELECT step + 1, list_append(olds, x.old), list_append(news, x.new), x.old, x.new FROM pick, LATERAL (SELECT old, new FROM o WHERE NOT list_contains(olds, o.old) AND NOT list_contains(news, o.new) ORDER BY shared DESC, old, new LIMIT 1) x),
taken AS (SELECT old, new FROM pick WHERE step > 0),
rest AS (SELECT new, row_number() OVER (ORDER BY new) AS r FROM (SELECT DISTINCT new FROM member WHERE new NOT IN (SELECT new FROM taken))),
free AS (SELECT i, row_number() OVER (ORDER BY i) AS r FROM (SELECT unnest(range(100)) AS i) WHERE i NOT IN (SELECT old FROM taken)),
ids AS (SELECT old, new FROM taken UNION ALL SELECT i, new FROM rest JOIN free USING (r))
SELECT id, ids.old AS community FROM member JOIN ids ON member.new = ids.new""",
    view=False,
)
def community_remap(spark, d):
    before, after = _two_partitions(spark, d)
    return communities.remap(after, before)


@query("WITH c AS (SELECT p_size AS community, count(*) AS n, min('p' || p_partkey) AS least FROM part GROUP BY p_size), r AS (SELECT community, row_number() OVER (ORDER BY n DESC, least) - 1 AS number FROM c) SELECT 'p' || p_partkey AS id, number AS community FROM part JOIN r ON p_size = r.community", view=False)
def communities_by_size(spark, d):
    return communities.by_size(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_size").alias("community")))


_SIZES = """WITH m AS (SELECT 'p' || p_partkey AS id, p_size AS old, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_partkey % 10 < p_size % 10 THEN p_size ELSE 0 END AS new FROM part),
fits AS (SELECT old AS community FROM (SELECT old, count(*) AS o, count(*) FILTER (new = old) AS shared FROM m GROUP BY old) a JOIN (SELECT new, count(*) AS n FROM m GROUP BY new) b ON a.old = b.new WHERE 2 * shared > o AND 2 * shared > n),
label AS (SELECT DISTINCT p_size AS community, 'Size ' || p_size AS name FROM part WHERE p_size % 4 <> 1)
"""


def _sizes(spark, d):
    size = F.col("p_size")
    new = F.when(size % 3 == 0, size).when(F.col("p_partkey") % 10 < size % 10, size).otherwise(0)
    m = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), size.alias("old"), new.alias("new"))
    labels = table(spark, d, "part").where(size % 4 != 1).select(size.alias("community"), F.concat(F.lit("Size "), size.cast("string")).alias("name")).distinct()
    return m.select("id", F.col("old").alias("community")), m.select("id", F.col("new").alias("community")), labels


@query(_SIZES + "SELECT * FROM label WHERE community IN (SELECT community FROM fits)", view=False)
def surviving_labels(spark, d):
    before, after, labels = _sizes(spark, d)
    return communities.surviving_labels(labels, before, after)


@query(_SIZES + "SELECT DISTINCT new AS community, coalesce(name, 'Community ' || new) AS name FROM m LEFT JOIN label ON new = community", view=False)
def placeholder_names(spark, d):
    _, after, labels = _sizes(spark, d)
    return communities.placeholder_names(after, labels)


@query(
    """, member AS (SELECT id FROM nodes WHERE community = 3), i AS (SELECT *, src IN (SELECT id FROM member) AS s, dst IN (SELECT id FROM member) AS t FROM edges)
SELECT 'member' AS part, id AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS VARCHAR) AS relation FROM member UNION ALL SELECT 'internal', src, dst, relation FROM i WHERE s AND t
UNION ALL SELECT * FROM (SELECT 'boundary', src, dst, relation FROM i WHERE s <> t ORDER BY pos, src, dst, relation LIMIT 50)"""
)
def community_wiki(spark, d):
    nodes, edges = graph_view(spark, d)
    return communities.wiki(nodes, edges, _member(nodes), 3)


@query(
    """, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
m AS (SELECT nodes.*, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (id) WHERE community IS NOT NULL),
b AS (SELECT community, arg_min(label, (external, -degree, id)) AS label, count(*) AS n FROM m GROUP BY community),
k AS (SELECT community, arg_min({'dir': dir, 'k': k}, (-k, dir)) AS d FROM (SELECT community, dir, count(*) AS k FROM m GROUP BY ALL) GROUP BY community)
SELECT b.community, CASE WHEN n > 1 AND d.dir <> '' AND d.k > 0.6 * n THEN d.dir || ': ' || label ELSE label END AS name FROM b JOIN k USING (community)"""
)
def community_names(spark, d):
    nodes, edges = graph_view(spark, d)
    return communities.names(nodes, edges, _member(nodes))


# Changes --------------------------------------------------------------------------------------------------------


@query(
    """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id AS key, min(ts) AS start, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM s GROUP BY user_id, k""",
    view=False,
)
def event_bursts(spark, d):
    found = watch.bursts(table(spark, d, "events"), F.col("user_id"), F.col("event_type"), quiet="1 hour")
    return found.select("key", "start", "n", F.array_join("items", ",").alias("items"))


def _stamps(spark, d, salt):
    own = table(spark, d, "documents").where(F.col("doc_id") % 11 != salt)
    return own.select(F.col("doc_id").cast("string").alias("file"), F.md5(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 13 == salt, F.lit("x")).otherwise("")).cast("binary")).alias("hash"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id % 11 = 2 THEN 'new' WHEN doc_id % 11 = 1 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 11 IN (1, 2) OR doc_id % 13 IN (1, 2)", view=False)
def file_changes(spark, d):
    return watch.changes(_stamps(spark, d, 1), _stamps(spark, d, 2))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END AS p_name FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 5 = 0", view=False)
def upsert_rows(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    fresh = part.where("p_partkey % 5 = 0").withColumn("p_name", F.concat("p_name", F.lit("!")))
    return watch.upsert(part, fresh, "p_partkey", part.where("p_partkey % 7 = 0"))


@query("SELECT id, label, type FROM nodes WHERE file NOT IN (SELECT file FROM nodes WHERE starts_with(file, 'catalog/Brand#1/'))")
def prune_nodes(spark, d):
    nodes, edges = graph_view(spark, d)
    return graph_json.prune(nodes, edges, nodes.where(~F.startswith("file", F.lit("catalog/Brand#1/"))).select("file"))[0].select("id", "label", "type")


# Queries over source files, histories and walks have a module of their own.
from . import code_queries  # noqa: E402

QUERIES |= code_queries.QUERIES
ORACLE_SQL |= code_queries.ORACLE_SQL
