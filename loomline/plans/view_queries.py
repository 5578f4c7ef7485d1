"""Queries over targets, views, choices and smaller rules, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators import activity, graph, history, resolver, selection, views
from loomline.plans.graph_queries import BASE, NS_EDGES, longs
from loomline.plans.history_queries import BASE as HISTORY
from loomline.plans.history_queries import SEEN
from loomline.sources import ir
from loomline.sources import relational as src
from loomline.storage import keep, shares, table

EVENTS = "WITH " + src.LIFECYCLE_SQL
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_RESOURCES = """, lined AS (SELECT l_orderkey AS event, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_suppkey, s.id AS sym, s.file, s.row, s.end_row, s.namespace
  FROM lineitem JOIN symbols s ON s.id = 'var:' || l_partkey),
files AS (SELECT DISTINCT file FROM nodes WHERE file IS NOT NULL),
tails AS (SELECT suffix, count(DISTINCT file) AS n, min(file) AS file FROM (SELECT file, array_to_string(string_split(file, '/')[i:], '/') AS suffix FROM files, unnest(generate_series(1, len(string_split(file, '/')))) AS t(i)) GROUP BY suffix)"""


def _resources(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as what an event touched: addresses, commands, paths in and out of the root, with and
    without a line; the first line of some orders names a node."""
    s = src.symbols(spark, d).select("id", "file", "row")
    li = table(spark, d, "lineitem").withColumn("id", F.concat(F.lit("var:"), "l_partkey")).join(s, "id")
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    li = li.withColumn("k", k)
    kind, at = F.col("l_suppkey") % 9, F.lit("/repo/")
    return li.select(
        F.col("l_orderkey").alias("event"), "k", F.when((F.col("k") == 1) & (F.col("l_orderkey") % 10 == 0), F.col("id")).alias("node_id"),
        F.when(kind == 0, "url").when(kind == 1, "git").when(kind == 2, "directory").alias("kind"), F.when(kind == 0, F.concat(F.lit("h"), F.col("l_suppkey") % 3)).alias("name"),
        F.when(kind == 2, F.concat(F.lit("nowhere/"), F.col("l_suppkey") % 5)).when(kind == 3, F.concat(at, "file")).when(kind == 4, F.regexp_replace("file", "^[^/]*/", "")).when(kind == 5, F.col("file")).when(kind == 6, F.concat(F.lit("/else/"), "file")).when(kind > 6, F.col("file")).alias("path"),
        F.when(kind.isin(3, 4), F.col("row") + F.col("l_suppkey") % 3).when(kind == 7, F.lit(-5)).alias("line"), F.when(kind > 1, "read").alias("action"), (kind != 8).alias("here"), F.lit(False).alias("outside"),
    )


@query(
    BASE
    + _RESOURCES
    + """, named AS (SELECT event, 1 AS k, 'node' AS target, sym AS id, 'node' AS how FROM lined WHERE k = 1 AND event % 10 = 0 AND l_suppkey % 9 <> 8),
spans AS (SELECT l.event, l.k, n.id AS node, n.end_row - n.row AS size, row_number() OVER (PARTITION BY l.event, l.k ORDER BY n.end_row - n.row, n.id) AS r FROM lined l JOIN nodes n ON n.file = l.file AND n.row IS NOT NULL
  WHERE l.l_suppkey % 9 IN (3, 4) AND (l.row + l.l_suppkey % 3 BETWEEN n.row AND n.end_row OR l.row + l.l_suppkey % 3 - 1 BETWEEN n.row AND n.end_row)),
ns AS (SELECT file, arg_min(id, (coalesce(row, 0), id)) FILTER (kind = 'namespace') AS node FROM nodes GROUP BY file),
known AS (SELECT l.*, CASE WHEN l_suppkey % 9 = 4 THEN (SELECT t.file FROM tails t WHERE t.n = 1 AND t.suffix IN (regexp_replace(l.file, '^[^/]*/', ''), split_part(l.file, '/', 3)) ORDER BY length(t.suffix) DESC LIMIT 1) ELSE l.file END AS hit FROM lined l),
hits AS (SELECT x.event, x.k, CASE WHEN m = 0 THEN 'group' WHEN m = 1 THEN 'group' WHEN m IN (2, 8) THEN 'group' WHEN m IN (3, 4) AND hit IS NOT NULL THEN 'node' WHEN m = 5 AND ns.node IS NOT NULL THEN 'node' WHEN m = 6 THEN NULL ELSE 'group' END AS target,
  CASE WHEN m = 0 THEN 'group:activity:web:h' || (l_suppkey % 3) WHEN m = 1 THEN 'group:activity:tool:git' WHEN m = 2 THEN 'group:activity:directory:nowhere/' || (l_suppkey % 5) WHEN m IN (3, 4) AND hit IS NOT NULL THEN s.node
    WHEN m = 4 THEN 'group:activity:file:' || regexp_replace(x.file, '^[^/]*/', '') WHEN m = 5 AND ns.node IS NOT NULL THEN ns.node WHEN m = 8 THEN 'group:activity:file:' || x.file WHEN m IN (5, 7) THEN 'group:' || x.namespace END AS id,
  CASE WHEN m IN (0, 1) THEN 'external' WHEN m IN (2, 8) THEN 'own' WHEN m IN (3, 4) AND hit IS NOT NULL THEN 'span' WHEN m = 4 THEN 'own' WHEN m = 5 AND ns.node IS NOT NULL THEN 'file' ELSE 'group' END AS how
  FROM (SELECT *, l_suppkey % 9 AS m FROM known) x LEFT JOIN spans s ON s.event = x.event AND s.k = x.k AND s.r = 1 LEFT JOIN ns ON ns.file = x.file WHERE x.event NOT IN (SELECT event FROM named))
SELECT event, min(k) AS k, target, id, arg_min(how, k) AS how FROM hits WHERE target IS NOT NULL GROUP BY event, target, id UNION ALL SELECT * FROM named"""
)
def resolved_cascade(spark: SparkSession, d: str) -> DataFrame:
    return longs(resolver.resolve(_resources(spark, d), src.nodes(spark, d), "/repo"))


_PLAY = """, decay AS (SELECT id, (end_row % 5) / 4 AS value FROM symbols), changed AS (SELECT id FROM symbols WHERE row % 3 = 0), revealed AS (SELECT id FROM symbols WHERE row % 6 = 0),
lit AS (SELECT id FROM decay WHERE value > 0 AND (id NOT IN (SELECT id FROM changed) OR id IN (SELECT id FROM revealed)))"""


def _play(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = src.symbols(spark, d)
    return s.select("id", (F.col("end_row") % 5 / 4).alias("value")), s.where("row % 3 = 0").select("id"), s.where("row % 6 = 0").select("id")


@query(
    BASE
    + _PLAY
    + """ SELECT 'node' AS what, id, '' AS target FROM nodes WHERE kind = 'namespace' OR id IN (SELECT id FROM lit)
UNION ALL SELECT kind, source, target FROM edges WHERE (source IN (SELECT id FROM lit) OR target IN (SELECT id FROM lit)) AND (kind <> 'requires' OR first_order % 2 = 0)"""
)
def playback_visible(spark: SparkSession, d: str) -> DataFrame:
    e = keep(src.edges(spark, d), "edges")
    nodes = views.playback_nodes(src.nodes(spark, d), *_play(spark, d)).select(F.lit("node").alias("what"), "id", F.lit("").alias("target"))
    edges = views.playback_edges(e, *_play(spark, d), e.where("first_order % 2 = 0"), shares(table(spark, d, "lineitem")))
    return nodes.unionByName(edges.select(F.col("kind").alias("what"), F.col("source").alias("id"), "target"))


@query("SELECT o_orderkey, (o_orderkey + 1) % 7 AS next, (o_orderkey + 6) % 7 AS previous, greatest(0, o_orderkey % 7 - 3) AS back FROM (SELECT o_orderkey FROM orders)")
def timeline_steps(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("o_orderkey") % 7, F.lit(7)
    return longs(table(spark, d, "orders").select("o_orderkey", views.stepped(i, 1, n).alias("next"), views.stepped(i, -1, n).alias("previous"), views.jumped_back(i, 3).alias("back")))


@query(
    """WITH a AS (SELECT 'a' || s_suppkey AS agent, s_suppkey::DOUBLE AS x, 1.0::DOUBLE AS y, 2.0::DOUBLE AS z FROM supplier), r AS (SELECT 'a' || l_suppkey AS agent, l_partkey AS target FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT p_partkey AS target, p_size::DOUBLE AS x, (p_partkey % 10)::DOUBLE AS y, (p_partkey % 3)::DOUBLE AS z FROM part), m AS (SELECT agent, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM r JOIN p USING (target) GROUP BY agent)
SELECT agent, round(coalesce(m.x, a.x), 6) AS x, round(coalesce(m.y, a.y), 6) AS y, round(coalesce(m.z, a.z), 6) AS z FROM a FULL JOIN m USING (agent)"""
)
def follow_points(spark: SparkSession, d: str) -> DataFrame:
    own = lambda c: F.concat(F.lit("a"), c).alias("agent")
    agents = table(spark, d, "supplier").select(own("s_suppkey"), F.col("s_suppkey").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"))
    rays = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(own("l_suppkey"), F.col("l_partkey").alias("target"))
    points = table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 10).cast("double").alias("y"), (F.col("p_partkey") % 3).cast("double").alias("z"))
    return longs(views.follow_points(agents, rays, points))


_RAYS = """WITH agents AS (SELECT 'agent:' || s_suppkey AS id, 'g' || (s_suppkey // 2) AS agent, 's' || (s_suppkey % 4) AS session, 'w' || (s_suppkey % 3) AS workspace, s_suppkey % 5 > 0 AS visible FROM supplier),
rays AS (SELECT o_orderkey AS ray, 's' || (s % 4) AS session, 'agent:' || s AS source, CASE WHEN o_orderkey % 4 > 0 THEN 'w' || (s % 3) END AS workspace, 'agent:' || t AS target, CASE WHEN o_orderkey % 3 > 0 THEN 'w' || (t % 3) END AS target_workspace,
  CASE WHEN o_orderkey % 5 > 1 THEN 'agent:' || t END AS link, CASE WHEN o_orderkey % 7 = 0 THEN 's9' END AS link_session, NULL::VARCHAR AS link_workspace FROM (SELECT o_orderkey, (o_orderkey % (SELECT max(s_suppkey) FROM supplier)) + 1 AS s, (o_orderkey * 7 % (SELECT max(s_suppkey) FROM supplier)) + 1 AS t FROM orders))"""


@query(
    _RAYS
    + """, x AS (SELECT r.*, a.workspace AS sw, a.visible AS sv, b.workspace AS tw, b.visible AS tv, coalesce(link_session = b.session, true) AS fits FROM rays r JOIN agents a ON a.id = r.source JOIN agents b ON b.id = r.target),
y AS (SELECT *, sw <> tw OR coalesce(workspace <> tw, false) OR coalesce(sw <> target_workspace, false) OR coalesce(workspace <> target_workspace, false) AS crosses FROM x)
SELECT ray FROM y WHERE CASE WHEN link IS NULL THEN CASE WHEN target_workspace IS NULL OR workspace = target_workspace THEN true WHEN workspace IS NOT NULL THEN false ELSE NOT (sv AND sw <> target_workspace) END
  WHEN NOT crosses THEN fits AND (workspace IS NULL OR target_workspace IS NULL OR workspace = target_workspace) ELSE sv AND tv AND fits AND sw <> tw AND coalesce(workspace = sw, true) END"""
)
def compatible_rays(spark: SparkSession, d: str) -> DataFrame:
    """Rays between agents of three workspaces, some of which are hidden, linked and unlinked."""
    s = table(spark, d, "supplier")
    n = s.agg(F.max("s_suppkey")).first()[0]
    key = F.col("s_suppkey")
    agents = s.select(F.concat(F.lit("agent:"), key).alias("id"), F.concat(F.lit("g"), (key / 2).cast("bigint")).alias("agent"), F.concat(F.lit("s"), key % 4).alias("session"), F.concat(F.lit("w"), key % 3).alias("workspace"), (key % 5 > 0).alias("visible"))
    o = F.col("o_orderkey")
    a, b = o % n + 1, o * 7 % n + 1
    rays = table(spark, d, "orders").select(
        o.alias("ray"), F.concat(F.lit("s"), a % 4).alias("session"), F.concat(F.lit("agent:"), a).alias("source"), F.when(o % 4 > 0, F.concat(F.lit("w"), a % 3)).alias("workspace"), F.concat(F.lit("agent:"), b).alias("target"),
        F.when(o % 3 > 0, F.concat(F.lit("w"), b % 3)).alias("target_workspace"), F.when(o % 5 > 1, F.concat(F.lit("agent:"), b)).alias("link"), F.when(o % 7 == 0, "s9").alias("link_session"), F.lit(None).cast("string").alias("link_workspace"),
    )
    return views.compatible_rays(rays, agents).select("ray")


@query(BASE + " , short AS (SELECT 'var:' || p_partkey AS id FROM part WHERE p_partkey % 3 = 0) SELECT kind, source, target FROM edges WHERE source NOT IN (SELECT id FROM short) AND target NOT IN (SELECT id FROM short)")
def top_level_edges(spark: SparkSession, d: str) -> DataFrame:
    """A third of the symbols are namespaces of one segment here."""
    n = src.symbols(spark, d)
    short = F.substring("id", 5, 20).cast("bigint") % 3 == 0
    nodes = n.withColumns({"kind": F.when(short, "namespace").otherwise(F.col("kind")), "label": F.when(short, "root").otherwise(F.col("label"))})
    return graph.without_top_level(src.edges(spark, d), nodes).select("kind", "source", "target")


@query(EVENTS + " SELECT session, session IN ('s1', 's7') AS chosen, count(*) AS n FROM lifecycle GROUP BY ALL")
def chosen_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The events of two sessions, and those that are dimmed for it."""
    e = src.lifecycle(spark, d)
    count = lambda df, c: df.groupBy("session").agg(F.count("*").alias("n")).withColumn("chosen", F.lit(c))
    return count(selection.chosen(e, "session", ["s1", "s7"]), True).unionByName(count(selection.chosen(e, "session", ["s1", "s7"], invert=True), False))


@query(
    BASE
    + NS_EDGES
    + """ SELECT 'group' AS what, ns AS source, '' AS target FROM spaces WHERE NOT external UNION ALL SELECT 'ray', a, b FROM ns_edges WHERE b NOT IN (SELECT ns FROM spaces WHERE external)"""
)
def layered_groups(spark: SparkSession, d: str) -> DataFrame:
    n = src.nodes(spark, d)
    groups = graph.namespaces(n).select(F.col("ns").alias("id"), F.when(F.col("external"), "external").otherwise("project").alias("kind"))
    rays = graph.namespace_edges(src.edges(spark, d), n).select(F.col("a").alias("source"), F.col("b").alias("target"))
    shown, left = selection.layered(groups, rays, ("external",))
    return shown.select(F.lit("group").alias("what"), F.col("id").alias("source"), F.lit("").alias("target")).unionByName(left.select(F.lit("ray").alias("what"), "source", "target"))


@query(
    "SELECT o_orderkey FROM orders WHERE (o_custkey % 3 = 0 OR o_custkey % 3 = o_orderkey % 2 + 1) AND (o_orderkey % 4 = 0 OR o_custkey % 2 = 1)"
)
def matching_workspaces(spark: SparkSession, d: str) -> DataFrame:
    """Ids that one side may lack, and roots that the other may."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    here = F.struct(F.when(c % 3 > 0, c % 3).alias("id"), F.lit("r").alias("repository"), F.when(o % 4 > 0, F.lit(1)).alias("root"))
    there = F.struct((o % 2 + 1).alias("id"), F.lit(None).cast("string").alias("repository"), (c % 2).alias("root"))
    return table(spark, d, "orders").select("o_orderkey", here.alias("here"), there.alias("there")).where(selection.same_workspace("here", "there")).select("o_orderkey")


@query(EVENTS + ", r AS (SELECT session AS recording_id, session, min(workspace) AS workspace, min(ts) AS created FROM lifecycle GROUP BY session) SELECT recording_id, workspace FROM r WHERE workspace = 'w0'")
def listed_recordings(spark: SparkSession, d: str) -> DataFrame:
    r = src.lifecycle(spark, d).groupBy("session").agg(F.min("workspace").alias("workspace"), F.min("ts").alias("created")).withColumn("recording_id", F.col("session"))
    return selection.listed(r, workspace="w0").select("recording_id", "workspace")


@query(
    BASE
    + """, calls AS (SELECT 'var:' || prev AS source, 'var:' || l_partkey AS target FROM uses WHERE prev IS NOT NULL), defs AS (SELECT id FROM symbols WHERE NOT external)
SELECT source, target, target NOT IN (SELECT id FROM defs) AS external, count(*) AS n FROM calls WHERE source IN (SELECT id FROM defs) GROUP BY ALL"""
)
def calls_from_usages(spark: SparkSession, d: str) -> DataFrame:
    return selection.calls_from_usages(src.uses(spark, d).select("source", "target"), src.symbols(spark, d).where("not external").select("id"), include_external=True)


@query("""SELECT '{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_type":"' || p_type || '"}' AS json FROM part""")
def stable_json(spark: SparkSession, d: str) -> DataFrame:
    return selection.stable_json(table(spark, d, "part").select("p_type", "p_partkey", "p_brand"))


@query(
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'm' || event_id WHEN event_id % 5 = 1 THEN 'n' || event_id WHEN event_id % 5 = 2 THEN 'r' || event_id ELSE '-' END AS node FROM events"
)
def explicit_nodes(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("event_id") % 5, F.col("event_id")
    none = F.lit(None).cast("string")
    rows = table(spark, d, "events").select(
        "event_id", F.when(k == 0, F.create_map(F.lit("graphNodeId"), F.concat(F.lit("m"), i))).otherwise(F.create_map(F.lit("other"), F.lit("x"))).alias("meta"), F.when(k <= 1, F.concat(F.lit("n"), i)).alias("node"),
        F.array(F.struct(none.alias("node_id")), F.struct(F.when(k <= 2, F.concat(F.lit("r"), i)).alias("node_id"))).alias("resources"),
    )
    return rows.select("event_id", F.coalesce(selection.explicit_node("meta", "node", "resources"), F.lit("-")).alias("node"))


@query(
    "SELECT 'f' || p_partkey AS path, 'f' || CASE p_partkey % 8 WHEN 4 THEN p_partkey + 2 WHEN 5 THEN p_partkey + 1 ELSE p_partkey END AS now FROM part"
    + " UNION ALL SELECT 'g' || p_partkey, 'g' || (p_partkey - p_partkey % 64 + CASE WHEN p_partkey % 64 <= 40 THEN 40 ELSE 63 END) FROM part UNION ALL SELECT 'h' || p_partkey, 'f' || (p_partkey - p_partkey % 8 + 1) FROM part"
)
def resolved_renames(spark: SparkSession, d: str) -> DataFrame:
    """Short chains, circles, ways that lead into one, and chains of 63 renames of which one file is there still."""
    k = F.col("k")
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    # the ends of a chain may lie beyond the last part
    every = ids.select((k - k % 64).alias("k")).distinct().select(F.explode(F.sequence(k, k + 63)).alias("k"))
    name = lambda kind, i: F.concat(F.lit(kind), i)
    new = F.when((k % 8).isin(0, 1, 4, 5), k + 1).when(k % 8 == 2, k - 2)
    renames = every.select(name("f", k).alias("old"), name("f", new).alias("new")).where("new is not null")
    renames = renames.union(every.where("k % 64 <> 63").select(name("g", k), name("g", k + 1))).union(every.select(name("h", k), name("f", k - k % 8 + 1)))
    paths = ids.select(F.explode(F.array(*[name(x, k) for x in "fgh"])).alias("path"))
    return history.resolve_renames(paths, renames, every.where("k % 64 = 40").select(name("g", k).alias("path")))


@query(
    """WITH c AS (SELECT o_orderkey // 2 AS hash, o_orderdate AS ts, ['f' || (o_custkey % 10), 'g' || (o_orderkey % 3)] AS changed, o_orderkey % 5 = 0 AS metadata, o_orderkey % 7 > 0 AS observable FROM orders)
SELECT hash, min(ts)::TIMESTAMP AS ts, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(flatten(list(changed))) AS x)) AS changed, bool_or(metadata) AS metadata, bool_and(observable) AS observable FROM c GROUP BY hash"""
)
def duplicate_commits(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.expr("o_orderkey div 2").alias("hash"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.array(F.concat(F.lit("f"), F.col("o_custkey") % 10), F.concat(F.lit("g"), o % 3)).alias("changed"), (o % 5 == 0).alias("metadata"), (o % 7 > 0).alias("observable"))
    return history.merge_duplicate_commits(c).withColumn("changed", F.array_join("changed", ","))


@query(HISTORY + SEEN + " SELECT a, b, co_changes, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM coupled")
def server_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Every commit twice, the second time with other namespaces, and some without any."""
    seen = history.observations(src.changes(spark, d)).groupBy("commit").agg(F.collect_list("ns").alias("namespaces"))
    first = seen.select(F.col("commit").cast("string").alias("hash"), F.lit(0).alias("i"), F.concat("namespaces", F.array(F.lit(None).cast("string"))).alias("namespaces"))
    again = first.select("hash", F.lit(1).alias("i"), F.array(F.lit("other"), F.lit("more")).alias("namespaces"))
    none = first.select(F.concat(F.lit("x"), "hash").alias("hash"), F.lit(0).alias("i"), F.array().cast("array<string>").alias("namespaces"))
    return longs(history.server_coupling(first.unionByName(again).unionByName(none)))


@query(HISTORY + ", lost AS (SELECT DISTINCT commit FROM changes WHERE node LIKE '%7') SELECT namespace AS ns, count(DISTINCT commit) AS commits FROM changes WHERE commit NOT IN (SELECT commit FROM lost) GROUP BY namespace")
def fully_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose number ends in 7 belong to no namespace here, and so their commits don't count."""
    changes = src.changes(spark, d).withColumn("namespace", F.when(~F.col("node").endswith("7"), F.col("namespace")))
    return history.observations(changes, partial=False).groupBy("ns").agg(F.count("*").alias("commits"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey + 1 AS line, l_suppkey + 2 AS end_line, l_linenumber - 1 AS column FROM lineitem")
def canonical_spans(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("line"), (F.col("l_suppkey") + 1).alias("end_line"), F.col("l_linenumber").alias("column"), F.col("l_linenumber").alias("end_column"))
    return longs(ir.one_based(li, 0, 1).drop("end_column"))


@query(
    BASE
    + """, own AS (SELECT file, string_agg(id, ',' ORDER BY id) AS nodes FROM nodes GROUP BY file), rel AS (SELECT DISTINCT t.file, e.kind || '>' || e.source || '>' || e.target AS id FROM edges e JOIN symbols t ON t.id = e.target WHERE e.kind = 'requires'),
rels AS (SELECT file, string_agg(id, ',' ORDER BY id) AS relationships FROM rel GROUP BY file) SELECT file, nodes, coalesce(relationships, '') AS relationships FROM own LEFT JOIN rels USING (file)"""
)
def file_ownership(spark: SparkSession, d: str) -> DataFrame:
    """The namespaces and symbols of each file, and the relationships that occur in it."""
    e = src.edges(spark, d).where("kind = 'requires'").withColumn("id", F.concat_ws(">", "kind", "source", "target"))
    at = e.join(src.symbols(spark, d).select(F.col("id").alias("target"), "file"), "target").select(F.col("id").alias("owner"), "file")
    out = ir.ownership(src.nodes(spark, d), e.select("id"), at)
    return out.select("file", F.array_join("nodes", ",").alias("nodes"), F.array_join("relationships", ",").alias("relationships"))


@query(
    """WITH f AS (SELECT p_type AS language, 2 * least(count(*), 10) AS s FROM part GROUP BY 1), m AS (SELECT p_type AS language, sum(p_size)::BIGINT AS s FROM part WHERE p_partkey % 10 = 0 GROUP BY 1),
t AS (SELECT language, sum(s)::BIGINT AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM m) GROUP BY 1)
SELECT language, score, score = (SELECT max(score) FROM t) AND (SELECT count(*) FROM t WHERE score = (SELECT max(score) FROM t)) > 1 AS ambiguous FROM t"""
)
def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return ir.detect_languages(part.select(F.col("p_name").alias("path"), F.col("p_type").alias("language")), part.where("p_partkey % 10 = 0").select(F.col("p_type").alias("language"), F.col("p_size").alias("weight")))


ACTIONS_SQL = """, acts AS (SELECT workspace AS key, seq, CASE WHEN seq % 13 = 5 THEN 'gap' WHEN seq % 5 = 0 THEN 'connection' ELSE 'event' END AS action, CASE WHEN seq % 13 <> 5 AND seq % 5 = 0 THEN CASE WHEN seq % 3 = 0 THEN 'unavailable' ELSE 'connected' END END AS status FROM lifecycle)"""


@query(
    "WITH RECURSIVE "
    + src.LIFECYCLE_SQL
    + ACTIONS_SQL
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM acts),
fold AS (
  SELECT key, 0::BIGINT AS i, NULL::BIGINT AS seq, 'unavailable' AS coverage FROM n WHERE i = 1
  UNION ALL
  SELECT n.key, n.i, n.seq, CASE WHEN action = 'gap' THEN 'partial' WHEN action = 'connection' AND status = 'unavailable' THEN 'unavailable' WHEN coverage = 'unavailable' THEN 'observed' WHEN action = 'event' AND coverage <> 'partial' THEN 'exact' ELSE coverage END
  FROM fold JOIN n ON n.key = fold.key AND n.i = fold.i + 1)
SELECT key, seq, coverage FROM fold WHERE i > 0"""
)
def coverage_states(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each workspace's connection behind every event, gap and change of the connection."""
    k = F.col("seq")
    gap, link = k % 13 == 5, k % 5 == 0
    acts = src.lifecycle(spark, d).select(F.col("workspace").alias("key"), "seq", F.when(gap, "gap").when(link, "connection").otherwise("event").alias("action"), F.when(~gap & link, F.when(k % 3 == 0, "unavailable").otherwise("connected")).alias("status"))
    return activity.connection_coverage(acts).select("key", "seq", "coverage")


#: Groups that events touch: their tool's, or their workspace's project.
SPECS_SQL = """, touched AS (SELECT seq, epoch_us(ts) // 1000 AS ms, tool_call % 3 AS t, workspace, agent, type, status FROM lifecycle),
specs AS (
  SELECT seq, ms, 'group:activity:tool:t' || t AS id, NULL AS parent, 'tool ' || t || CASE WHEN seq % 2 = 0 THEN '' ELSE ' again' END AS label, 'tool' AS kind, 1 AS weight, CASE WHEN type LIKE '%ed' AND seq % 3 = 0 THEN status END AS outcome FROM touched
  UNION ALL SELECT seq, ms, 'project:' || workspace, 'all', workspace, CASE WHEN seq % 4 = 0 THEN 'project' ELSE 'directory' END, NULL, NULL FROM touched),
times AS (SELECT DISTINCT ms + 300000 + (seq % 3) * 60000 AS moment FROM touched WHERE seq % 97 = 0),
live AS (
  SELECT moment, id, arg_max(parent, seq) AS parent, arg_min(label, seq) AS label, arg_max(kind, seq) AS kind, max(ms) AS last_at, max(ms) + 660000 AS expires_at, coalesce(sum(weight), 0)::BIGINT AS weight, arg_max(outcome, seq) FILTER (outcome IS NOT NULL) AS outcome
  FROM times JOIN specs ON ms <= moment AND moment - ms <= 660000 GROUP BY moment, id)"""


def _specs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = src.lifecycle(spark, d).select("seq", activity.millis().alias("ms"), (F.col("tool_call") % 3).alias("t"), "workspace", "agent", "type", "status")
    none = F.lit(None).cast("string")
    outcome = F.when(F.col("type").endswith("ed") & (F.col("seq") % 3 == 0), F.col("status"))
    label = F.concat(F.lit("tool "), "t", F.when(F.col("seq") % 2 == 0, "").otherwise(" again"))
    tools = e.select("seq", "ms", F.concat(F.lit("group:activity:tool:t"), "t").alias("id"), none.alias("parent"), label.alias("label"), F.lit("tool").alias("kind"), F.lit(1).alias("weight"), outcome.alias("outcome"))
    places = e.select("seq", "ms", F.concat(F.lit("project:"), "workspace"), F.lit("all"), "workspace", F.when(F.col("seq") % 4 == 0, "project").otherwise("directory"), F.lit(None).cast("int"), none)
    times = e.where("seq % 97 = 0").select((F.col("ms") + 300_000 + (F.col("seq") % 3) * 60_000).alias("at")).distinct()
    return tools.union(places), times


@query(EVENTS + SPECS_SQL + " SELECT moment AS \"at\", id, coalesce(parent, '-') AS parent, label, kind, last_at, expires_at, weight, coalesce(outcome, '-') AS outcome FROM live")
def live_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups alive at a time behind every 97th event, with first label, last kind, weight and carried outcome."""
    return activity.live_groups(*_specs(spark, d)).fillna("-", ["parent", "outcome"])


@query(
    EVENTS
    + SPECS_SQL
    + """, told AS (SELECT moment, string_agg(id || coalesce(parent, '') || label || kind || last_at, ',' ORDER BY id) AS g FROM live GROUP BY moment),
agents AS (SELECT moment, agent AS id, max(ms) AS updated FROM times JOIN touched ON ms <= moment AND moment - ms <= 3600000 WHERE agent IS NOT NULL GROUP BY ALL),
seen AS (SELECT moment, string_agg(id || updated || (moment - updated >= 300000), ',' ORDER BY id) AS a FROM agents GROUP BY moment),
prints AS (SELECT moment, coalesce(g, '') || '/' || coalesce(a, '') AS p FROM told FULL JOIN seen USING (moment))
SELECT min(moment) AS first_at, count(*) AS times FROM prints GROUP BY p"""
)
def changed_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Which of the times show the same layout: those with one print."""
    specs, times = _specs(spark, d)
    e = src.lifecycle(spark, d).where("agent is not null").select("agent", activity.millis().alias("ms"))
    seen = activity.within(e.select(F.col("agent").alias("id"), "ms"), times, 3_600_000)
    agents = seen.select("at", "id", F.lit(None).cast("string").alias("parent"), F.col("id").alias("label"), F.col("last_at").alias("updated_at"))
    prints = activity.signatures(activity.live_groups(specs, times), agents)
    return prints.groupBy("signature").agg(F.min("at").alias("first_at"), F.count("*").alias("times")).drop("signature")


@query(EVENTS + " SELECT seq, session FROM lifecycle ORDER BY seq DESC LIMIT 10 OFFSET 20")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return activity.recent(src.lifecycle(spark, d), 2, 10).select("seq", "session")


@query(EVENTS + " SELECT session, CASE WHEN count(*) > 30 THEN 'partial' WHEN max_by(type, seq) = 'session.ended' THEN 'complete' ELSE 'active' END AS status FROM lifecycle GROUP BY session")
def recording_states(spark: SparkSession, d: str) -> DataFrame:
    return selection.recording_states(src.lifecycle(spark, d), 30)


@query("SELECT event_id FROM events WHERE event_id % 3 > 0")
def unacknowledged(spark: SparkSession, d: str) -> DataFrame:
    """A third of the spool has been acknowledged, by the digest of its body."""
    spool = table(spark, d, "events").select("event_id", F.concat_ws("|", "event_id", "event_type").alias("body"))
    return selection.acknowledged(spool, spool.where("event_id % 3 = 0").select(F.sha2("body", 256).alias("digest"))).select("event_id")


@query(
    """SELECT event_id AS request, CASE WHEN event_id % 11 = 0 THEN 415 WHEN event_id % 13 = 0 THEN 413 WHEN event_id % 7 = 0 THEN 400 WHEN event_id % 5 = 4 AND NOT ((event_id - 1) % 11 = 0 OR (event_id - 1) % 13 = 0 OR (event_id - 1) % 7 = 0) THEN 200 ELSE 202 END::BIGINT AS status FROM events"""
)
def received_events(spark: SparkSession, d: str) -> DataFrame:
    """Posted events: other content, bodies too long, without an id, and every fifth a repeat of the one before."""
    i = F.col("event_id")
    own = F.when(i % 5 == 4, i - 1).otherwise(i)
    body = F.concat(F.lit('{"session":"s","id":"'), own, F.lit('","pad":"'), F.when(i % 13 == 0, F.repeat(F.lit("x"), 70_000)).otherwise("y"), F.lit('"}'))
    requests = table(spark, d, "events").select(i.alias("request"), F.when(i % 11 == 0, "text/plain").otherwise("application/json; charset=utf-8").alias("content_type"), F.when((i % 7 == 0) & (i % 13 > 0), '{"session":"s"}').otherwise(body).alias("body"))
    return longs(selection.received(requests))


@query(
    """WITH p AS (SELECT p_partkey, 'src/d' || (p_partkey % 20) || '/m' || p_partkey AS m FROM part)
SELECT m || '.ts' AS file, p_partkey % 6 AS k, CASE p_partkey % 6 WHEN 0 THEN m || '.ts' WHEN 1 THEN 'src/lib/index.ts' WHEN 2 THEN '@scope/pkg' WHEN 3 THEN 'react' WHEN 4 THEN '-' ELSE '../../../out' END AS target,
  CASE p_partkey % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved' WHEN 4 THEN 'unresolved' ELSE 'external' END AS how, CASE WHEN p_partkey % 6 < 2 THEN 0.99 ELSE 0.25 END::DOUBLE AS confidence FROM p"""
)
def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    """Each module imports itself, a folder's index, a package or a part of one, something missing, or what lies outside."""
    k = F.col("p_partkey")
    m = table(spark, d, "part").select((k % 6).alias("k"), F.concat(F.lit("m"), k).alias("m"), F.concat(F.lit("src/d"), k % 20, F.lit("/m"), k).alias("path"))
    spec = F.when(F.col("k") == 0, F.concat(F.lit("./x/../"), "m")).when(F.col("k") == 1, "../lib").when(F.col("k") == 2, "@scope/pkg/deep/file").when(F.col("k") == 3, "react/jsx").when(F.col("k") == 4, "./missing").otherwise("../../../out")
    imports = m.select(F.concat("path", F.lit(".ts")).alias("file"), spec.alias("specifier"), "k")
    files = imports.select(F.col("file").alias("path")).union(spark.range(1).select(F.lit("src/lib/index.ts"))).union(imports.select(F.lit("src/lib/index.js")).limit(1))
    out = selection.resolve_imports(imports, files).join(imports, ["file", "specifier"])
    return out.select("file", "k", F.coalesce("target", F.lit("-")).alias("target"), "how", "confidence")
