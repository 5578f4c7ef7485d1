"""Lookups, overlays and retention over the derived data, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import activity as act
from loomline.operators import graph, history, selection
from loomline.plans.graph_queries import BASE, NS_EDGES, longs
from loomline.plans.history_queries import BASE as HISTORY
from loomline.plans.history_queries import ORDER, SEEN
from loomline.sources import relational as src
from loomline.storage import table

EVENTS = "WITH " + src.ACTIVITY_SQL
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    BASE
    + """, asked AS (SELECT DISTINCT p_type || '.' || p_brand AS name FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT 'var:' || p_partkey FROM part),
hits AS (SELECT name, 0 AS rank, id, 'id' AS how FROM asked JOIN nodes ON id = name UNION ALL SELECT name, 1, id, 'label' FROM asked JOIN nodes ON label = name UNION ALL SELECT name, 2, id, 'namespace' FROM asked JOIN nodes ON namespace = name AND kind = 'namespace')
SELECT name, arg_min(id, (rank, id)) AS id, arg_min(how, (rank, id)) AS how FROM hits GROUP BY name"""
)
def resolved_selections(spark: SparkSession, d: str) -> DataFrame:
    n = src.nodes(spark, d)
    own = n.where("kind = 'var'")
    asked = own.select(F.col("namespace").alias("name")).union(own.select("label")).union(own.select("id"))
    return selection.resolve_selection(asked, n)


@query(
    BASE
    + """, spans AS (SELECT s.file, (l_suppkey % 300)::BIGINT AS a, (l_suppkey % 300 + l_linenumber)::BIGINT AS b FROM lineitem JOIN symbols s ON s.id = 'var:' || l_partkey WHERE l_returnflag = 'R')
SELECT id FROM symbols p WHERE NOT EXISTS (SELECT 1 FROM spans WHERE spans.file = p.file AND p.row BETWEEN a AND b)"""
)
def outside_spans(spark: SparkSession, d: str) -> DataFrame:
    own = src.symbols(spark, d)
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumn("id", F.concat(F.lit("var:"), "l_partkey")).join(own.select("id", "file"), "id")
    spans = line.select("file", (F.col("l_suppkey") % 300).alias("start"), (F.col("l_suppkey") % 300 + F.col("l_linenumber")).alias("end"))
    return selection.outside_spans(own.select("id", "file", F.col("row").alias("at")), spans).select("id")


@query(BASE + NS_EDGES + " SELECT c.id AS child, p.id AS parent, c.label AS name FROM links JOIN symbols c ON c.namespace = a JOIN symbols p ON p.namespace = b AND p.label = c.label WHERE a <> b")
def symbol_overrides(spark: SparkSession, d: str) -> DataFrame:
    return selection.overrides(src.uses(spark, d), src.nodes(spark, d))


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN 'detailed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def commit_overlay(spark: SparkSession, d: str) -> DataFrame:
    detail = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("detailed").alias("o_orderstatus")).distinct()
    return selection.overlay(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), detail, "o_orderkey")


@query(BASE + " SELECT label, CASE WHEN count(DISTINCT namespace) = 1 THEN min(namespace) ELSE 'made:' || label END AS target FROM symbols GROUP BY label")
def unique_targets(spark: SparkSession, d: str) -> DataFrame:
    own = src.symbols(spark, d)
    return selection.unique_target(own, own.select("label", F.col("namespace").alias("target")), "label")


@query(BASE + " SELECT s.id, round(least(1.9, greatest(0.72, 0.72 + 0.11 * log2(count(e.source) + 1))), 6)::DOUBLE AS size FROM symbols s LEFT JOIN edges e ON e.source = s.id GROUP BY s.id")
def node_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = src.edges(spark, d).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("m"))
    out = src.symbols(spark, d).select("id").join(e, "id", "left")
    return longs(out.select("id", selection.node_size(F.coalesce("m", F.lit(0))).alias("size")))


@query(BASE + " SELECT DISTINCT namespace AS path FROM symbols WHERE NOT external")
def visible_leaves(spark: SparkSession, d: str) -> DataFrame:
    return selection.visible_groups(selection.visible(src.nodes(spark, d), ("var",), external=False), leaves_only=True)


@query(BASE + " SELECT id FROM symbols WHERE id IN (SELECT source FROM edges UNION SELECT target FROM edges) AND NOT external")
def touched_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Project symbols that any edge touches."""
    e = src.edges(spark, d)
    ends = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return graph.project_graph(src.symbols(spark, d), e)[0].join(ends, "id", "left_semi").select("id")


@query(
    HISTORY
    + SEEN
    + ", firsts AS (SELECT ns, min(commit) AS first_commit FROM seen GROUP BY ns)"
    + ORDER
    + " SELECT p.i, count(*) AS nodes, min(node) AS first_node, max(node) AS last_node FROM changes JOIN place p USING (commit) GROUP BY p.i"
)
def history_frames(spark: SparkSession, d: str) -> DataFrame:
    changes = src.changes(spark, d)
    rows = changes.select("commit", "node").distinct().join(history.commit_order(changes), "commit")
    return longs(rows.groupBy("i").agg(F.count("*").alias("nodes"), F.min("node").alias("first_node"), F.max("node").alias("last_node")))


@query(
    EVENTS
    + """, w AS (SELECT *, CASE WHEN value > 40 THEN 'w' || tool_call END AS ws FROM activity),
f AS (SELECT session, seq, last_value(ws IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ws FROM w)
SELECT * FROM f WHERE ws IS NOT NULL"""
)
def sticky_workspaces(spark: SparkSession, d: str) -> DataFrame:
    e = src.activity(spark, d).withColumn("ws", F.when(F.col("value") > 40, F.concat(F.lit("w"), "tool_call")))
    return act.attributed(e, "ws").select("session", "seq", "ws")


@query(
    EVENTS
    + """, r AS (SELECT session, seq, row_number() OVER w AS n, sum(tool_call) OVER w AS b FROM activity WINDOW w AS (PARTITION BY session ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session, seq FROM r WHERE n <= 40 AND b <= 1500"""
)
def spool_retention(spark: SparkSession, d: str) -> DataFrame:
    return act.retained(src.activity(spark, d), F.col("tool_call"), 40, 1500).select("session", "seq")


@query("SELECT CASE WHEN code BETWEEN 200 AND 299 THEN 'delivered' WHEN code BETWEEN 400 AND 499 AND code NOT IN (408, 429) THEN 'dropped' ELSE 'retry' END AS outcome, count(*) AS n FROM (SELECT 200 + (event_id * 7) % 400 AS code FROM events) GROUP BY 1")
def delivery_outcomes(spark: SparkSession, d: str) -> DataFrame:
    code = 200 + (F.col("event_id") * 7) % 400
    return table(spark, d, "events").groupBy(act.delivery(code).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY l_orderkey), x AS (SELECT l_orderkey, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM t),
u AS (SELECT l_orderkey, p, min(i) AS i FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS r FROM u)
SELECT l_orderkey, string_agg(p, ',' ORDER BY i) AS resources FROM k WHERE r <= 4 GROUP BY l_orderkey"""
)
def merged_resources(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    ids = F.transform("a", lambda x: x["l_partkey"].cast("string"))
    return li.select("l_orderkey", F.array_join(act.merged_resources(ids, ids, most=4), ",").alias("resources"))


@query(
    EVENTS
    + """, p AS (SELECT seq, type, p_type || '.' || p_brand AS place, p_type AS top FROM activity JOIN part ON p_partkey = tool_call)
SELECT place AS path, max(seq) AS seq, arg_max(type, seq) AS type FROM p GROUP BY place UNION ALL SELECT top, max(seq), arg_max(type, seq) FROM p GROUP BY top"""
)
def latest_pulses(spark: SparkSession, d: str) -> DataFrame:
    own = src.symbols(spark, d).select(F.substring("id", 5, 20).cast("bigint").alias("tool_call"), "namespace")
    return act.latest_by_ancestor(src.activity(spark, d).join(own, "tool_call"), "namespace")


@query(EVENTS + ", n AS (SELECT max(ts) AS now FROM activity), l AS (SELECT session, max(ts) AS last FROM activity GROUP BY session) SELECT session, (epoch_us(now) // 1000) - (epoch_us(last) // 1000) AS idle_ms FROM l, n WHERE (epoch_us(now) // 1000) - (epoch_us(last) // 1000) >= 86400000")
def inactive_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = src.activity(spark, d)
    return act.inactive(e, F.lit(e.agg(F.max("ts")).first()[0]), 86_400_000)


@query(
    EVENTS
    + """, s AS (SELECT session, max(seq) % 3 = 0 AS active, max(seq) AS last_seq FROM activity GROUP BY session), k AS (SELECT *, row_number() OVER (ORDER BY active DESC, last_seq DESC, session) AS r FROM s)
SELECT session FROM k WHERE r > 20 AND NOT active"""
)
def evicted_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = src.activity(spark, d).groupBy("session").agg((F.max("seq") % 3 == 0).alias("active"), F.max("seq").alias("last_seq"))
    return act.evicted(s, 20)
