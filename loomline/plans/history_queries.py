"""Queries over the derived change history, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import history
from loomline.plans.graph_queries import BASE as GRAPH
from loomline.plans.graph_queries import longs
from loomline.sources import relational as src
from loomline.storage import table

BASE = GRAPH + "," + src.CHANGES_SQL
SEEN = """, seen AS (SELECT DISTINCT commit, namespace AS ns FROM changes), total AS (SELECT count(DISTINCT commit) AS m FROM seen), each AS (SELECT ns, count(*) AS k FROM seen GROUP BY ns),
pairs AS (SELECT x.ns AS a, y.ns AS b, count(*) AS c FROM seen x JOIN seen y ON x.commit = y.commit AND x.ns < y.ns GROUP BY ALL),
fixed AS (SELECT DISTINCT least(s.namespace, t.namespace) AS a, greatest(s.namespace, t.namespace) AS b FROM edges e JOIN symbols s ON s.id = e.source JOIN symbols t ON t.id = e.target WHERE e.kind = 'requires' AND s.namespace <> t.namespace),
coupled AS (
  SELECT a, b, c AS co_changes, c / m AS support, c / p.k AS conf_a, c / q.k AS conf_b, greatest(c / p.k, c / q.k) AS confidence, c / (p.k + q.k - c) AS jaccard, c * m / (p.k * q.k) AS lift, fixed.a IS NOT NULL AS is_static
  FROM pairs JOIN each p ON p.ns = a JOIN each q ON q.ns = b CROSS JOIN total LEFT JOIN fixed USING (a, b))"""
ORDER = ", place AS (SELECT commit, row_number() OVER (ORDER BY ts, commit) - 1 AS i FROM (SELECT DISTINCT commit, ts FROM changes))"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _static(spark: SparkSession, d: str) -> DataFrame:
    return history.static_pairs(src.edges(spark, d).where("kind = 'requires'"), src.symbols(spark, d))


_PICK = " SELECT a, b, co_changes, round(support, 9) AS support, round(conf_a, 9) AS conf_a, round(conf_b, 9) AS conf_b, round(confidence, 9) AS confidence, round(jaccard, 9) AS jaccard, round(lift, 9) AS lift, is_static, NOT is_static AND co_changes >= 2 AND confidence >= 0.5 AS hidden FROM coupled"


@query(BASE + SEEN + _PICK)
def temporal_coupling(spark: SparkSession, d: str) -> DataFrame:
    return longs(history.temporal_coupling(history.observations(src.changes(spark, d)), _static(spark, d)), 9)


@query(BASE + SEEN + _PICK + " ORDER BY co_changes DESC, coupled.lift DESC, coupled.confidence DESC, a, b LIMIT 48")
def top_coupling(spark: SparkSession, d: str) -> DataFrame:
    return longs(history.temporal_coupling(history.observations(src.changes(spark, d)), _static(spark, d), max_pairs=48), 9)


@query(BASE + SEEN + " SELECT ns, k AS commits FROM each")
def observed_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return history.observations(src.changes(spark, d)).groupBy("ns").agg(F.count("*").alias("commits"))


@query(
    BASE
    + SEEN
    + ORDER
    + " SELECT x.ns AS a, y.ns AS b, count(DISTINCT p.i) AS follows FROM seen x JOIN place p ON p.commit = x.commit JOIN place q ON q.i > p.i AND q.i <= p.i + 2 JOIN seen y ON y.commit = q.commit WHERE x.ns <> y.ns GROUP BY ALL"
)
def lagged_coupling(spark: SparkSession, d: str) -> DataFrame:
    changes = src.changes(spark, d)
    return history.lagged_coupling(history.observations(changes), history.commit_order(changes))


@query(
    BASE
    + """, per AS (SELECT o_orderkey AS commit, count(node) AS n FROM orders LEFT JOIN changes ON commit = o_orderkey GROUP BY ALL)
SELECT count(*) AS commits, count(*) FILTER (n > 0) AS observable, sum(n)::BIGINT AS changes, 0::BIGINT AS unmapped, round(count(*) FILTER (n > 0) / count(*), 6) AS share, count(*) FILTER (n = 1) AS single FROM per"""
)
def history_coverage(spark: SparkSession, d: str) -> DataFrame:
    commits = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"))
    return longs(history.coverage(src.changes(spark, d), commits))


@query(
    BASE
    + """, recent AS (SELECT DISTINCT commit, ts FROM changes ORDER BY ts DESC, commit DESC LIMIT 2000)
SELECT node, count(*) AS edits, round(CASE WHEN count(*) < 3 THEN 0 ELSE least(1.0, (count(*) - 2) / 4) END, 6)::DOUBLE AS heat FROM changes WHERE commit IN (SELECT commit FROM recent) GROUP BY node"""
)
def edit_heat(spark: SparkSession, d: str) -> DataFrame:
    return longs(history.edit_heat(src.changes(spark, d), last=2000))


@query(
    BASE
    + SEEN
    + ORDER
    + " SELECT ns, max(k)::BIGINT AS most FROM (SELECT ns, count(*) OVER (PARTITION BY ns ORDER BY i RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS k FROM seen JOIN place USING (commit)) GROUP BY ns"
)
def rolling_edits(spark: SparkSession, d: str) -> DataFrame:
    changes = src.changes(spark, d)
    return history.rolling_edits(history.observations(changes), history.commit_order(changes))


@query(
    BASE
    + ORDER
    + """, rows AS (SELECT i, node, row_number() OVER (PARTITION BY i ORDER BY node) - 1 AS k FROM changes JOIN place USING (commit)),
spans AS (SELECT i, greatest(1000, count(*) * 40) AS span FROM rows GROUP BY i),
offs AS (SELECT i, coalesce(sum(span) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM spans), fin AS (SELECT sum(span) AS e FROM spans)
SELECT node, max(off + k * 40)::BIGINT AS updated_ms, round(greatest(0.0, least(1.0, 1 - (max(e) - max(off + k * 40)) / 30000)), 6)::DOUBLE AS decay FROM rows JOIN offs USING (i) CROSS JOIN fin GROUP BY node"""
)
def playback(spark: SparkSession, d: str) -> DataFrame:
    changes = src.changes(spark, d)
    return longs(history.playback(changes, history.commit_order(changes)))


RANGES = """, ranges AS (SELECT s.file, (l_suppkey % 900)::BIGINT AS "start", (l_suppkey % 900 + l_quantity)::BIGINT AS "end" FROM lineitem JOIN symbols s ON s.id = 'var:' || l_partkey WHERE l_returnflag = 'R'),
touched AS (SELECT DISTINCT s.file FROM lineitem JOIN symbols s ON s.id = 'var:' || l_partkey WHERE l_returnflag <> 'N' AND l_discount > 0.05)"""


def _ranges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, d, "lineitem").withColumn("id", F.concat(F.lit("var:"), "l_partkey")).join(src.symbols(spark, d).select("id", "file"), "id")
    lo = F.col("l_suppkey") % 900
    ranges = line.where("l_returnflag = 'R'").select("file", lo.alias("start"), (lo + F.col("l_quantity")).cast("bigint").alias("end"))
    return ranges, line.where("l_returnflag <> 'N' and l_discount > 0.05").select("file").distinct()


@query(
    GRAPH
    + RANGES
    + """ SELECT id FROM nodes n WHERE row IS NOT NULL AND EXISTS (SELECT 1 FROM ranges r WHERE r.file = n.file AND n.row <= r."end" AND r."start" <= n.end_row)
UNION SELECT id FROM nodes WHERE row IS NULL AND file IN (SELECT file FROM touched)
UNION SELECT id FROM nodes WHERE row IS NOT NULL AND file IN (SELECT file FROM touched) AND file NOT IN (SELECT file FROM ranges)"""
)
def changed_elements(spark: SparkSession, d: str) -> DataFrame:
    return history.changed_elements(src.nodes(spark, d), *_ranges(spark, d))


@query(
    GRAPH
    + """, parts AS (SELECT DISTINCT file AS l FROM symbols), tails AS (SELECT DISTINCT split_part(file, '/', 2) || '/' || split_part(file, '/', 3) AS r FROM symbols UNION SELECT DISTINCT split_part(file, '/', 3) FROM symbols)
SELECT l, r FROM parts JOIN tails ON l = r OR l LIKE '%/' || r OR r LIKE '%/' || l"""
)
def suffix_matches(spark: SparkSession, d: str) -> DataFrame:
    files = src.symbols(spark, d).select(F.col("file").alias("path")).distinct()
    short = files.select(F.regexp_replace("path", "^[^/]*/", "").alias("path")).union(files.select(F.element_at(F.split("path", "/"), -1).alias("path"))).distinct()
    return history.suffix_join(files, short)
