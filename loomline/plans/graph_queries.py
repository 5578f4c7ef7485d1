"""Queries over the derived dependency graph, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import architecture, graph, metrics, traverse
from loomline.sources import relational as src
from loomline.storage import fresh_path, keep, table

BASE = "WITH RECURSIVE " + src.GRAPH_SQL
NS_EDGES = """,
both_ns AS (SELECT e.*, s.namespace AS a, t.namespace AS b FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target),
ns_edges AS (
  SELECT a, b, sum(CASE WHEN kind = 'requires' THEN n ELSE 0 END)::BIGINT AS requires, sum(CASE WHEN kind = 'calls' THEN n ELSE 0 END)::BIGINT AS calls,
    sum(CASE WHEN kind = 'mentions' THEN n ELSE 0 END)::BIGINT AS mentions, sum(n)::BIGINT AS n,
    sum(n * CASE kind WHEN 'requires' THEN 3 WHEN 'calls' THEN 2 ELSE 1 END)::BIGINT AS weight
  FROM both_ns WHERE a <> b GROUP BY a, b),
spaces AS (SELECT namespace AS ns, bool_and(external) AS external, count(*) FILTER (kind = 'var') AS members FROM nodes GROUP BY namespace),
links AS (SELECT DISTINCT a, b FROM both_ns WHERE kind = 'requires')"""
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame, digits: int = 6) -> DataFrame:
    """Counts as bigint and doubles rounded, for comparison."""
    kinds = {"int": "bigint", "smallint": "bigint"}
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c).cast(kinds[k]).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


@query(BASE + " SELECT id, kind, label, namespace, external, file FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    raw = src.nodes(spark, d)
    # every node twice, an outdated copy first: the last one wins
    old = raw.withColumn("label", F.lit("outdated")).withColumn("pos", F.lit(0))
    return graph.normalize_nodes(old.unionByName(raw.withColumn("pos", F.lit(1))), "pos").select("id", "kind", "label", "namespace", "external", "file")


@query(BASE + " SELECT kind, source, target, n, first_order FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.normalize_edges(src.edges(spark, d), src.nodes(spark, d)).select("kind", "source", "target", "n", "first_order")


@query(
    BASE
    + """ SELECT 'nodes:' || kind AS measure, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges:' || kind, count(*) FROM edges GROUP BY kind
UNION ALL SELECT 'nodes:external', count(*) FILTER (external) FROM nodes UNION ALL SELECT 'edges:occurrences', sum(n)::BIGINT FROM edges"""
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(src.nodes(spark, d), src.edges(spark, d))


@query(BASE + " SELECT id, label FROM nodes WHERE contains(lower(label), 'red w') OR contains(lower(namespace), 'red w') OR contains(lower(file), 'red w') OR contains(lower(id), 'red w')")
def node_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.search(src.nodes(spark, d), "Red W").select("id", "label")


@query(BASE + " SELECT kind, source, target, n FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE NOT s.external AND NOT t.external".replace("SELECT kind,", "SELECT edges.kind,"))
def project_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.project_graph(src.nodes(spark, d), src.edges(spark, d))[1].select("kind", "source", "target", "n")


@query(
    BASE
    + """ SELECT id, CASE WHEN count(*) OVER (PARTITION BY namespace, kind, label) > 1 THEN label || ' · ' || regexp_extract(id, '[^:/]*$') ELSE label END AS display,
CASE WHEN row_number() OVER (PARTITION BY label ORDER BY id) > 1 THEN label || ' #' || row_number() OVER (PARTITION BY label ORDER BY id) ELSE label END AS numbered FROM nodes"""
)
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.numbered_labels(graph.display_labels(src.nodes(spark, d))).select("id", "display", "numbered")


@query(
    BASE
    + """ SELECT root, count(*) AS neighbours FROM (SELECT source AS root, target AS id FROM edges UNION SELECT target, source FROM edges UNION SELECT id, id FROM symbols) GROUP BY root"""
)
def neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(src.edges(spark, d), src.symbols(spark, d)).groupBy("root").agg(F.count("*").alias("neighbours"))


@query(BASE + NS_EDGES + " SELECT * FROM ns_edges")
def namespace_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.namespace_edges(src.edges(spark, d), src.nodes(spark, d))


@query(
    BASE
    + NS_EDGES
    + """ SELECT CASE WHEN x.external THEN b ELSE a END AS ns, count(*) AS boundary_edges, sum(weight)::BIGINT AS boundary_weight
FROM ns_edges JOIN spaces x ON x.ns = a JOIN spaces y ON y.ns = b WHERE x.external <> y.external GROUP BY 1"""
)
def namespace_boundary(spark: SparkSession, d: str) -> DataFrame:
    n = src.nodes(spark, d)
    return graph.boundary(graph.namespace_edges(src.edges(spark, d), n), graph.namespaces(n))


@query(
    BASE
    + """ SELECT keyword, count(*) AS uses, min(id) AS first_id, string_agg(DISTINCT namespace, ',' ORDER BY namespace) AS namespaces
FROM (SELECT id, namespace, unnest(string_split(lower(label), ' ')) AS keyword FROM symbols) WHERE keyword <> '' GROUP BY keyword"""
)
def keyword_usage(spark: SparkSession, d: str) -> DataFrame:
    return graph.keywords(src.nodes(spark, d))


@query(
    BASE
    + """ SELECT namespace AS path, 2::BIGINT AS depth, split_part(namespace, '.', 1) AS parent, count(*) AS symbols, max(row)::BIGINT AS max_row FROM symbols GROUP BY namespace
UNION ALL SELECT split_part(namespace, '.', 1), 1, '', count(*), max(row) FROM symbols GROUP BY 1"""
)
def hierarchy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return longs(graph.rollup(src.nodes(spark, d)))


@query(BASE + NS_EDGES + " SELECT a, b, kind, sum(n)::BIGINT AS n, count(*) AS edges FROM both_ns WHERE a <> b GROUP BY ALL")
def relationship_groups(spark: SparkSession, d: str) -> DataFrame:
    return graph.relationship_groups(src.edges(spark, d), src.nodes(spark, d))


@query(
    BASE
    + NS_EDGES
    + """, hard AS (SELECT * FROM both_ns WHERE kind <> 'mentions')
SELECT ns, external, members, coalesce((SELECT sum(n) FROM hard WHERE a = ns AND b <> ns), 0)::BIGINT AS outgoing, coalesce((SELECT sum(n) FROM hard WHERE b = ns AND a <> ns), 0)::BIGINT AS incoming,
  coalesce((SELECT sum(n) FROM hard WHERE a = ns AND b = ns), 0)::BIGINT AS internal, coalesce((SELECT sum(n) FROM both_ns WHERE kind = 'mentions' AND a = ns), 0)::BIGINT AS mentions,
  (SELECT count(DISTINCT b) FROM hard WHERE a = ns AND b <> ns) AS uses, (SELECT count(DISTINCT a) FROM hard WHERE b = ns AND a <> ns) AS used_by FROM spaces"""
)
def namespace_dossier(spark: SparkSession, d: str) -> DataFrame:
    return graph.dossier(src.edges(spark, d), src.nodes(spark, d))


DEGREES = """,
pair AS (SELECT a, b, sum(ln(1 + n)) AS w, sum(n) AS n FROM both_ns WHERE kind = 'requires' GROUP BY a, b),
degrees AS (
  SELECT ns, (SELECT count(*) FROM pair WHERE b = ns) AS fan_in, (SELECT count(*) FROM pair WHERE a = ns) AS fan_out,
    (SELECT count(*) FROM (SELECT b FROM pair WHERE a = ns UNION SELECT a FROM pair WHERE b = ns)) AS degree,
    coalesce((SELECT sum(w) FROM pair WHERE a = ns), 0) + coalesce((SELECT sum(w) FROM pair WHERE b = ns AND a <> b), 0) AS weighted_degree,
    coalesce((SELECT sum(n) FROM pair WHERE a = ns AND b = ns), 0)::BIGINT AS self_links,
    coalesce((SELECT sum(n) FROM both_ns WHERE kind = 'mentions' AND a = ns), 0)::BIGINT AS mentions
  FROM spaces)"""


@query(BASE + NS_EDGES + DEGREES + " SELECT ns, fan_in, fan_out, degree, round(weighted_degree, 6) AS weighted_degree, self_links, mentions FROM degrees")
def namespace_degrees(spark: SparkSession, d: str) -> DataFrame:
    return longs(metrics.degrees(src.edges(spark, d), src.nodes(spark, d)))


@query(
    BASE
    + NS_EDGES
    + """ SELECT CASE WHEN x.external THEN b ELSE a END AS ns, sum(CASE WHEN x.external THEN n ELSE 0 END)::BIGINT AS external_in, sum(CASE WHEN y.external THEN n ELSE 0 END)::BIGINT AS external_out
FROM both_ns JOIN spaces x ON x.ns = a JOIN spaces y ON y.ns = b WHERE both_ns.kind = 'requires' AND x.external <> y.external GROUP BY 1"""
)
def external_surface(spark: SparkSession, d: str) -> DataFrame:
    return metrics.external_surface(src.edges(spark, d), src.nodes(spark, d))


REACH = ", reach AS (SELECT ns AS s, ns AS t FROM spaces UNION SELECT s, b FROM reach JOIN links ON a = t), cyc AS (SELECT x.s AS ns, min(x.t) AS root, count(*) AS cycle_size FROM reach x JOIN reach y ON x.s = y.t AND x.t = y.s GROUP BY x.s)"


@query(BASE + NS_EDGES + REACH + " SELECT ns, root, cycle_size FROM cyc")
def dependency_cycles(spark: SparkSession, d: str) -> DataFrame:
    n = src.nodes(spark, d)
    roots = metrics.cycles(metrics.links(src.edges(spark, d), n), graph.namespaces(n).select(F.col("ns").alias("id")))
    by = roots.groupBy("root").agg(F.min("id").alias("first"), F.count("*").alias("cycle_size"))
    return roots.join(by, "root").select(F.col("id").alias("ns"), F.col("first").alias("root"), "cycle_size")


RANK = """, outs AS (SELECT a, count(*) AS k FROM links GROUP BY a), total AS (SELECT count(*) AS m FROM spaces),
ranks AS (
  SELECT 0 AS i, ns, 1.0::DOUBLE / m AS rank FROM spaces, total
  UNION ALL
  SELECT i + 1, ns, 0.15 / m + 0.85 * (got + loose / m) FROM (
    SELECT DISTINCT r.i, t.ns, m, sum(CASE WHEN l.b IS NOT NULL THEN r.rank / o.k ELSE 0 END) OVER (PARTITION BY t.ns) AS got,
      sum(CASE WHEN o.k IS NULL THEN r.rank ELSE 0 END) OVER (PARTITION BY t.ns) AS loose
    FROM ranks r CROSS JOIN spaces t CROSS JOIN total LEFT JOIN outs o ON o.a = r.ns LEFT JOIN links l ON l.a = r.ns AND l.b = t.ns WHERE r.i < 24))"""


@query(BASE + NS_EDGES + RANK + " SELECT ns, round(rank, 6) AS rank FROM ranks WHERE i = 24")
def page_rank(spark: SparkSession, d: str) -> DataFrame:
    n = src.nodes(spark, d)
    ranks = metrics.page_rank(metrics.links(src.edges(spark, d), n), graph.namespaces(n).select(F.col("ns").alias("id")))
    return ranks.select(F.col("id").alias("ns"), F.round("rank", 6).alias("rank"))


BETWEEN = """, arcs AS (SELECT a, b FROM links WHERE a <> b),
dist AS (
  SELECT ns AS s, ns AS t, 0 AS d FROM spaces
  UNION SELECT s, b, d + 1 FROM dist JOIN arcs ON a = t WHERE d < 12),
short AS (SELECT s, t, min(d) AS d FROM dist GROUP BY s, t),
sigma AS (
  SELECT s, t, 0 AS d, 1.0::DOUBLE AS paths FROM short WHERE d = 0
  UNION ALL
  SELECT g.s, x.t, g.d + 1, sum(g.paths)::DOUBLE FROM sigma g JOIN arcs ON arcs.a = g.t JOIN short x ON x.s = g.s AND x.t = arcs.b AND x.d = g.d + 1 GROUP BY g.s, x.t, g.d),
score AS (
  SELECT v.t AS ns, sum(v.paths * w.paths / st.paths) AS betweenness FROM sigma v JOIN sigma w ON w.s = v.t JOIN sigma st ON st.s = v.s AND st.t = w.t AND st.d = v.d + w.d
  WHERE v.s <> v.t AND v.t <> w.t AND v.s <> w.t GROUP BY v.t)"""


@query(BASE + NS_EDGES + BETWEEN + " SELECT ns, round(coalesce(betweenness, 0), 6) AS betweenness FROM spaces LEFT JOIN score USING (ns)")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    n = src.nodes(spark, d)
    out = metrics.betweenness(metrics.links(src.edges(spark, d), n), graph.namespaces(n).select(F.col("ns").alias("id")))
    return out.select(F.col("id").alias("ns"), F.round("score", 6).alias("betweenness"))


COHESION = """, inner_calls AS (SELECT source, target FROM both_ns WHERE kind = 'calls' AND a = b UNION SELECT target, source FROM both_ns WHERE kind = 'calls' AND a = b),
grown AS (SELECT id, id AS other FROM symbols UNION SELECT id, target FROM grown JOIN inner_calls ON source = other),
roots AS (SELECT id, min(other) AS root FROM grown GROUP BY id),
held AS (SELECT namespace AS ns, count(*) AS members, count(DISTINCT root) AS components FROM roots JOIN symbols USING (id) GROUP BY namespace)"""


@query(BASE + NS_EDGES + COHESION + " SELECT ns, members, components, round(CASE WHEN members = 1 THEN 1.0 ELSE 1 - (components - 1) / (members - 1) END, 6)::DOUBLE AS cohesion FROM held")
def cohesion(spark: SparkSession, d: str) -> DataFrame:
    return longs(metrics.cohesion(src.edges(spark, d), src.nodes(spark, d)))


@query(
    BASE
    + NS_EDGES
    + DEGREES
    + REACH
    + RANK
    + BETWEEN
    + """, m AS (
  SELECT ns, fan_in, fan_out, round(weighted_degree, 9) AS weighted_degree, cycle_size, round(rank, 9) AS rank, round(coalesce(betweenness, 0), 9) AS betweenness,
    CASE WHEN cycle_size > 1 THEN least(1.0, log2(cycle_size) / greatest(1.0, log2(max(cycle_size) OVER ()))) ELSE 0 END AS severity,
    CASE WHEN fan_in + fan_out > 0 THEN fan_out / (fan_in + fan_out) ELSE 0 END AS instability
  FROM degrees JOIN cyc USING (ns) JOIN (SELECT ns, rank FROM ranks WHERE i = 24) USING (ns) LEFT JOIN score USING (ns)),
p AS (SELECT *, """
    + ", ".join(f"CASE WHEN {c} > 0 THEN cume_dist() OVER (PARTITION BY {c} > 0 ORDER BY {c}) ELSE 0 END AS p_{c}" for c in ("weighted_degree", "rank", "betweenness", "instability", "fan_out", "fan_in"))
    + """ FROM m)
SELECT ns, fan_in, fan_out, cycle_size, round(0.4 * p_weighted_degree + 0.35 * p_rank + 0.25 * p_betweenness, 6)::DOUBLE AS connectedness,
  round(0.35 * p_instability + 0.25 * p_fan_out + 0.25 * severity + 0.15 * p_fan_in, 6)::DOUBLE AS overdependency FROM p"""
)
def namespace_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = longs(metrics.namespace_metrics(src.edges(spark, d), src.nodes(spark, d)))
    return out.select("ns", "fan_in", "fan_out", "cycle_size", "connectedness", "overdependency")


def _arcs(spark: SparkSession, d: str, kinds=("requires", "calls")) -> DataFrame:
    e = src.edges(spark, d).where(F.col("kind").isin(*kinds))
    return e.select(F.concat_ws(">", "source", "target").alias("arc"), F.col("source").alias("a"), F.col("target").alias("b")).distinct()


_ARCS = ", arcs AS (SELECT DISTINCT source AS a, target AS b, source || '>' || target AS arc FROM edges WHERE kind <> 'mentions')"


def _levels(direction: str) -> str:
    a, b = ("a", "b") if direction == "forward" else ("b", "a")
    out = "\n, l0 AS (SELECT 'var:1' AS id, 0 AS distance, '' AS path), s0 AS (SELECT * FROM l0)"
    for k in range(1, 4):
        out += f"""\n, l{k} AS (SELECT {b} AS id, {k} AS distance, min(path || ' ' || arc) AS path FROM l{k - 1} JOIN arcs ON {a} = l{k - 1}.id WHERE {b} NOT IN (SELECT id FROM s{k - 1}) GROUP BY {b})
, s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})"""
    return out


@query(BASE + _ARCS + _levels("forward") + " SELECT id, distance::BIGINT AS distance, trim(path) AS path FROM s3")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("var:1",)], "id string")
    return longs(traverse.blast_radius(_arcs(spark, d), roots).withColumn("path", F.array_join("path", " ")))


@query(BASE + _ARCS + _levels("reverse") + " SELECT namespace AS ns, count(*) AS affected, min(distance)::BIGINT AS nearest FROM s3 JOIN symbols USING (id) GROUP BY namespace")
def reverse_impact(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("var:1",)], "id string")
    reached = traverse.blast_radius(_arcs(spark, d), roots, "reverse")
    own = src.symbols(spark, d).select("id", F.col("namespace").alias("ns"))
    return longs(reached.join(own, "id").groupBy("ns").agg(F.count("*").alias("affected"), F.min("distance").alias("nearest")))


@query(BASE + NS_EDGES + BETWEEN + " SELECT s, t AS id, d::BIGINT AS distance FROM short WHERE d <= 4")
def namespace_distances(spark: SparkSession, d: str) -> DataFrame:
    n = src.nodes(spark, d)
    pairs = metrics.links(src.edges(spark, d), n).where("a <> b")
    return longs(traverse.distances(pairs, graph.namespaces(n).select(F.col("ns").alias("id")), 4))


@query(BASE + NS_EDGES + REACH + " SELECT DISTINCT s AS id FROM reach WHERE t IN (SELECT namespace FROM symbols WHERE external)")
def invalidated(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces that depend, over any number of steps, on one with an external symbol."""
    n = src.nodes(spark, d)
    back = metrics.links(src.edges(spark, d), n).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return metrics.reachable(back, n.where("kind = 'var' and external").select(F.col("namespace").alias("id")))


@query(
    BASE
    + NS_EDGES
    + BETWEEN
    + """, ends AS (SELECT min(ns) AS x, max(ns) AS y FROM spaces), want AS (SELECT d FROM short, ends WHERE s = x AND t = y),
walks AS (
  SELECT x AS spot, x AS path, 0 AS d FROM ends
  UNION ALL SELECT b, path || '>' || b, w.d + 1 FROM walks w JOIN arcs ON a = spot CROSS JOIN want CROSS JOIN ends JOIN short z ON z.s = b AND z.t = y AND z.d = want.d - w.d - 1
    WHERE w.d < want.d)
SELECT path, d::BIGINT AS distance FROM walks, ends WHERE spot = y ORDER BY string_split(path, '>') LIMIT 5"""
)
def connection_paths(spark: SparkSession, d: str) -> DataFrame:
    n = src.nodes(spark, d)
    ends = graph.namespaces(n).agg(F.min("ns").alias("x"), F.max("ns").alias("y")).first()
    return longs(traverse.shortest_paths(metrics.links(src.edges(spark, d), n), ends["x"], ends["y"]))


def _spaces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = src.nodes(spark, d)
    return graph.namespace_edges(src.edges(spark, d), n), graph.namespaces(n)


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return architecture.sequential_communities(*_spaces(spark, d))


@query()
def communities_synchronous(spark: SparkSession, d: str) -> DataFrame:
    return architecture.communities(*_spaces(spark, d))


ASSIGNED = ", assigned AS (SELECT ns, split_part(ns, '.', 2) AS community FROM spaces), roots AS (SELECT ns, split_part(ns, '.', 1) AS community FROM spaces)"


def _assigned(spaces: DataFrame, k: int) -> DataFrame:
    return spaces.select("ns", F.split_part("ns", F.lit("."), F.lit(k)).alias("community"))


@query(
    BASE
    + NS_EDGES
    + ASSIGNED
    + """, e AS (SELECT weight, x.community AS ca, y.community AS cb FROM ns_edges JOIN assigned x ON x.ns = a JOIN assigned y ON y.ns = b),
g AS (SELECT community, count(*) AS members, coalesce((SELECT sum(weight) FROM e WHERE ca = community AND cb = community), 0)::BIGINT AS inner,
  coalesce((SELECT sum(weight) FROM e WHERE ca <> cb AND (ca = community OR cb = community)), 0)::BIGINT AS outer FROM assigned GROUP BY community)
SELECT community, members, g.inner AS inside, g.outer AS outside, round(g.outer / greatest(1, g.inner + g.outer), 6)::DOUBLE AS strength FROM g""".replace("AS inner,", "AS \"inner\",").replace("AS outer FROM", "AS \"outer\" FROM").replace("g.inner", 'g."inner"').replace("g.outer", 'g."outer"')
)
def community_stats(spark: SparkSession, d: str) -> DataFrame:
    e, spaces = _spaces(spark, d)
    out = architecture.community_stats(_assigned(spaces, 2), e)
    return longs(out.withColumnRenamed("inner", "inside").withColumnRenamed("outer", "outside"))


@query(
    BASE
    + NS_EDGES
    + ASSIGNED
    + """, counts AS (SELECT community, split_part(ns, '.', 1) AS root, count(*) AS n FROM assigned GROUP BY ALL),
top AS (SELECT community, arg_min(root, (-n, root)) AS usual, max(n) AS most, sum(n) AS total FROM counts GROUP BY community)
SELECT ns, community, split_part(ns, '.', 1) AS root, usual, round(least(1.0, 0.5 + most / total / 2), 6)::DOUBLE AS score FROM assigned JOIN top USING (community) WHERE split_part(ns, '.', 1) <> usual"""
)
def hierarchy_drift(spark: SparkSession, d: str) -> DataFrame:
    return longs(architecture.drift_candidates(_assigned(_spaces(spark, d)[1], 2)))


@query(
    BASE
    + NS_EDGES
    + ASSIGNED
    + """, sh AS (SELECT x.community AS old, y.community AS new, count(*) AS k FROM roots x JOIN assigned y USING (ns) GROUP BY ALL),
j AS (SELECT old, new, k / ((SELECT count(*) FROM roots WHERE community = old) + (SELECT count(*) FROM assigned WHERE community = new) - k) AS jaccard FROM sh)
SELECT old, arg_min(new, (-jaccard, new)) AS new, round(max(jaccard), 6)::DOUBLE AS jaccard FROM j GROUP BY old"""
)
def community_drift(spark: SparkSession, d: str) -> DataFrame:
    spaces = _spaces(spark, d)[1]
    return longs(architecture.community_drift(_assigned(spaces, 1), _assigned(spaces, 2)))


@query(
    BASE
    + NS_EDGES
    + """, reach AS (SELECT ns AS s, ns AS t FROM spaces UNION SELECT s, b FROM reach JOIN ns_edges ON a = t),
cyc AS (SELECT x.s AS ns, count(*) > 1 AS cyclic FROM reach x JOIN reach y ON x.s = y.t AND x.t = y.s GROUP BY x.s),
place AS (SELECT ns, row_number() OVER (ORDER BY split_part(lower(ns), '.', 1), split_part(lower(regexp_replace(ns, '#.*', '')), '.', 2), regexp_extract(ns, '[0-9]+$')::INT, ns) - 1 AS at FROM spaces)
SELECT e.a, e.b, x.at AS row, y.at AS col, e.weight, coalesce(r.weight, 0) AS back,
  CASE WHEN c.cyclic OR f.cyclic THEN 'cyclic' WHEN r.weight IS NULL THEN 'layered' WHEN r.weight > e.weight THEN 'backward-heavy' ELSE 'acyclic' END AS signal
FROM ns_edges e JOIN place x ON x.ns = e.a JOIN place y ON y.ns = e.b JOIN cyc c ON c.ns = e.a JOIN cyc f ON f.ns = e.b LEFT JOIN ns_edges r ON r.a = e.b AND r.b = e.a"""
)
def dependency_matrix(spark: SparkSession, d: str) -> DataFrame:
    return longs(architecture.matrix(*_spaces(spark, d)))


EVIDENCE = """, seen_at AS (SELECT uses.kind, s.id AS source, t.id AS target, CASE WHEN l_orderkey % 2 = 0 THEN s.file ELSE t.file END AS file, (l_orderkey * 10 + l_linenumber)::BIGINT AS row
  FROM uses JOIN symbols s ON s.id = 'var:' || prev JOIN symbols t ON t.id = 'var:' || l_partkey WHERE prev IS NOT NULL)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each use with a place: a line of its source's file, in odd orders of its target's."""
    of = src.symbols(spark, d).select("id", "file")
    u = src.uses(spark, d).join(of.select(F.col("id").alias("source"), F.col("file").alias("fs")), "source").join(of.select(F.col("id").alias("target"), F.col("file").alias("ft")), "target")
    return u.select("kind", "source", "target", F.when(F.col("order") % 2 == 0, F.col("fs")).otherwise(F.col("ft")).alias("file"), (F.col("order") * 10 + F.col("line")).cast("bigint").alias("row"))


@query(BASE + EVIDENCE + " SELECT kind, source, target, 2 * count(*) AS n, min(file) AS file, arg_min(row, (file, row)) AS row FROM seen_at GROUP BY kind, source, target")
def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence twice, as two on one line: each counts."""
    e = _evidence(spark, d)
    return graph.collapsed(e.unionByName(e))


@query(
    BASE
    + EVIDENCE
    + """, gone AS (SELECT DISTINCT file FROM symbols WHERE external), fresh AS (SELECT * FROM nodes WHERE file IN (SELECT file FROM gone) AND NOT external),
merged AS (SELECT id FROM nodes WHERE file NOT IN (SELECT file FROM gone) UNION SELECT id FROM fresh),
kept AS (SELECT * FROM seen_at WHERE file NOT IN (SELECT file FROM gone) UNION SELECT kind, source, target, file, row + 1 FROM seen_at WHERE file IN (SELECT file FROM gone) AND row % 3 = 0),
bare AS (SELECT DISTINCT 'mentions' AS kind, target AS source, source AS target FROM edges WHERE kind = 'requires' EXCEPT SELECT kind, source, target FROM seen_at),
old AS (SELECT id FROM nodes WHERE file IN (SELECT file FROM gone)),
every AS (SELECT kind, source, target, count(*) AS n, min(file) AS file, arg_min(row, (file, row)) AS row FROM kept GROUP BY ALL
  UNION ALL SELECT kind, source, target, 1, NULL, NULL FROM bare WHERE source NOT IN (SELECT id FROM old) AND target NOT IN (SELECT id FROM old) AND (kind, source, target) NOT IN (SELECT kind, source, target FROM kept))
SELECT kind, source, target, n, coalesce(file, '') AS file, coalesce(row, -1)::BIGINT AS row FROM every WHERE source IN (SELECT id FROM merged) AND target IN (SELECT id FROM merged)"""
)
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """The files with external symbols are analysed anew: a third of their occurrences is left, a line
    further down, their external symbols are gone, and edges without any occurrence lie beside them."""
    # both are read again and again
    n, e = src.nodes(spark, d), keep(_evidence(spark, d), "evidence")
    gone = n.where("kind = 'var' and external").select("file").distinct()
    inside = e.join(gone, "file", "left_semi").select(*e.columns)
    fresh = n.join(gone, "file", "left_semi").where("not external").select(*n.columns)
    edges = keep(src.edges(spark, d).select("kind", "source", "target", "n"), "edges")
    bare = edges.where("kind = 'requires'").select(F.lit("mentions").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).cast("bigint").alias("n")).distinct()
    known = edges.unionByName(bare.join(edges, graph.EDGE_KEY, "left_anti"))
    out = graph.merge(n, known, e, fresh, inside.where("row % 3 = 0").withColumn("row", F.col("row") + 1), gone)[1]
    return out.fillna({"file": "", "row": -1})


@query(
    BASE
    + """ SELECT 'node' AS what, id, coalesce(namespace, '') AS detail, 1::BIGINT AS n FROM nodes UNION ALL SELECT 'edge', kind || '>' || source || '>' || target, kind, n FROM edges
UNION ALL SELECT 'stats', 'edges:' || kind, '', count(*) FROM edges GROUP BY kind UNION ALL SELECT 'stats', 'nodes:' || kind, '', count(*) FROM nodes GROUP BY kind
UNION ALL SELECT 'stats', 'nodes:external', '', count(*) FILTER (external) FROM nodes UNION ALL SELECT 'stats', 'edges:occurrences', '', sum(n)::BIGINT FROM edges"""
)
def graph_written(spark: SparkSession, d: str) -> DataFrame:
    """The graph as it is read back from JSON."""
    path = fresh_path(spark, "graph")
    graph.write_graph(src.nodes(spark, d), src.edges(spark, d), path)
    nodes, edges = graph.read_graph(spark, path, "id string, namespace string", "kind string, source string, target string, n bigint")
    known = spark.read.schema("measure string, n bigint").json(f"{path}/stats")
    out = nodes.select(F.lit("node").alias("what"), "id", F.coalesce("namespace", F.lit("")).alias("detail"), F.lit(1).cast("bigint").alias("n"))
    out = out.unionByName(edges.select(F.lit("edge").alias("what"), F.concat_ws(">", "kind", "source", "target").alias("id"), F.col("kind").alias("detail"), "n"))
    return out.unionByName(known.select(F.lit("stats").alias("what"), F.col("measure").alias("id"), F.lit("").alias("detail"), "n"))


@query("SELECT l_orderkey, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT trim(u) AS x FROM unnest(list(l_partkey::VARCHAR) || list(l_linestatus)) AS t(u) WHERE trim(u) <> '')) AS ids FROM lineitem GROUP BY l_orderkey")
def united_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of two columns of an order's lines, padded with blanks, with blank ones among them."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).alias("a"), F.collect_list("l_linestatus").alias("b"))
    return li.select("l_orderkey", F.array_join(graph.united(F.col("a"), F.col("b"), F.array(F.lit(" "), F.lit(None).cast("string"))), ",").alias("ids"))
