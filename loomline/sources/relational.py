"""A dependency graph, its history and an activity stream derived from relational tables.

Parts are symbols, grouped in two-level namespaces by type and brand. A part that follows another in
an order depends on it; the kind of the dependency comes from the line's discount and return flag.
An order is a commit that changes the parts of its lines. Events are a user's activity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.storage import shares, table

#: Parts of brands that end so are external; the others belong to the project.
EXTERNAL_BRANDS = "5"
REQUIRES_DISCOUNT = 0.095

#: DuckDB text of the same derivation, as common table expressions.
GRAPH_SQL = """
symbols AS (
  SELECT 'var:' || p_partkey AS id, 'var' AS kind, p_name AS label, p_type || '.' || p_brand AS namespace, p_brand LIKE '%5' AS external,
    p_type || '/' || p_brand || '/' || p_name || '.src' AS file, (p_partkey % 1000 + 1)::INT AS row, (p_partkey % 1000 + 1 + p_size)::INT AS end_row
  FROM part),
nodes AS (
  SELECT id, kind, label, namespace, external, file, row, end_row FROM symbols
  UNION ALL SELECT 'namespace:' || namespace, 'namespace', namespace, namespace, bool_and(external), min(file), NULL, NULL FROM symbols GROUP BY namespace),
uses AS (
  SELECT CASE WHEN l_discount >= 0.095 THEN 'requires' WHEN l_returnflag = 'A' THEN 'mentions' ELSE 'calls' END AS kind,
    lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_discount) AS prev, l_partkey, l_orderkey, l_linenumber
  FROM lineitem),
edges AS (
  SELECT kind, 'var:' || prev AS source, 'var:' || l_partkey AS target, count(*) AS n, min(l_orderkey) AS first_order
  FROM uses WHERE prev IS NOT NULL GROUP BY ALL)"""


def symbols(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """The parts as symbols; ``key`` names a column for their numbers."""
    part = table(spark, sf_dir, "part")
    row = (F.col("p_partkey") % 1000 + 1).cast("int")
    return part.select(
        F.concat(F.lit("var:"), "p_partkey").alias("id"),
        F.lit("var").alias("kind"),
        F.col("p_name").alias("label"),
        F.concat_ws(".", "p_type", "p_brand").alias("namespace"),
        F.col("p_brand").endswith(EXTERNAL_BRANDS).alias("external"),
        F.concat("p_type", F.lit("/"), "p_brand", F.lit("/"), "p_name", F.lit(".src")).alias("file"),
        row.alias("row"),
        (row + F.col("p_size")).cast("int").alias("end_row"),
        *([F.col("p_partkey").alias(key)] if key else []),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = symbols(spark, sf_dir)
    spaces = own.groupBy("namespace").agg(F.bool_and("external").alias("external"), F.min("file").alias("file"))
    return own.unionByName(
        spaces.select(
            F.concat(F.lit("namespace:"), "namespace").alias("id"),
            F.lit("namespace").alias("kind"),
            F.col("namespace").alias("label"),
            "namespace",
            "external",
            "file",
            F.lit(None).cast("int").alias("row"),
            F.lit(None).cast("int").alias("end_row"),
        )
    )


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, source, target, order, line): one row for each occurrence of a dependency.

    Lines are dealt by their number, an order's to one task.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    kind = F.when(F.col("l_discount") >= REQUIRES_DISCOUNT, "requires").when(F.col("l_returnflag") == "A", "mentions").otherwise("calls")
    line = line.repartition(shares(line), "l_orderkey")
    found = line.select(kind.alias("kind"), F.lag("l_partkey").over(order).alias("prev"), "l_partkey", "l_orderkey", "l_linenumber")
    return found.where("prev is not null").select(
        "kind",
        F.concat(F.lit("var:"), "prev").alias("source"),
        F.concat(F.lit("var:"), "l_partkey").alias("target"),
        F.col("l_orderkey").alias("order"),
        F.col("l_linenumber").alias("line"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, source, target, n, first_order): occurrences collapsed, a source's edges in one task."""
    n = shares(table(spark, sf_dir, "lineitem"))
    return uses(spark, sf_dir).repartition(n, "source").groupBy("kind", "source", "target").agg(F.count("*").alias("n"), F.min("order").alias("first_order"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, ts, node, namespace, file): the symbols that each commit changes, once each.

    Joined by numbers, and dealt by the number of lines, so that no task's share grows with the table;
    a commit's rows lie in one task at the end.
    """
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("part"))
    n = shares(line)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"))
    own = symbols(spark, sf_dir, "part").select("part", "id", "namespace", "file")
    lines = line.repartition(n, "part").distinct().join(own.repartition(n, "part"), "part")
    lines = lines.repartition(n, "commit").join(orders.repartition(n, "commit"), "commit")
    return lines.select("commit", "ts", F.col("id").alias("node"), "namespace", "file")


CHANGES_SQL = """
changes AS (
  SELECT DISTINCT o_orderkey AS commit, o_orderdate AS ts, s.id AS node, namespace, file
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN symbols s ON s.id = 'var:' || l_partkey)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, session, type, status, tool_call, source, value): the event stream in arrival order."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("s"), "user_id").alias("session"),
        F.when(kind == "signup", "prompt.submitted").when(kind == "purchase", "turn.completed").when(kind == "click", "tool.started").when(kind == "view", "tool.completed").otherwise("error").alias("type"),
        F.when(kind == "error", "failed").otherwise("ok").alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tool_call"),
        "value",
    )


ACTIVITY_SQL = """
activity AS (
  SELECT event_id AS seq, ts, 's' || user_id AS session,
    CASE event_type WHEN 'signup' THEN 'prompt.submitted' WHEN 'purchase' THEN 'turn.completed' WHEN 'click' THEN 'tool.started' WHEN 'view' THEN 'tool.completed' ELSE 'error' END AS type,
    CASE event_type WHEN 'error' THEN 'failed' ELSE 'ok' END AS status,
    json_extract_string(props, '$.k')::BIGINT AS tool_call, value
  FROM events)"""


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, session, type, status, tool_call, agent, result, workspace): a stream with sessions, turns,
    tools, permissions and agents in it, in arrival order."""
    e, k = F.col("event_type"), F.col("event_id") % 10
    kind = (
        F.when((e == "signup") & (k == 0), "session.started").when(e == "signup", "prompt.submitted")
        .when((e == "purchase") & (k == 3), "session.ended").when(e == "purchase", "turn.completed")
        .when((e == "click") & (k < 6), "tool.started").when(e == "click", "permission.requested")
        .when((e == "view") & (k < 6), "tool.completed").when(e == "view", "permission.completed")
        .when(k < 5, "tool.failed").otherwise("error")
    )
    answered = (e == "view") & (k >= 6)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("s"), F.col("user_id") % 50).alias("session"),
        kind.alias("type"),
        F.when((e == "error") & (k == 9), "warning").when(e == "error", "failed").otherwise("ok").alias("status"),
        (F.get_json_object("props", "$.k").cast("bigint") % 5).alias("tool_call"),
        F.when(F.col("value") < 10, None).when(F.col("value") < 20, F.concat(F.lit("s"), F.col("user_id") % 50)).otherwise(F.concat(F.lit("a"), F.col("event_id") % 3)).alias("agent"),
        F.when(answered & (k == 6), "denied-by-user").when(answered & (k == 7), "denied-by-rules").when(answered, "approved").alias("result"),
        F.concat(F.lit("w"), F.col("user_id") % 7).alias("workspace"),
    )


LIFECYCLE_SQL = """
lifecycle AS (
  SELECT event_id AS seq, ts, 's' || (user_id % 50) AS session,
    CASE WHEN event_type = 'signup' AND event_id % 10 = 0 THEN 'session.started' WHEN event_type = 'signup' THEN 'prompt.submitted'
      WHEN event_type = 'purchase' AND event_id % 10 = 3 THEN 'session.ended' WHEN event_type = 'purchase' THEN 'turn.completed'
      WHEN event_type = 'click' AND event_id % 10 < 6 THEN 'tool.started' WHEN event_type = 'click' THEN 'permission.requested'
      WHEN event_type = 'view' AND event_id % 10 < 6 THEN 'tool.completed' WHEN event_type = 'view' THEN 'permission.completed'
      WHEN event_id % 10 < 5 THEN 'tool.failed' ELSE 'error' END AS type,
    CASE WHEN event_type = 'error' AND event_id % 10 = 9 THEN 'warning' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
    json_extract_string(props, '$.k')::BIGINT % 5 AS tool_call,
    CASE WHEN value < 10 THEN NULL WHEN value < 20 THEN 's' || (user_id % 50) ELSE 'a' || (event_id % 3) END AS agent,
    CASE WHEN event_type = 'view' AND event_id % 10 = 6 THEN 'denied-by-user' WHEN event_type = 'view' AND event_id % 10 = 7 THEN 'denied-by-rules' WHEN event_type = 'view' AND event_id % 10 > 7 THEN 'approved' END AS result,
    'w' || (user_id % 7) AS workspace
  FROM events)"""
