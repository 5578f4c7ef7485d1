"""Queries over text and parser output derived from the tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans.graph_queries import BASE, longs
from loomline.sources import git, ir, python_code
from loomline.sources import relational as src
from loomline.storage import keep, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, d: str) -> DataFrame:
    """One log of all orders: a header line for each, a path line for each of its lines."""
    o = table(spark, d, "orders")
    head = o.select(F.lit("log").alias("file"), (F.col("o_orderkey") * 100).alias("line_no"), F.concat_ws(git.SEPARATOR, F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("me"), "o_orderpriority").alias("text"))
    li = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    status = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "M").otherwise("R100")
    paths = F.concat(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("old/"), "l_suppkey", F.lit("\t"))).otherwise(""), F.lit("src/"), "l_partkey")
    body = li.select(F.lit("log").alias("file"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"), F.concat(status, F.lit("\t"), paths).alias("text"))
    return head.unionByName(body)


@query(
    """SELECT l_orderkey::VARCHAR AS hash, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'R' END AS status, 'src/' || l_partkey AS path,
coalesce(CASE WHEN l_returnflag = 'R' THEN 'old/' || l_suppkey END, '') AS old_path FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
)
def git_changes(spark: SparkSession, d: str) -> DataFrame:
    return git.parse_log(_log(spark, d))[1].fillna("", ["old_path"])


@query("SELECT o_orderkey::VARCHAR AS hash, o_orderdate::TIMESTAMP AS ts, 'me' AS author, o_orderpriority AS message FROM orders")
def git_commits(spark: SparkSession, d: str) -> DataFrame:
    return git.parse_log(_log(spark, d))[0].withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT 'src/' || l_partkey AS path, l_suppkey AS "start", l_suppkey + l_linenumber - 2 AS "end", count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL""")
def git_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Diffs with a file line and a hunk line for each order line; hunks of no new line have no range."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(_place()).alias("k"))
    head = li.select(F.col("l_orderkey").alias("file"), (2 * F.col("k")).alias("line_no"), F.concat(F.lit("+++ b/src/"), "l_partkey").alias("text"))
    hunk = li.select(F.col("l_orderkey").alias("file"), (2 * F.col("k") + 1).alias("line_no"), F.format_string("@@ -1,2 +%d,%d @@ x", "l_suppkey", F.col("l_linenumber") - 1).alias("text"))
    return longs(git.parse_hunks(head.unionByName(hunk)).groupBy("path", "start", "end").agg(F.count("*").alias("n")))


def _place():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


def _ir(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols as parser nodes and uses as relationships; some are unresolved, some ends are missing."""
    n = src.nodes(spark, d)
    status = F.when(F.col("external"), "external").when(F.col("label").startswith("red"), "unresolved").otherwise("resolved")
    nodes = n.select(
        "id", F.when(F.col("kind") == "namespace", "namespace").otherwise("symbol").alias("kind"), F.lit("function").alias("semantic"), F.col("label").alias("name"),
        F.when(F.col("kind") == "namespace", F.col("namespace")).otherwise(F.concat_ws("/", "namespace", "label")).alias("qualified"), "namespace", "file", F.lit("public").alias("visibility"), status.alias("status"),
    )
    e = src.edges(spark, d)
    target = F.when(F.col("first_order") % 17 == 0, F.concat("target", F.lit("?"))).otherwise(F.col("target"))
    rels = e.select(F.concat_ws(">", "kind", "source", "target").alias("id"), "kind", F.when(F.col("n") > 1, "calls").otherwise(F.col("kind")).alias("category"), "source", target.alias("target"), F.lit("resolved").alias("status"), (F.col("n") / 2).alias("confidence"), F.array(F.col("first_order").cast("string")).alias("occurrences"))
    occ = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("var:1").alias("owner"), F.lit("a.src").alias("file"), (F.col("o_orderkey") % 40).cast("int").alias("line"), F.lit(0).alias("column"), F.lit(20).alias("end_line"), F.lit(1).alias("end_column"))
    return nodes, rels, occ


IR = """, rels AS (SELECT kind, source, CASE WHEN first_order % 17 = 0 THEN target || '?' ELSE target END AS target, CASE WHEN n > 1 THEN 'calls' ELSE kind END AS category, n / 2 AS confidence, n FROM edges),
good AS (SELECT id FROM nodes WHERE external OR NOT starts_with(label, 'red'))"""


@query(
    BASE
    + IR
    + """ SELECT 'CATEGORY' AS code, count(*) AS n FROM rels WHERE category <> kind UNION ALL SELECT 'CONFIDENCE', count(*) FROM rels WHERE confidence > 1 HAVING count(*) > 0
UNION ALL SELECT 'TARGET_MISSING', count(*) FROM rels WHERE target NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'SPAN', count(*) FROM orders WHERE o_orderkey % 40 < 1 OR o_orderkey % 40 > 20"""
)
def ir_violations(spark: SparkSession, d: str) -> DataFrame:
    return ir.violations(*_ir(spark, d)).groupBy("code").agg(F.count("*").alias("n"))


@query(
    BASE
    + IR
    + """ SELECT 'edges' AS what, count(*) AS n FROM rels WHERE kind = category AND source IN (SELECT id FROM good) AND target IN (SELECT id FROM good)
UNION ALL SELECT 'DANGLING_ENDPOINT', count(*) FROM rels WHERE kind = category AND target NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'UNRESOLVED_ENDPOINT', count(*) FROM rels WHERE kind = category AND target IN (SELECT id FROM nodes) AND NOT (source IN (SELECT id FROM good) AND target IN (SELECT id FROM good))
UNION ALL SELECT 'nodes', count(*) FROM good"""
)
def ir_projection(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, notes = ir.project(*_ir(spark, d)[:2])
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(nodes, "nodes").unionByName(count(edges, "edges")).unionByName(notes.groupBy(F.col("code").alias("what")).agg(F.count("*").alias("n")))


#: A module for each part: ``#`` is its number, ``@`` the one before it (of the first, one that isn't there).
_MODULE = """import os
from pkg.m@ import Base@ as Up, tool@
{wild}

class Base#(Up):
    def run(self):
        self.own()
        self.up()
        tool@()
        len(self.x)
        missing()
        os.getcwd()
        helper#()
        def inner():
            inner2()
        def inner2():
            pass
    def own(self):
        pass
{up}
def helper#():
    pass

def tool#():
    return {kind}
"""


def _modules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.replace(F.lit(_MODULE), F.lit("{wild}"), F.when(k % 3 == 0, F.concat(F.lit("from pkg.star import *"), F.repeat(F.lit("\n"), (k % 7).cast("int")))).otherwise(""))
    text = F.replace(F.replace(text, F.lit("{up}"), F.when(k % 2 == 0, "    def up(self):\n        pass\n").otherwise("")), F.lit("{kind}"), (k % 5).cast("string"))
    text = F.replace(F.replace(text, F.lit("#"), k.cast("string")), F.lit("@"), F.when(k > 0, k - 1).otherwise(999_999_999).cast("string"))
    return table(spark, d, "part").select(F.concat(F.lit("src/pkg/m"), k, F.lit(".py")).alias("path"), text.alias("source"))


@query(
    """
WITH p AS (SELECT p_partkey AS k, if(p_partkey > 0, p_partkey - 1, 999999999) AS v, (p_partkey - 1) IN (SELECT p_partkey FROM part) AS has, CASE WHEN p_partkey % 3 = 0 THEN 'ambiguous' ELSE 'unresolved' END AS lost, CASE WHEN p_partkey % 3 = 0 THEN 0.35 ELSE 0.0 END AS odds, 'pkg.m' || p_partkey AS m, 'pkg.m' || p_partkey || '.Base' || p_partkey AS c, 'pkg.m' || if(p_partkey > 0, p_partkey - 1, 999999999) AS b FROM part)
SELECT c AS owner, 'inherits' AS fact, 'Up' AS name, b || '.Base' || v AS target, CASE WHEN has THEN 'resolved' ELSE 'external' END AS state, CASE WHEN has THEN 0.95 ELSE 0.65 END::DOUBLE AS confidence FROM p
UNION ALL SELECT c || '.run', 'calls', 'self.own', c || '.own', 'resolved', 0.85 FROM p
UNION ALL SELECT c || '.run', 'calls', 'self.up', CASE WHEN k % 2 = 0 THEN c || '.up' WHEN has THEN b || '.Base' || v || '.up' ELSE 'self.up' END, CASE WHEN k % 2 = 0 OR has THEN 'resolved' ELSE lost END, CASE WHEN k % 2 = 0 OR has THEN 0.85 ELSE odds END FROM p
UNION ALL SELECT c || '.run', 'calls', 'tool' || v, b || '.tool' || v, CASE WHEN has THEN 'resolved' ELSE 'external' END, CASE WHEN has THEN 0.95 ELSE 0.65 END FROM p
UNION ALL SELECT c || '.run', 'calls', 'len', 'builtins.len', 'external', 0.8 FROM p
UNION ALL SELECT c || '.run', 'calls', 'missing', 'missing', lost, odds FROM p
UNION ALL SELECT c || '.run', 'calls', 'os.getcwd', 'os.getcwd', 'external', 0.65 FROM p
UNION ALL SELECT c || '.run', 'calls', 'helper' || k, m || '.helper' || k, 'resolved', 0.9 FROM p
UNION ALL SELECT c || '.run.inner', 'calls', 'inner2', c || '.run.inner2', 'resolved', 0.85 FROM p"""
)
def python_names(spark: SparkSession, d: str) -> DataFrame:
    """What the names in a module for each part mean: imports, scopes, members of bases, the language's own."""
    found = keep(python_code.facts(_modules(spark, d)), "facts")
    return python_code.resolve(found).select("owner", "fact", "name", "target", "state", "confidence")


@query("SELECT 'pkg.m' || p_partkey || '.helper' || p_partkey AS name, 1::BIGINT AS alike FROM part UNION ALL SELECT 'pkg.m' || p_partkey || '.Base' || p_partkey || '.own', count(*) OVER () FROM part UNION ALL SELECT 'pkg.m' || p_partkey || '.tool' || p_partkey, 1 FROM part")
def python_prints(spark: SparkSession, d: str) -> DataFrame:
    """How many definitions have each one's print: equal code has one wherever it stands, other names or bodies don't."""
    # parsed once, though it is read twice
    found = keep(python_code.facts(_modules(spark, d)).where("fact = 'function' and (name like '%.own' or name rlike '[.](helper|tool)[0-9]+$')").select("name", "print"), "facts")
    alike = found.groupBy("print").agg(F.count("*").alias("alike"))
    return found.join(alike, "print").select("name", "alike")
