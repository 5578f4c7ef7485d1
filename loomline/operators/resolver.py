"""What an event's resources stand for: a node of the graph, a group of it, or a group of their own.

``resources``: event, k (their order), node_id, kind, name, path, line, action, here (of the graph's
workspace), outside (of its root). ``nodes``: id, kind, namespace, file, row, end_row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import relative_to, slashes, within
from loomline.operators.history import path_suffixes
from loomline.storage import keep

# Families of commands that have a group each.
FAMILIES = ("tests", "git", "build")
MOST = 32


def _unique_files(nodes: DataFrame) -> DataFrame:
    """(suffix, file): trailing sub-paths that one file alone has."""
    files = nodes.where("file is not null").select("file").distinct()
    ends = files.select("file", F.explode(path_suffixes(F.col("file"))).alias("suffix"))
    return ends.groupBy("suffix").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n = 1").select("suffix", "file")


def files_of(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, file): the file that a path is, else the one that alone has its longest known suffix."""
    asked = paths.select("path").where("path is not null").distinct()
    exact = nodes.where("file is not null").select(F.col("file").alias("path")).distinct().withColumn("exact", F.col("path"))
    ends = asked.select("path", F.posexplode(path_suffixes(F.col("path"))).alias("k", "suffix"))
    near = ends.join(_unique_files(nodes), "suffix").groupBy("path").agg(F.min_by("file", "k").alias("near"))
    out = asked.join(exact, "path", "left").join(near, "path", "left")
    return out.select("path", F.coalesce("exact", "near").alias("file")).where("file is not null")


def _own_group(path: Column, kind: Column) -> Column:
    what = F.when(F.lower(F.coalesce(kind, F.lit(""))).contains("dir"), "directory").otherwise("file")
    return F.concat_ws(":", F.lit("group:activity"), what, path)


def resolve(resources: DataFrame, nodes: DataFrame, root: str, most: int = MOST) -> DataFrame:
    """(event, k, target, id, how): the targets of each event, in order of its resources, each once.

    A node that the event names stands for the whole event. Else, for each resource: addresses and
    families of commands have groups; of a path in the graph's root the file is looked up, exactly or by
    a suffix that is its alone; a line (or the one before) picks the smallest span around it; without a
    line the file's namespace is meant, else that namespace's group; paths of other workspaces, unknown
    ones and those outside the root get a group of their own if something was done with them.
    """
    named = resources.where("here and node_id is not null").join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    named = named.groupBy("event").agg(F.min_by("node_id", "k").alias("id"), F.min("k").alias("k"))
    rest = resources.join(named.select("event"), "event", "left_anti")
    path = slashes(F.col("path"))
    absolute = path.startswith("/") | path.rlike("^[A-Za-z]:/")
    r = rest.select(
        "event", "k", "kind", "name", path.alias("path"), "line", F.col("action").isNotNull().alias("done"), (F.col("here") & ~F.col("outside")).alias("inside"),
        (absolute & ~within(path, F.lit(root))).alias("foreign"), F.when(within(path, F.lit(root)), relative_to(path, F.lit(root))).otherwise(path).alias("key"),
    )
    r = keep(r, "resources")
    look = F.col("inside") & ~F.col("foreign") & F.col("key").isNotNull()
    found = files_of(r.where(look).select(F.col("key").alias("path")), nodes).withColumnRenamed("path", "key")
    r = r.join(found, "key", "left").withColumn("file", F.when(look, F.col("file")))
    spans = nodes.where("file is not null and row is not null").select("file", "row", F.coalesce("end_row", "row").alias("end"), F.col("id").alias("node"))
    # the span is the file's and line's alone: each place is looked up once, however many resources name it
    spans = spans.groupBy("file", "row", "end").agg(F.min("node").alias("node"))
    around = r.where("file is not null and line is not null").select("file", "line").distinct().join(spans, "file")
    around = around.where("line between row and end or line - 1 between row and end")
    around = around.groupBy("file", "line").agg(F.min(F.struct((F.col("end") - F.col("row")).alias("size"), "node")).alias("s")).select("file", "line", F.col("s.node").alias("span"))
    # of a file: its namespace's node, and the namespace of its first node that has one
    first = F.struct(F.coalesce("row", F.lit(0)).alias("row"), "id", "namespace")
    of_file = nodes.where("file is not null").groupBy("file").agg(F.min(F.when(F.col("kind") == "namespace", first)).alias("ns"), F.min(F.when(F.col("namespace").isNotNull(), first)).alias("member"))
    r = r.join(around, ["file", "line"], "left").join(of_file, "file", "left")
    external = F.when((F.col("kind") == "url") & F.col("name").isNotNull(), F.concat(F.lit("group:activity:web:"), "name")).when(F.col("kind").isin(*FAMILIES), F.concat(F.lit("group:activity:tool:"), "kind"))
    hit = lambda target, id_, how: F.struct(F.lit(target).alias("target"), id_.alias("id"), F.lit(how).alias("how"))
    own = F.when(F.col("done") | F.col("kind").isNotNull(), hit("group", _own_group(F.col("path"), F.col("kind")), "own"))
    target = (
        F.when(external.isNotNull(), hit("group", external, "external"))
        .when(F.col("path").isNull(), None)
        .when(~F.col("inside"), own)
        .when(F.col("foreign"), None)
        .when(F.col("file").isNull(), own)
        .when(F.col("span").isNotNull(), hit("node", F.col("span"), "span"))
        .when(F.col("line").isNull() & F.col("ns.id").isNotNull(), hit("node", F.col("ns.id"), "file"))
        .when(F.col("member.namespace").isNotNull(), hit("group", F.concat(F.lit("group:"), "member.namespace"), "group"))
        .otherwise(own)
    )
    out = r.select("event", "k", target.alias("t")).where("t is not null").select("event", "k", "t.target", "t.id", "t.how")
    out = out.groupBy("event", "target", "id").agg(F.min(F.struct("k", "how")).alias("f")).select("event", "f.k", "target", "id", "f.how")
    rank = F.row_number().over(Window.partitionBy("event").orderBy("k"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    return out.unionByName(named.select("event", "k", F.lit("node").alias("target"), "id", F.lit("node").alias("how")))
