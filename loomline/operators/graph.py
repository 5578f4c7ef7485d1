"""Normalisation, projection and aggregation of a dependency graph on DataFrames.

``nodes``: id, kind, label, namespace, external, file, row, end_row. ``edges``: kind, source, target, n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_KINDS = ("namespace", "var", "keyword")
EDGE_KINDS = ("requires", "calls", "mentions")
WEIGHTS = {"requires": 3, "calls": 2, "mentions": 1}


def normalize_nodes(raw: DataFrame, position: str) -> DataFrame:
    """Nodes by id, the last in load order wins; an unknown kind is a var, a missing id names its place."""
    kind = F.when(F.col("kind").isin(*NODE_KINDS), F.col("kind")).otherwise("var")
    fixed = raw.withColumn("kind", kind).withColumn("id", F.coalesce("id", F.concat_ws(":", kind, F.col(position).cast("string"))))
    columns = [c for c in fixed.columns if c not in ("id", position)]
    last = fixed.groupBy("id").agg(F.max_by(F.struct(*columns), position).alias("r"))
    return last.select("id", *[F.col(f"r.{c}").alias(c) for c in columns])


def normalize_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes; an unknown kind is a call, evidence counts at least once."""
    kind = F.when(F.col("kind").isin(*EDGE_KINDS), F.col("kind")).otherwise("calls")
    return between(raw.withColumn("kind", kind).withColumn("n", F.greatest(F.lit(1), F.coalesce("n", F.lit(1)))), nodes)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, n): nodes by kind, external nodes, edges by kind, occurrences."""
    by_kind = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{what}:"), "kind").alias("measure"), "n")
    external = nodes.agg(F.count_if("external").alias("n")).select(F.lit("nodes:external").alias("measure"), "n")
    occurrences = edges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("edges:occurrences").alias("measure"), "n")
    return by_kind(nodes, "nodes").unionByName(by_kind(edges, "edges")).unionByName(external).unionByName(occurrences)


def search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes that hold the text in label, namespace, file or id, whatever its case; blank finds all."""
    wanted = text.strip().lower()
    if not wanted:
        return nodes
    hit = F.lit(False)
    for c in ("label", "namespace", "file", "id"):
        hit = hit | F.coalesce(F.lower(c).contains(wanted), F.lit(False))
    return nodes.where(hit)


def project_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The project's own part: nodes that aren't external, and edges between them."""
    own = nodes.where(~F.coalesce("external", F.lit(False)))
    return own, between(edges, own)


def without_top_level(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch no namespace of a single segment."""
    top = nodes.where((F.col("kind") == "namespace") & ~F.col("label").rlike(r"[./]")).select("id")
    return edges.join(top.withColumnRenamed("id", "source"), "source", "left_anti").join(top.withColumnRenamed("id", "target"), "target", "left_anti")


def display_labels(nodes: DataFrame) -> DataFrame:
    """Labels; those that repeat within a namespace and kind get the id's last part appended."""
    group = Window.partitionBy("namespace", "kind", "label")
    many = F.count("*").over(group) > 1
    own = F.element_at(F.split("id", "[:/]"), -1)
    return nodes.withColumn("display", F.when(many, F.concat_ws(" · ", "label", own)).otherwise(F.col("label")))


def numbered_labels(nodes: DataFrame) -> DataFrame:
    """Labels; of equal ones the second and later get ``#k``."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return nodes.withColumn("numbered", F.when(k > 1, F.concat("label", F.lit(" #"), k)).otherwise(F.col("label")))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(root, id): ids one step away in either direction, and the root itself."""
    roots = ids.select(F.col("id").alias("root"))
    out = roots.join(edges, roots["root"] == edges["source"]).select("root", F.col("target").alias("id"))
    back = roots.join(edges, roots["root"] == edges["target"]).select("root", F.col("source").alias("id"))
    return out.unionByName(back).unionByName(roots.select("root", F.col("root").alias("id"))).distinct()


def is_global_name(namespace: Column) -> Column:
    """Whether a namespace is none: missing, blank, or the global one."""
    return F.coalesce(namespace.isin("", "<global>"), F.lit(True))


def is_global(nodes: DataFrame) -> Column:
    return is_global_name(F.col("namespace"))


# Path segments that mark tests.
TEST_SEGMENTS = ("test", "tests", "spec", "specs", "__tests__", "testing")


def is_test(*texts: str) -> Column:
    """A segment that names tests, or a last segment ending in Test, Tests, Spec or Specs."""
    hit = F.lit(False)
    for c in texts:
        parts = F.split(F.coalesce(F.col(c), F.lit("")), r"[/.\\_-]+")
        hit = hit | F.exists(parts, lambda p: F.lower(p).isin(*TEST_SEGMENTS) | p.rlike("(Test|Tests|Spec|Specs)$"))
    return hit


def with_namespaces(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the namespaces of both ends as ``a`` and ``b``."""
    of = nodes.where("kind <> 'keyword'").select("id", F.coalesce("namespace", F.when(F.col("kind") == "namespace", F.col("label"))).alias("ns")).where("ns is not null")
    left = of.select(F.col("id").alias("source"), F.col("ns").alias("a"))
    right = of.select(F.col("id").alias("target"), F.col("ns").alias("b"))
    return edges.join(left, "source").join(right, "target")


def namespaces(nodes: DataFrame) -> DataFrame:
    """(ns, external, members): external where all members are."""
    known = nodes.where("kind <> 'keyword' and namespace is not null")
    return known.groupBy(F.col("namespace").alias("ns")).agg(F.bool_and("external").alias("external"), F.count_if(F.col("kind") == "var").alias("members"))


def namespace_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, requires, calls, mentions, n, weight): dependencies between different namespaces."""
    pairs = with_namespaces(edges, nodes).where("a <> b")
    weight = F.lit(0)
    for k, w in WEIGHTS.items():
        weight = weight + F.when(F.col("kind") == k, F.col("n") * w).otherwise(0)
    by = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in EDGE_KINDS]
    return pairs.groupBy("a", "b").agg(*by, F.sum("n").alias("n"), F.sum(weight).alias("weight"))


def boundary(ns_edges: DataFrame, spaces: DataFrame) -> DataFrame:
    """(ns, boundary_edges, boundary_weight): links between project and external namespaces, by project namespace."""
    ext = spaces.select("ns", "external")
    both = ns_edges.join(ext.select(F.col("ns").alias("a"), F.col("external").alias("ea")), "a").join(ext.select(F.col("ns").alias("b"), F.col("external").alias("eb")), "b")
    own = both.where("ea <> eb").withColumn("ns", F.when(F.col("ea"), F.col("b")).otherwise(F.col("a")))
    return own.groupBy("ns").agg(F.count("*").alias("boundary_edges"), F.sum("weight").alias("boundary_weight"))


def keywords(nodes: DataFrame) -> DataFrame:
    """(keyword, uses, first_id, namespaces): words of labels, with their first use and namespaces."""
    used = nodes.where("kind = 'var'").select("id", "namespace", F.explode(F.split(F.lower("label"), " +")).alias("keyword"))
    return used.where("keyword <> ''").groupBy("keyword").agg(
        F.count("*").alias("uses"), F.min("id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("namespace")), ",").alias("namespaces")
    )


def rollup(nodes: DataFrame) -> DataFrame:
    """(path, depth, parent, symbols, heaviest): every prefix of the namespaces with what lies below it."""
    parts = F.split("namespace", r"[./:]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("path"), k.alias("depth")))
    rows = nodes.where("kind = 'var' and namespace is not null").select("id", "row", F.explode(prefixes).alias("p"))
    out = rows.groupBy(F.col("p.path").alias("path"), F.col("p.depth").alias("depth")).agg(F.count("*").alias("symbols"), F.max("row").alias("max_row"))
    return out.withColumn("parent", F.when(F.col("depth") > 1, F.regexp_replace("path", r"\.[^.]*$", "")).otherwise(""))


def relationship_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, kind, n, edges): relationships between namespaces, self ones left out."""
    return with_namespaces(edges, nodes).where("a <> b").groupBy("a", "b", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("edges"))


def dossier(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counters of each namespace: incoming, outgoing and own relations, mentions, neighbours, symbols."""
    e = with_namespaces(edges, nodes)
    view = e.select(F.col("a").alias("ns"), F.col("b").alias("other"), F.lit("out").alias("way"), "kind", "n").unionByName(
        e.where("a <> b").select(F.col("b").alias("ns"), F.col("a").alias("other"), F.lit("in").alias("way"), "kind", "n")
    )
    own = F.col("ns") == F.col("other")
    out, into = (F.col("way") == "out") & ~own, F.col("way") == "in"
    hard = F.col("kind") != "mentions"
    agg = view.groupBy("ns").agg(
        F.sum(F.when(out & hard, F.col("n")).otherwise(0)).alias("outgoing"),
        F.sum(F.when(into & hard, F.col("n")).otherwise(0)).alias("incoming"),
        F.sum(F.when(own & hard, F.col("n")).otherwise(0)).alias("internal"),
        F.sum(F.when(~hard & (F.col("way") == "out"), F.col("n")).otherwise(0)).alias("mentions"),
        F.count_distinct(F.when(out & hard, F.col("other"))).alias("uses"),
        F.count_distinct(F.when(into & hard, F.col("other"))).alias("used_by"),
    )
    return namespaces(nodes).join(agg, "ns", "left").select("ns", "external", "members", *[F.coalesce(c, F.lit(0)).alias(c) for c in agg.columns[1:]])


def hierarchy_key(c: Column) -> Column:
    """Sort key of dotted names: segment by segment, without case, numbers by value."""
    padded = F.regexp_replace(F.lower(c), r"(\d+)", "000000000000$1")
    return F.regexp_replace(F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1"), r"[./:]", "\u0001")


EDGE_KEY = ["kind", "source", "target"]


def collapsed(evidence: DataFrame) -> DataFrame:
    """(kind, source, target, n, file, row): edges with all their occurrences counted, and the first one's place.

    A missing file sorts first, a missing row last.
    """
    place = F.struct(F.coalesce("file", F.lit("")).alias("f"), F.coalesce("row", F.lit(2**62)).alias("r"), "file", "row")
    edges = evidence.groupBy(*EDGE_KEY).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return edges.select(*EDGE_KEY, "n", "first.file", "first.row")


def merge(
    base_nodes: DataFrame, base_edges: DataFrame, base_evidence: DataFrame, delta_nodes: DataFrame, delta_evidence: DataFrame, changed_files: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Incremental update: (nodes, edges) of a graph after some files were analysed anew.

    Base nodes of changed files go, the delta's replace or add. Occurrences (kind, source, target, file,
    row) in changed files go, the delta's are united with the rest, and edges are what they make; an
    edge that has lost all its occurrences is gone. ``base_edges`` without any occurrence stay as they
    are, unless an end lay in a changed file. Edges without an end among the nodes go.
    """
    files = changed_files.select("file").distinct()
    nodes = base_nodes.join(files, "file", "left_anti").join(delta_nodes.select("id"), "id", "left_anti").select(*base_nodes.columns).unionByName(delta_nodes)
    kept = base_evidence.join(files, "file", "left_anti").select(*EDGE_KEY, "file", "row")
    found = collapsed(kept.unionByName(delta_evidence.select(*EDGE_KEY, "file", "row")).distinct())
    moved = base_nodes.join(files, "file", "left_semi").select("id")
    bare = base_edges.join(base_evidence.select(*EDGE_KEY), EDGE_KEY, "left_anti").join(found.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    for end in ("source", "target"):
        bare = bare.join(moved.withColumnRenamed("id", end), end, "left_anti")
    bare = bare.select(*EDGE_KEY, "n", F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("row"))
    return nodes, between(found.unionByName(bare), nodes)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as JSON lines, a folder each for nodes, edges and the counts; written anew."""
    for name, df in (("nodes", nodes), ("edges", edges), ("stats", stats(nodes, edges))):
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_graph`` wrote, by the schemas of both tables."""
    return spark.read.schema(nodes).json(f"{path}/nodes"), spark.read.schema(edges).json(f"{path}/edges")


def united(*lists: Column) -> Column:
    """Lists of ids as one: trimmed, blank ones left out, sorted, without repeats."""
    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
