"""Lookups and overlays: what a name stands for, what lies outside of spans, what overrides what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.graph import with_namespaces
from loomline.storage import keep


def resolve_selection(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id, how): the node that a name selects: by id, else label, else namespace; ties by id."""
    by = [("id", nodes.select(F.col("id").alias("name"), "id")), ("label", nodes.select(F.col("label").alias("name"), "id")), ("namespace", nodes.where("kind = 'namespace'").select(F.col("namespace").alias("name"), "id"))]
    found = None
    for rank, (how, df) in enumerate(by):
        one = asked.select("name").distinct().join(df.groupBy("name").agg(F.min("id").alias("id")), "name").select("name", F.struct(F.lit(rank).alias("rank"), "id", F.lit(how).alias("how")).alias("hit"))
        found = one if found is None else found.union(one)
    best = found.groupBy("name").agg(F.min("hit").alias("hit"))
    return asked.select("name").distinct().join(best, "name", "left").select("name", "hit.id", "hit.how")


def outside_spans(points: DataFrame, spans: DataFrame, bin_lines: int = 64) -> DataFrame:
    """The points (file, at, ...) that no closed span (file, start, end) of their file holds.

    Spans are dealt to bins of lines and points look into one bin, so it is an equi anti-join.
    """
    cells = spans.where("start <= end").select("file", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bin_lines), F.floor(F.col("end") / bin_lines))).alias("bin"))
    p = points.withColumn("bin", F.floor(F.col("at") / bin_lines))
    hit = (p["file"] == cells["file"]) & (p["bin"] == cells["bin"]) & (p["at"] >= cells["start"]) & (p["at"] <= cells["end"])
    return p.join(cells, hit, "left_anti").drop("bin")


def overrides(edges: DataFrame, nodes: DataFrame, each: int = 256, task_pairs: int = 25_000_000) -> DataFrame:
    """(child, parent, name): symbols of a namespace that bear the name of one in a namespace it requires.

    Symbols of one namespace and name are lists of at most ``each``. Required namespaces meet list by
    list, and two lists are written out where they lie: there are as many rows as pairs of equal names,
    which are counted first, so that a task writes about ``task_pairs`` of them.
    """
    pairs = keep(with_namespaces(edges.where("kind = 'requires'"), nodes).where("a <> b").select("a", "b").distinct(), "pairs")
    own = nodes.where("kind = 'var'").select("id", "namespace", "label")
    size = own.groupBy("namespace", "label").agg(F.count("*").alias("n"))
    met = pairs.join(size.select(F.col("namespace").alias("a"), "label", F.col("n").alias("m")), "a").join(size.withColumnRenamed("namespace", "b"), ["b", "label"])
    # by number: the rows that come out have no part in the bytes that go in
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-(met.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0) // task_pairs))
    own = own.join(size, ["namespace", "label"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / each)))
    lists = own.groupBy("namespace", "label", "part").agg(F.collect_list("id").alias("ids"))
    child = lists.select(F.col("namespace").alias("a"), F.col("label").alias("name"), F.col("ids").alias("children"))
    parent = lists.select(F.col("namespace").alias("b"), F.col("label").alias("name"), F.col("ids").alias("parents"))
    met = pairs.join(child, "a").repartition(tasks, "b", "name").join(parent.repartition(tasks, "b", "name"), ["b", "name"])
    return met.select(F.explode("children").alias("child"), "parents", "name").select("child", F.explode("parents").alias("parent"), "name")


def overlay(base: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Base rows with the detail's values where it has any."""
    rest = [c for c in base.columns if c != key]
    d = detail.select(key, *[F.col(c).alias(f"_{c}") for c in rest if c in detail.columns])
    joined = base.join(d, key, "left")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in detail.columns else F.col(c) for c in rest])


def multiplicity(*columns: str) -> Column:
    """The first of the columns that is a number of at least 0; else 1."""
    return F.coalesce(*[F.when(~F.isnan(F.col(c).cast("double")) & (F.col(c) >= 0), F.col(c)) for c in columns], F.lit(1))


def unique_target(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, target): the known target where exactly one has the key, else one made of the key."""
    one = known.groupBy(key).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    return asked.select(key).distinct().join(one, key, "left").select(key, F.coalesce("target", F.concat(F.lit("made:"), F.col(key).cast("string"))).alias("target"))


def node_size(measure: Column) -> Column:
    """Size factor of a node: a clamped logarithm of its measure."""
    return F.least(F.lit(1.9), F.greatest(F.lit(0.72), 0.72 + 0.11 * F.log2(measure + 1)))


def smoothstep(p: Column) -> Column:
    return p * p * (3 - 2 * p)


def visible(nodes: DataFrame, kinds: tuple[str, ...], external: bool = True) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds) & (F.lit(external) | ~F.col("external")))


def visible_groups(shown: DataFrame, leaves_only: bool = False) -> DataFrame:
    """(path): prefixes of the visible namespaces; with ``leaves_only`` those that are nobody's parent."""
    parts = F.split("namespace", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    paths = shown.where("namespace is not null").select(F.explode(prefixes).alias("path")).distinct()
    if not leaves_only:
        return paths
    parents = paths.select(F.regexp_extract("path", r"^(.*)\.[^.]*$", 1).alias("path")).distinct()
    return paths.join(parents, "path", "left_anti")


def chosen(rows: DataFrame, column: str, values: list[str] | None, invert: bool = False) -> DataFrame:
    """Rows of the chosen values; None chooses all. ``invert`` gives the others, to be dimmed."""
    if values is None:
        return rows.limit(0) if invert else rows
    hit = F.coalesce(F.col(column).isin(values), F.lit(False))
    return rows.where(~hit if invert else hit)


def solo(values: list[str] | None, one: str) -> list[str] | None:
    """The choice after a click on one value: that alone, or all again if it was alone."""
    return None if values == [one] else [one]


def same_workspace(a: str, b: str, parts: tuple[str, ...] = ("id", "repository", "root")) -> Column:
    """Two workspace structs agree wherever both name a part."""
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(F.col(f"{a}.{p}") == F.col(f"{b}.{p}"), F.lit(True))
    return out


def calls_from_usages(usages: DataFrame, definitions: DataFrame, include_external: bool = False) -> DataFrame:
    """(source, target, external, n): uses whose source is defined; external targets only if asked for.

    usages: source, target. definitions: id.
    """
    known = definitions.select("id").distinct().withColumn("known", F.lit(True))
    own = usages.join(known.select(F.col("id").alias("source")), "source", "left_semi")
    out = own.join(known.withColumnRenamed("id", "target"), "target", "left").withColumn("external", F.col("known").isNull())
    if not include_external:
        out = out.where(~F.col("external"))
    return out.groupBy("source", "target", "external").agg(F.count("*").alias("n"))


def stable_json(df: DataFrame) -> DataFrame:
    """(json): each row as compact JSON with its keys in order."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("json"))


def whitelisted(c: str, *values: str) -> Column:
    """The value if it is one of those allowed, else null."""
    return F.when(F.col(c).isin(*values), F.col(c))


def evidence_line(*candidates: str) -> Column:
    """The first known line of an evidence; lines below 1 don't count."""
    return F.coalesce(*[F.when(F.col(c) >= 1, F.col(c)) for c in candidates])


def glyphs(requires: Column, calls: Column, mentions: Column) -> Column:
    """Short form of what links two namespaces: ``r2 c m``; a count of one isn't shown."""
    one = lambda letter, n: F.when(n > 1, F.concat(F.lit(letter), n.cast("string"))).when(n == 1, letter)
    return F.concat_ws(" ", one("r", requires), one("c", calls), one("m", mentions))


def explicit_node(metadata: str, node: str, resources: str) -> Column:
    """The node an event names: in its metadata, itself, or by its first resource that does."""
    first = F.get(F.filter(resources, lambda r: r["node_id"].isNotNull()), F.lit(0))["node_id"]
    return F.coalesce(F.try_element_at(F.col(metadata), F.lit("graphNodeId")), F.col(node), first)


def layered(groups: DataFrame, rays: DataFrame, hidden: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Groups (id, kind) without those of hidden kinds, and rays (source, target) without those to hidden groups."""
    gone = groups.where(F.col("kind").isin(*hidden)).select("id").distinct() if hidden else groups.limit(0).select("id")
    return groups.join(gone, "id", "left_anti"), rays.join(gone.withColumnRenamed("id", "target"), "target", "left_anti")


def listed(recordings: DataFrame, workspace: str | None = None, session: str | None = None) -> DataFrame:
    """Recordings of a workspace and of a session, newest first; None asks for all."""
    for column, value in (("workspace", workspace), ("session", session)):
        if value is not None:
            recordings = recordings.where(F.col(column) == value)
    return recordings.orderBy(F.desc("created"), F.desc("recording_id"))


def revision_mode(asked: Column, cached: Column, parent: Column) -> Column:
    """How to get at a revision: cached if it is the one at hand, incremental if its parent is, else full."""
    return F.when(F.coalesce(asked == cached, F.lit(False)), "cached").when(F.coalesce(parent == cached, F.lit(False)), "incremental").otherwise("full")


#: Bytes of a posted event at most.
BODY_BYTES = 64 << 10


def received(requests: DataFrame) -> DataFrame:
    """(request, status): what each posted event is answered, in order of arrival.

    ``requests``: request, content_type, body. 415 for other than JSON, 413 for a body beyond the limit, 400
    for one that isn't an object with session and id, 202 for a new event and 200 for a repeated one.
    """
    at = lambda p: F.get_json_object("body", p)
    key = F.when(at("$.session").isNotNull() & at("$.id").isNotNull(), F.concat_ws("\u0000", F.coalesce(at("$.source"), F.lit("default")), at("$.session"), at("$.id")))
    bad = (
        F.when(~F.coalesce(F.lower("content_type").startswith("application/json"), F.lit(False)), 415)
        .when(F.octet_length("body") > BODY_BYTES, 413).when(key.isNull(), 400)
    )
    rows = requests.select("request", bad.alias("bad"), F.when(bad.isNull(), key).alias("key"))
    first = rows.where("key is not null").groupBy("key").agg(F.min("request").alias("first"))
    out = rows.join(first, "key", "left")
    return out.select("request", F.coalesce("bad", F.when(F.col("first") == F.col("request"), 202).otherwise(200)).alias("status"))


def acknowledged(spool: DataFrame, acks: DataFrame) -> DataFrame:
    """What a spool still has to send: rows whose digest (sha256 of their body) nobody has acknowledged."""
    return spool.withColumn("digest", F.sha2("body", 256)).join(acks.select("digest").distinct(), "digest", "left_anti")


def recording_states(events: DataFrame, most: int) -> DataFrame:
    """(session, status): complete once a terminal event is the last, partial beyond a number of events,
    else active."""
    out = events.groupBy("session").agg(F.max_by("type", "seq").alias("last"), F.count("*").alias("n"))
    return out.select("session", F.when(F.col("n") > most, "partial").when(F.col("last") == "session.ended", "complete").otherwise("active").alias("status"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier, target, how, confidence): what a module's import stands for.

    ``imports``: file, specifier. ``files``: path. Relative specifiers are folded against the file's
    folder and looked up as they are, with an extension, or as a folder's index; others are packages.
    """
    from loomline.functions.text import folded

    # What may follow a specifier, in order.
    ends = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")
    relative = F.col("specifier").startswith(".")
    place = folded(F.concat(F.regexp_extract("file", "^(.*/)?[^/]*$", 1), "specifier"))
    asked = imports.select("file", "specifier").distinct().select("file", "specifier", relative.alias("relative"), F.when(relative, place).alias("place"))
    tries = asked.where("place is not null").select("file", "specifier", F.posexplode(F.array(*[F.concat("place", F.lit(e)) for e in ends])).alias("k", "path"))
    hits = tries.join(files.select("path").distinct(), "path").groupBy("file", "specifier").agg(F.min_by("path", "k").alias("hit"))
    package = F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    how = F.when(F.col("hit").isNotNull(), "resolved").when(~F.col("relative") | F.col("place").isNull(), "external").otherwise("unresolved")
    out = asked.join(hits, ["file", "specifier"], "left").withColumn("how", how)
    target = F.when(F.col("how") == "resolved", F.col("hit")).when(F.col("how") == "external", F.when(F.col("relative"), F.col("specifier")).otherwise(package))
    return out.select("file", "specifier", target.alias("target"), "how", F.when(F.col("how") == "resolved", 0.99).otherwise(0.25).alias("confidence"))
