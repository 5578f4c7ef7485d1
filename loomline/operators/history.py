"""Change history: co-change mining, lagged coupling, edit heat, playback decay, changed elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.graph import with_namespaces
from loomline.operators.ordering import numbered, running_totals
from loomline.storage import discard, keep, shares

HEAT_COMMITS = 20
DECAY_MS = 30_000


def observations(changes: DataFrame, partial: bool = True) -> DataFrame:
    """(commit, ns): the namespaces that each commit touches.

    Without ``partial``, commits with a change that belongs to no namespace are left out.
    """
    if not partial:
        lost = changes.where("namespace is null").select("commit").distinct()
        changes = changes.join(lost, "commit", "left_anti")
    return changes.where("namespace is not null").select("commit", F.col("namespace").alias("ns")).distinct()


def _pairs(seen: DataFrame) -> DataFrame:
    """(a, b, co_changes): commits that touch both namespaces, a < b.

    Commits are reduced to the sets of namespaces that they touch, and each distinct set is paired up
    once; pairs are counted before they are shuffled.
    """
    sets = seen.groupBy("commit").agg(F.array_sort(F.collect_set("ns")).alias("set")).groupBy("set").agg(F.count("*").alias("k"))
    left = sets.where("size(set) > 1").select("k", "set", F.posexplode("set").alias("at", "a"))
    return left.select("k", "a", F.explode(F.slice("set", F.col("at") + 2, F.size("set"))).alias("b")).groupBy("a", "b").agg(F.sum("k").alias("co_changes"))


def temporal_coupling(
    seen: DataFrame, static: DataFrame | None = None, min_co: int = 1, min_support: float = 0.0, min_confidence: float = 0.0, max_pairs: int | None = None
) -> DataFrame:
    """(a, b, co_changes, support, conf_a, conf_b, confidence, jaccard, lift, is_static, hidden).

    Pairs of namespaces that change together, most often first. ``static``: (a, b) dependencies.
    """
    n = seen.agg(F.count_distinct("commit").alias("n"))
    each = seen.groupBy("ns").agg(F.count("*").alias("k"))
    pairs = _pairs(seen).where(F.col("co_changes") >= min_co)
    out = pairs.join(each.select(F.col("ns").alias("a"), F.col("k").alias("ka")), "a").join(each.select(F.col("ns").alias("b"), F.col("k").alias("kb")), "b")
    # one row, so the cross join adds a column
    out = out.join(F.broadcast(n))
    c = F.col("co_changes")
    out = out.select(
        "a", "b", "co_changes", (c / F.col("n")).alias("support"), (c / F.col("ka")).alias("conf_a"), (c / F.col("kb")).alias("conf_b"),
        F.greatest(c / F.col("ka"), c / F.col("kb")).alias("confidence"), (c / (F.col("ka") + F.col("kb") - c)).alias("jaccard"), (c * F.col("n") / (F.col("ka") * F.col("kb"))).alias("lift"),
    )
    out = out.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
    if static is None:
        out = out.withColumn("is_static", F.lit(False))
    else:
        known = static.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().withColumn("_s", F.lit(True))
        out = out.join(known, ["a", "b"], "left").withColumn("is_static", F.coalesce("_s", F.lit(False))).drop("_s")
    out = out.withColumn("hidden", ~F.col("is_static") & (F.col("co_changes") >= 2) & (F.col("confidence") >= 0.5))
    if max_pairs is not None:
        out = out.orderBy(F.desc("co_changes"), F.desc_nulls_last("lift"), F.desc("confidence"), "a", "b").limit(max_pairs)
    return out


def static_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): namespaces that depend on each other in either direction and any kind."""
    e = with_namespaces(edges, nodes).where("a <> b")
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def lagged_coupling(seen: DataFrame, order: DataFrame, lag: int = 2) -> DataFrame:
    """(a, b, follows): commits with ``a`` that one of the next ``lag`` commits with ``b`` follows.

    ``order``: commit, i (0..). Each commit's set of namespaces is dealt to the few earlier positions it
    may answer to and united there, so a pair comes up once a commit and nothing has to be made distinct.
    """
    rows = seen.join(order, "commit")
    n = shares(order, 100_000)
    own = rows.repartition(n, "i").groupBy("i").agg(F.collect_set("ns").alias("own"))
    later = own.select("own", F.explode(F.transform(F.sequence(F.lit(1), F.lit(lag)), lambda k: F.col("i") - k)).alias("i"))
    later = later.repartition(n, "i").groupBy("i").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("later"))
    pairs = own.join(later, "i").select(F.explode("own").alias("a"), "later").select("a", F.explode("later").alias("b"))
    return pairs.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("follows"))


def coverage(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """One row of counters: commits, those with changes, mapped symbols, their share."""
    mapped = changes.groupBy("commit").agg(F.count("*").alias("n"), F.count_if(F.col("namespace").isNull()).alias("lost"))
    out = commits.select("commit").join(mapped, "commit", "left")
    return out.agg(
        F.count("*").alias("commits"), F.count("n").alias("observable"), F.coalesce(F.sum("n"), F.lit(0)).alias("changes"), F.coalesce(F.sum("lost"), F.lit(0)).alias("unmapped"),
        (F.count("n") / F.count("*")).alias("share"), F.count_if(F.col("n") == 1).alias("single"),
    )


def commit_order(changes: DataFrame) -> DataFrame:
    """(commit, i): place in the history, by time and id; their changes aren't moved."""
    return numbered(changes.select("commit", "ts").distinct(), ["ts", "commit"]).select("commit", "i")


def edit_heat(changes: DataFrame, last: int = HEAT_COMMITS) -> DataFrame:
    """(node, edits, heat): commits of the last ones that touch a node; under three are cold."""
    recent = changes.select("commit", "ts").distinct().orderBy(F.desc("ts"), F.desc("commit")).limit(last)
    counts = changes.join(F.broadcast(recent.select("commit")), "commit", "left_semi").select("commit", "node").distinct().groupBy("node").agg(F.count("*").alias("edits"))
    return counts.withColumn("heat", F.when(F.col("edits") < 3, 0.0).otherwise(F.least(F.lit(1.0), (F.col("edits") - 2) / 4)))


def rolling_edits(seen: DataFrame, order: DataFrame, last: int = HEAT_COMMITS, block: int = 10_000) -> DataFrame:
    """(ns, most): the most edits of a namespace within any ``last`` consecutive commits.

    Commits are cut into blocks; the last ones of a block are seen by the next one too, so a namespace
    that is edited all the time lies in many tasks.
    """
    block = max(block, last)
    rows = seen.join(order, "commit").select("ns", "i", F.expr(f"i div {block}").alias("block"))
    near = F.col("i") % block > block - last
    rows = rows.select("ns", "i", F.explode(F.when(near, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))).alias("at"))
    rows = rows.repartition(shares(order, 100_000), "ns", "at")
    w = Window.partitionBy("ns", "at").orderBy("i").rangeBetween(-(last - 1), 0)
    return rows.withColumn("k", F.count("*").over(w)).groupBy("ns").agg(F.max("k").alias("most"))


def playback(changes: DataFrame, order: DataFrame, step_ms: int = 40, frame_ms: int = 1_000) -> DataFrame:
    """(node, updated_ms, decay): when the playback shows a node last, and how far it has faded by its end.

    A frame lasts ``frame_ms`` or one step for each node that it shows; nodes come in order of id.
    """
    rows = changes.join(order, "commit").select("i", "node").distinct()
    place = rows.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("node")) - 1)
    span = place.groupBy("i").agg(F.greatest(F.lit(frame_ms), F.count("*") * step_ms).alias("span"))
    offset = running_totals(span, ["i"], upto=F.col("span")).select("i", (F.col("upto") - F.col("span")).alias("offset"))
    end = span.agg(F.sum("span").alias("end"))
    shown = place.join(offset, "i").groupBy("node").agg(F.max(F.col("offset") + F.col("k") * step_ms).alias("updated_ms"))
    out = shown.join(F.broadcast(end))
    return out.select("node", "updated_ms", decayed(F.col("end") - F.col("updated_ms")).alias("decay"))


def decayed(age_ms: Column, window_ms: int = DECAY_MS) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age_ms / window_ms))


def merge_duplicate_commits(commits: DataFrame) -> DataFrame:
    """Commits of one hash as one: changes united, flags combined, the earliest time."""
    return commits.groupBy("hash").agg(
        F.min("ts").alias("ts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("changed")))).alias("changed"), F.bool_or("metadata").alias("metadata"), F.bool_and("observable").alias("observable")
    )


def resolve_renames(paths: DataFrame, renames: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(path, now): each path under its latest name.

    A chain ends at a path that exists now (``current``, with a ``path`` column), at one that was never
    renamed, or where it closes: a path that leads into a circle gets the circle's first path on its
    way, one on a circle itself. Pointers double each round, so the rounds are the logarithm of the
    longest way to an end or a circle, whatever the number of renames. Of several new names of one path
    the smallest counts.
    """
    hops = renames.where("old is not null and new is not null").groupBy(F.col("old").alias("path")).agg(F.min("new").alias("next"))
    if current is not None:
        hops = hops.join(current.select("path").distinct(), "path", "left_anti")
    hops = keep(hops, "renames")
    ended, going = _followed(hops)
    circle = keep(going.select(F.col("end").alias("path")).distinct(), "renames")
    if not circle.isEmpty():
        into = going.select("path").join(circle, "path", "left_anti")
        ended = ended.union(_followed(keep(hops.join(into, "path", "left_semi"), "renames"))[0])
    return paths.join(ended, "path", "left").select("path", F.coalesce("end", "path").alias("now"))


def _followed(hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, end) of the paths whose hops end, and of those that go round, with a path on their circle.

    Rows are written again only while they lead on. The ends of those that do are ever fewer; once a
    round leaves them as they were, hops only move them among themselves: they are the circles' paths,
    all of them.
    """
    known = hops.select(F.col("path").alias("end"), F.lit(True).alias("open"))
    rows = keep(hops.withColumnRenamed("next", "end").join(known, "end", "left").select("path", "end", F.coalesce("open", F.lit(False)).alias("open")), "renames")
    ended, before = None, None
    while True:
        done = keep(rows.where("not open"), "renames")
        ended = done if ended is None else ended.union(done)
        going = rows.where("open")
        ends = going.agg(F.count_distinct("end")).first()[0]
        if ends in (0, before):
            return ended.select("path", "end"), going.select("path", "end")
        before = ends
        onward = ended.union(going).select(F.col("path").alias("end"), F.col("end").alias("next"), F.col("open").alias("on"))
        new = keep(going.join(onward, "end").select("path", F.col("next").alias("end"), F.col("on").alias("open")), "renames")
        discard(rows)
        rows = new


def path_prefixes(path: Column) -> Column:
    """The path and all its folders."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def path_suffixes(path: Column) -> Column:
    """All trailing sub-paths, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def suffix_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): paths where one is the other or ends with ``/`` and the other.

    An equi-join on exploded suffixes in both directions; never a comparison of all pairs.
    """
    a = left.select(F.col("path").alias("l")).distinct()
    b = right.select(F.col("path").alias("r")).distinct()
    ends = a.select("l", F.explode(path_suffixes(F.col("l"))).alias("s")).join(b, F.col("s") == F.col("r")).select("l", "r")
    other = b.select("r", F.explode(path_suffixes(F.col("r"))).alias("s")).join(a, F.col("s") == F.col("l")).select("l", "r")
    return ends.union(other).distinct()


def changed_elements(nodes: DataFrame, ranges: DataFrame, files: DataFrame, variant: str = "history", bin_lines: int = 64) -> DataFrame:
    """(id): nodes that a revision changes.

    ``ranges``: file, start, end (closed); ``files``: file, all changed files. A node with lines
    changes if a range of its file overlaps it; a node without lines if its file changes. Files that
    have no ranges change all their nodes under ``history``, none with lines under ``overlap``. Ranges
    and nodes meet in bins of lines, so a long file is no hot key.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bin_lines), F.floor(F.col(hi) / bin_lines)))
    spans = nodes.where("row is not null and file is not null").select("id", "file", "row", F.coalesce("end_row", "row").alias("end_row"))
    hits = spans.withColumn("bin", cells("row", "end_row")).join(ranges.where("start <= end").withColumn("bin", cells("start", "end")), ["file", "bin"])
    hits = hits.where("row <= end and start <= end_row").select("id")
    whole = nodes.where("row is null").join(files, "file", "left_semi").select("id")
    out = hits.union(whole)
    if variant == "history":
        bare = files.join(ranges.select("file"), "file", "left_anti")
        out = out.union(spans.join(bare, "file", "left_semi").select("id"))
    return out.distinct()


def server_coupling(commits: DataFrame, min_co: int = 1) -> DataFrame:
    """(a, b, co_changes, confidence, lift) of commits (hash, i, namespaces), by pair.

    Of commits of one hash the first counts, empty ones don't, and a commit counts with the namespaces it
    has even if some of its files belong to none; an undefined lift is 0.
    """
    once = commits.groupBy("hash").agg(F.min_by("namespaces", "i").alias("namespaces"))
    seen = once.select(F.col("hash").alias("commit"), F.explode(F.array_distinct("namespaces")).alias("ns")).where("ns is not null")
    out = temporal_coupling(seen, min_co=min_co)
    return out.select("a", "b", "co_changes", "confidence", F.coalesce("lift", F.lit(0.0)).alias("lift")).orderBy("a", "b")
