"""Namespace metrics: degrees, cycles, PageRank, betweenness, cohesion and the scores made of them.

Iterations run over edge tables; each round is written to the shared folder, and only counts reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.graph import namespaces, with_namespaces
from loomline.operators.ordering import running_totals
from loomline.storage import discard, keep

DAMPING, ROUNDS = 0.85, 24
#: Nodes that shortest paths are counted from at once; each has a row for every node it reaches.
SOURCES_AT_ONCE = 1000


def degrees(edges: DataFrame, nodes: DataFrame, structural: tuple[str, ...] = ("requires",)) -> DataFrame:
    """(ns, fan_in, fan_out, degree, weighted_degree, self_links, mentions) over distinct neighbours."""
    e = with_namespaces(edges, nodes)
    s = e.where(F.col("kind").isin(*structural))
    pairs = s.groupBy("a", "b").agg(F.sum(F.log1p("n")).alias("w"), F.sum("n").alias("n"))
    view = pairs.select(F.col("a").alias("ns"), F.col("b").alias("other"), F.lit(1).alias("out"), F.lit(0).alias("into"), "w", F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("self"))
    # a link to itself counts as both directions, but its weight once
    back = pairs.select(F.col("b").alias("ns"), F.col("a").alias("other"), F.lit(0).alias("out"), F.lit(1).alias("into"), F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("w")).alias("w"), F.lit(0).alias("self"))
    each = view.unionByName(back).groupBy("ns").agg(
        F.sum("into").alias("fan_in"), F.sum("out").alias("fan_out"), F.count_distinct("other").alias("degree"), F.sum("w").alias("weighted_degree"), F.sum("self").alias("self_links")
    )
    said = e.where("kind = 'mentions'").groupBy(F.col("a").alias("ns")).agg(F.sum("n").alias("mentions"))
    out = namespaces(nodes).select("ns").join(each, "ns", "left").join(said, "ns", "left")
    return out.select("ns", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out", "degree", "weighted_degree", "self_links", "mentions")])


def links(edges: DataFrame, nodes: DataFrame, structural: tuple[str, ...] = ("requires",)) -> DataFrame:
    """(a, b): distinct dependencies of namespaces, links to itself included."""
    return with_namespaces(edges.where(F.col("kind").isin(*structural)), nodes).select("a", "b").distinct()


def external_surface(edges: DataFrame, nodes: DataFrame, structural: tuple[str, ...] = ("requires",)) -> DataFrame:
    """(ns, external_in, external_out): occurrences between a project namespace and external ones."""
    ext = namespaces(nodes).select("ns", "external")
    e = with_namespaces(edges.where(F.col("kind").isin(*structural)), nodes)
    e = e.join(ext.select(F.col("ns").alias("a"), F.col("external").alias("ea")), "a").join(ext.select(F.col("ns").alias("b"), F.col("external").alias("eb")), "b").where("ea <> eb")
    own = F.when(F.col("ea"), F.col("b")).otherwise(F.col("a"))
    return e.groupBy(own.alias("ns")).agg(F.sum(F.when(F.col("ea"), F.col("n")).otherwise(0)).alias("external_in"), F.sum(F.when(F.col("eb"), F.col("n")).otherwise(0)).alias("external_out"))


def components(pairs: DataFrame, ids: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root): smallest id reachable over undirected pairs (a, b), by hooking and jumping."""
    both = keep(pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct(), "pairs")
    state = keep(ids.select("id", F.col("id").alias("root")), "roots")
    for _ in range(max_rounds):
        near = both.join(state.select(F.col("id").alias("b"), F.col("root").alias("low")), "b").groupBy("a").agg(F.min("low").alias("low"))
        hooked = state.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("root", F.coalesce("low", "root")).alias("root"))
        up = hooked.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = keep(hooked.join(up, "root", "left").select("id", F.least("root", F.coalesce("top", "root")).alias("root")), "roots")
        moved = new.join(state.withColumnRenamed("root", "before"), "id").where("root <> before")
        done = moved.isEmpty()
        discard(state)
        state = new
        if done:
            discard(both)
            return state
    raise RuntimeError("components did not settle")


#: Arcs that one task may hold when cycles are found; beyond that the rounds go over the cluster.
LOCAL_ARCS = 50_000


def cycles(pairs: DataFrame, ids: DataFrame, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """(id, root): strongly connected components of directed pairs (a, b), each under one of its ids.

    In every round each id gets a number at random; what spreads along the arcs and against them is
    the smallest number that reaches an id and the smallest that it reaches. Where both are one id's,
    id and pivot lie on a cycle and are done. The others go on in parts, one for each pair of numbers:
    a component never lies in two, and arcs between parts go. The smallest id of each part is always
    done, so parts shrink like those of a quicksort and no number of rounds is set. Once the arcs that
    are left fit one task (``local_arcs``), they are finished there.
    """
    e = keep(pairs.where("a <> b").select("a", "b").distinct(), "arcs")
    found: list[DataFrame] = []
    seed = 0
    while True:
        before = e
        e = keep(_two_way(e), "arcs")
        discard(before)
        n = e.count()
        if n == 0:
            break
        if n <= local_arcs:
            kind = e.schema["a"].dataType.simpleString()
            found.append(keep(e.coalesce(1).mapInPandas(_local_cycles, f"id {kind}, root {kind}"), "cycles"))
            break
        reach = _spread(e, seed)
        done = "f.id = t.id"
        found.append(keep(reach.where(done).select("id", F.col("f.id").alias("root")), "cycles"))
        rest = reach.where(f"not ({done})").select("id", F.struct("f", "t").alias("part"))
        inner = e.join(rest.select(F.col("id").alias("a"), F.col("part").alias("pa")), "a").join(rest.select(F.col("id").alias("b"), F.col("part").alias("pb")), "b")
        after = keep(inner.where("pa = pb").select("a", "b"), "arcs")
        discard(e, reach)
        e, seed = after, seed + 1
    discard(e)
    every = ids.select("id").distinct()
    if not found:
        return every.select("id", F.col("id").alias("root"))
    roots = reduce(DataFrame.unionByName, found)
    return every.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _two_way(e: DataFrame) -> DataFrame:
    """The arcs from ids that an arc leads to, to ids that an arc leads on from."""
    return e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def _spread(e: DataFrame, seed: int) -> DataFrame:
    """(id, f, t): the smallest (number, id) that reaches an id along arcs, and that it reaches.

    What an id has reached already is looked up too (a pointer that doubles), so long ways are short.
    """
    ids = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    own = F.struct(F.xxhash64(F.lit(seed), "id").alias("h"), "id")
    state = keep(ids.select("id", own.alias("f"), own.alias("t")), "spread")
    while True:
        ahead = e.join(state.select(F.col("id").alias("a"), "f"), "a").groupBy(F.col("b").alias("id")).agg(F.min("f").alias("f1"))
        back = e.join(state.select(F.col("id").alias("b"), "t"), "b").groupBy(F.col("a").alias("id")).agg(F.min("t").alias("t1"))
        far_f = state.select(F.col("id").alias("at_f"), F.col("f").alias("f2"))
        far_t = state.select(F.col("id").alias("at_t"), F.col("t").alias("t2"))
        met = state.join(ahead, "id", "left").join(back, "id", "left").join(far_f, F.col("f.id") == F.col("at_f")).join(far_t, F.col("t.id") == F.col("at_t"))
        new = keep(met.select("id", F.least("f", "f1", "f2").alias("f"), F.least("t", "t1", "t2").alias("t"), ((F.least("f", "f1", "f2") != F.col("f")) | (F.least("t", "t1", "t2") != F.col("t"))).alias("moved")), "spread")
        still = new.where("moved").isEmpty()
        discard(state)
        state = new
        if still:
            return state


def _local_cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of one task's arcs, by two walks: ends of the first one begin the second, against the arcs."""
    pdf = pd.concat(list(batches), ignore_index=True)
    ahead: dict = {}
    back: dict = {}
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    seen: set = set()
    ends: list = []
    for start in sorted({*ahead, *back}):
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(ahead.get(start, ())))]
        while stack:
            at, others = stack[-1]
            for o in others:
                if o not in seen:
                    seen.add(o)
                    stack.append((o, iter(ahead.get(o, ()))))
                    break
            else:
                ends.append(at)
                stack.pop()
    root: dict = {}
    for start in reversed(ends):
        if start in root:
            continue
        root[start], front = start, [start]
        while front:
            for o in back.get(front.pop(), ()):
                if o not in root:
                    root[o] = start
                    front.append(o)
    yield pd.DataFrame({"id": list(root), "root": list(root.values())})


def _reach(e: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids reachable from the roots along arcs (a, b), the roots included."""
    seen = front = keep(roots, "seen")
    while True:
        front = keep(front.join(e, front["id"] == e["a"]).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def reachable(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """Closure: ids reachable from the roots along arcs (a, b)."""
    return _reach(arcs.select("a", "b").distinct(), roots.select("id").distinct())


def page_rank(pairs: DataFrame, ids: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, rank): a fixed number of rounds; the rank of nodes without a way out is spread evenly."""
    arcs = keep(pairs.distinct(), "arcs")
    n = ids.count()
    out = arcs.groupBy("a").agg(F.count("*").alias("k"))
    base = keep(ids.select("id").join(out.withColumnRenamed("a", "id"), "id", "left"), "nodes")
    rank = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        got = arcs.join(rank.select(F.col("id").alias("a"), (F.col("rank") / F.col("k")).alias("share")), "a").groupBy(F.col("b").alias("id")).agg(F.sum("share").alias("got"))
        # one row, so the cross join adds a column
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        new = base.join(got, "id", "left").join(F.broadcast(loose))
        rank = new.select("id", "k", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if i % 3 == 2:
            rank = keep(rank, "rank")
    return rank.select("id", "rank")


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = 2166136261
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return h


def betweenness(pairs: DataFrame, ids: DataFrame, at_once: int = SOURCES_AT_ONCE) -> DataFrame:
    """(id, score): shares of shortest paths through each node, its own paths left out.

    Every node is a source, about ``at_once`` of them in a run; of a run only the sums are kept.
    """
    arcs = keep(pairs.where("a <> b").distinct(), "arcs")
    runs = max(1, -(-ids.count() // at_once))
    sources = keep(ids.select("id", F.pmod(F.xxhash64("id"), F.lit(runs)).alias("run")), "sources")
    sums = [_dependencies(arcs, sources.where(F.col("run") == i).select("id")) for i in range(runs)]
    discard(arcs, sources)
    score = reduce(DataFrame.union, sums, ids.select("id", F.lit(0.0).alias("delta")))
    return score.groupBy("id").agg(F.sum("delta").alias("score"))


def _dependencies(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, delta): how far the shortest paths from the sources depend on each node between their ends.

    Paths are counted level by level for all sources at once, and dependencies summed backwards.
    """
    levels = [keep(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")), "level")]
    seen = levels[0].select("s", "id")
    while True:
        step = levels[-1].join(arcs, levels[-1]["id"] == arcs["a"]).groupBy("s", F.col("b").alias("id")).agg(F.sum("sigma").alias("sigma"))
        step = keep(step.join(seen, ["s", "id"], "left_anti"), "level")
        if step.isEmpty():
            discard(step)
            break
        levels.append(step)
        seen = seen.union(step.select("s", "id"))
    deltas = [levels[-1].withColumn("delta", F.lit(0.0))]
    for level in reversed(levels[:-1]):
        lower = deltas[-1].select("s", F.col("id").alias("b"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        got = arcs.join(lower, "b").groupBy("s", F.col("a").alias("id")).agg(F.sum("share").alias("got"))
        deltas.append(keep(level.join(got, ["s", "id"], "left").withColumn("delta", F.col("sigma") * F.coalesce("got", F.lit(0.0))).drop("got"), "delta"))
    out = reduce(DataFrame.union, [d.where("s <> id").select("id", "delta") for d in deltas])
    out = keep(out.groupBy("id").agg(F.sum("delta").alias("delta")), "score")
    discard(*levels, *deltas)
    return out


def cohesion(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ns, members, components, cohesion): how far calls within a namespace hold its symbols together."""
    own = nodes.where("kind = 'var' and namespace is not null").select("id", F.col("namespace").alias("ns"))
    inner = with_namespaces(edges.where("kind = 'calls'"), nodes.where("kind = 'var'")).where("a = b").select(F.col("source").alias("a"), F.col("target").alias("b"))
    roots = components(inner, own.select("id"))
    by = own.join(roots, "id").groupBy("ns").agg(F.count("*").alias("members"), F.count_distinct("root").alias("components"))
    out = namespaces(nodes).select("ns").join(by, "ns", "left").select("ns", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("components", F.lit(0)).alias("components"))
    value = F.when(F.col("members") == 0, 0.0).when(F.col("members") == 1, 1.0).otherwise(1 - (F.col("components") - 1) / (F.col("members") - 1))
    return out.withColumn("cohesion", value)


def with_percentiles(df: DataFrame, *columns: str) -> DataFrame:
    """Adds ``p_<column>``: share of the positive values that are not above this one; 0 for others.

    Values are reduced to distinct ones with their counts before they are summed up in order, those
    of all columns in one pass.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    counts = df.select(each.alias("m")).select("m.*").where("v > 0").groupBy("c", "v").agg(F.count("*").alias("k"))
    upto = running_totals(counts, ["c", "v"], upto=F.col("k"))
    # a row a column
    whole = upto.groupBy("c").agg(F.min(F.col("upto") - F.col("k")).alias("start"), F.sum("k").alias("all"))
    share = upto.join(F.broadcast(whole), "c").select("c", "v", ((F.col("upto") - F.col("start")) / F.col("all")).alias("share"))
    for c in columns:
        own = share.where(F.col("c") == c).select(F.col("v").alias("_v"), F.col("share").alias(f"p_{c}"))
        df = df.join(own, F.col(c).cast("double") == F.col("_v"), "left").drop("_v").withColumn(f"p_{c}", F.coalesce(f"p_{c}", F.lit(0.0)))
    return df


def namespace_metrics(edges: DataFrame, nodes: DataFrame, structural: tuple[str, ...] = ("requires",)) -> DataFrame:
    """All measures and scores of the namespaces of a set.

    Connectedness weighs weighted degree, PageRank and betweenness; over-dependency weighs
    instability, fan-out, cycle severity and fan-in.
    """
    # read by each measure
    edges, nodes = keep(edges, "edges"), keep(nodes, "nodes")
    ids = keep(namespaces(nodes).select(F.col("ns").alias("id")), "ids")
    pairs = keep(links(edges, nodes, structural), "links")
    roots = cycles(pairs, ids)
    size = roots.withColumn("cycle_size", F.count("*").over(Window.partitionBy("root"))).select(F.col("id").alias("ns"), "cycle_size")
    out = degrees(edges, nodes, structural)
    out = out.join(size, "ns").join(page_rank(pairs, ids).select(F.col("id").alias("ns"), "rank"), "ns")
    out = out.join(betweenness(pairs, ids).select(F.col("id").alias("ns"), F.col("score").alias("betweenness")), "ns")
    out = keep(out.join(cohesion(edges, nodes).select("ns", "components", "cohesion"), "ns"), "metrics")
    top = out.agg(F.max("cycle_size").alias("largest"))
    out = out.join(F.broadcast(top))
    severity = F.when(F.col("cycle_size") > 1, F.least(F.lit(1.0), F.log2(F.col("cycle_size")) / F.greatest(F.lit(1.0), F.log2("largest")))).otherwise(0.0)
    both = F.col("fan_in") + F.col("fan_out")
    out = out.withColumn("cycle_severity", severity).withColumn("instability", F.when(both > 0, F.col("fan_out") / both).otherwise(0.0))
    # ranks over rounded values, so that equal ones stay equal whatever the order of summing
    for c in ("weighted_degree", "rank", "betweenness"):
        out = out.withColumn(c, F.round(c, 9))
    out = with_percentiles(out, "weighted_degree", "rank", "betweenness", "instability", "fan_out", "fan_in")
    return out.select(
        "ns", "fan_in", "fan_out", "degree", "weighted_degree", "self_links", "mentions", "cycle_size", "rank", "betweenness", "components", "cohesion", "cycle_severity", "instability",
        (0.4 * F.col("p_weighted_degree") + 0.35 * F.col("p_rank") + 0.25 * F.col("p_betweenness")).alias("connectedness"),
        (0.35 * F.col("p_instability") + 0.25 * F.col("p_fan_out") + 0.25 * F.col("cycle_severity") + 0.15 * F.col("p_fan_in")).alias("overdependency"),
    )
