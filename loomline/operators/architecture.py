"""Communities, their drift, and the dependency structure matrix."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import metrics
from loomline.operators.graph import hierarchy_key
from loomline.operators.ordering import numbered
from loomline.storage import discard, keep


def communities(ns_edges: DataFrame, spaces: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(ns, community): synchronous weighted label propagation; ties take the smaller label.

    A label moves only if its weight beats that of the own one, and on every other round only towards
    smaller labels, so rounds settle. Labels start in hierarchy order.
    """
    both = ns_edges.select("a", "b", "weight").union(ns_edges.select(F.col("b"), F.col("a"), "weight"))
    both = keep(both.groupBy("a", "b").agg(F.sum("weight").alias("w")), "links")
    label = keep(spaces.select("ns", F.col("ns").alias("label")), "labels")
    for i in range(max_rounds):
        votes = both.join(label.select(F.col("ns").alias("b"), F.col("label").alias("vote")), "b").groupBy(F.col("a").alias("ns"), "vote").agg(F.sum("w").alias("w"))
        best = votes.groupBy("ns").agg(F.min_by("vote", F.struct((-F.col("w")).alias("w"), "vote")).alias("best"))
        moved = label.join(best, "ns", "left")
        up = (F.col("best") < F.col("label")) if i % 2 else F.col("best").isNotNull()
        new = keep(moved.select("ns", F.when(up, F.col("best")).otherwise(F.col("label")).alias("label")), "labels")
        same = new.join(label.withColumnRenamed("label", "before"), "ns").where("label <> before").isEmpty()
        discard(label)
        label = new
        if same and i % 2 == 0:
            break
    # a community is called after its first member
    first = label.groupBy("label").agg(F.min("ns").alias("community"))
    return label.join(first, "label").select("ns", "community")


def sequential_communities(ns_edges: DataFrame, spaces: DataFrame) -> DataFrame:
    """(ns, community): label propagation in place, in hierarchy order, as one sequential pass needs it.

    The result depends on the order of the updates, so connected parts are the unit of work: each is
    one group, of a size bounded by its namespaces (not by symbols or uses).
    """
    pairs = ns_edges.select("a", "b", "weight")
    ids = spaces.select(F.col("ns").alias("id"))
    part = metrics.components(pairs, ids)
    keys = spaces.select("ns", hierarchy_key(F.col("ns")).alias("key"))
    rows = part.join(keys, part["id"] == keys["ns"]).select("root", "ns", "key").join(pairs.groupBy("a", "b").agg(F.sum("weight").alias("w")), F.col("ns") == F.col("a"), "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf[["key", "ns"]].drop_duplicates().sort_values(["key", "ns"])["ns"].tolist()
        rank = {n: i for i, n in enumerate(order)}
        near: dict[str, dict[str, float]] = {n: {} for n in order}
        for a, b, w in pdf[["a", "b", "w"]].dropna().itertuples(index=False):
            if b in near and a != b:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        label = {n: n for n in order}
        for _ in range(2 * len(order)):
            changed = False
            for n in order:
                votes: dict[str, float] = {}
                for o, w in near[n].items():
                    votes[label[o]] = votes.get(label[o], 0) + w
                if votes:
                    best = min(votes, key=lambda v: (-votes[v], rank[v]))
                    changed |= best != label[n]
                    label[n] = best
            if not changed:
                break
        first: dict[str, str] = {}
        for n in order:
            first.setdefault(label[n], n)
        return pd.DataFrame({"ns": order, "community": [first[label[n]] for n in order]})

    return rows.groupBy("root").applyInPandas(run, "ns string, community string")


def community_stats(assigned: DataFrame, ns_edges: DataFrame) -> DataFrame:
    """(community, members, inner, outer, strength): weights inside and across the border."""
    at = lambda end: assigned.select(F.col("ns").alias(end), F.col("community").alias(f"c{end}"))
    e = ns_edges.join(at("a"), "a").join(at("b"), "b")
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inner"))
    cross = e.where("ca <> cb")
    outer = cross.select(F.col("ca").alias("community"), "weight").union(cross.select(F.col("cb"), "weight")).groupBy("community").agg(F.sum("weight").alias("outer"))
    out = assigned.groupBy("community").agg(F.count("*").alias("members")).join(inner, "community", "left").join(outer, "community", "left")
    out = out.select("community", "members", F.coalesce("inner", F.lit(0)).alias("inner"), F.coalesce("outer", F.lit(0)).alias("outer"))
    return out.withColumn("strength", F.col("outer") / F.greatest(F.lit(1), F.col("inner") + F.col("outer")))


def drift_candidates(assigned: DataFrame) -> DataFrame:
    """(ns, community, root, score): members whose first segment isn't their community's usual one."""
    rows = assigned.withColumn("root", F.substring_index("ns", ".", 1))
    counts = rows.groupBy("community", "root").agg(F.count("*").alias("n"))
    top = counts.groupBy("community").agg(F.min_by("root", F.struct((-F.col("n")).alias("n"), "root")).alias("usual"), F.max("n").alias("most"), F.sum("n").alias("all"))
    out = rows.join(top, "community").where("root <> usual")
    return out.select("ns", "community", "root", "usual", F.least(F.lit(1.0), 0.5 + F.col("most") / F.col("all") / 2).alias("score"))


def community_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, jaccard): the best match of each old community; without overlap the smallest new one."""
    size = lambda df, c: df.groupBy(F.col("community").alias(c)).agg(F.count("*").alias(f"n_{c}"))
    both = old.select("ns", F.col("community").alias("old")).join(new.select("ns", F.col("community").alias("new")), "ns").groupBy("old", "new").agg(F.count("*").alias("shared"))
    both = both.join(size(old, "old"), "old").join(size(new, "new"), "new")
    both = both.withColumn("jaccard", F.col("shared") / (F.col("n_old") + F.col("n_new") - F.col("shared")))
    best = both.groupBy("old").agg(F.max_by(F.struct("new", "jaccard"), F.struct("jaccard", F.expr("-length(new)"), "new")).alias("m"), F.max("jaccard").alias("j"))
    first = both.join(best.select("old", F.col("j")), "old").where("jaccard = j").groupBy("old").agg(F.min("new").alias("new"), F.min("jaccard").alias("jaccard"))
    fallback = new.agg(F.min("community").alias("least"))
    rest = old.select(F.col("community").alias("old")).distinct().join(first, "old", "left").join(F.broadcast(fallback))
    return rest.select("old", F.coalesce("new", "least").alias("new"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def moved(old: DataFrame, new: DataFrame, match: DataFrame) -> DataFrame:
    """(ns, before, after): namespaces that left, came, or changed to another than the matched community."""
    a = old.select("ns", F.col("community").alias("before")).join(match.select(F.col("old").alias("before"), F.col("new").alias("expected")), "before", "left")
    both = a.join(new.select("ns", F.col("community").alias("after")), "ns", "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("after"))).select("ns", "before", "after")


def matrix(ns_edges: DataFrame, spaces: DataFrame) -> DataFrame:
    """Cells of the dependency matrix: (a, b, row, col, weight, back, signal).

    Positions follow the hierarchy. ``signal``: cyclic if an end lies in a cycle, layered if nothing
    points back, backward-heavy if more weight points back than forward, else acyclic.
    """
    place = numbered(spaces.select("ns"), [hierarchy_key(F.col("ns")), "ns"], "at")
    roots = metrics.cycles(ns_edges.select("a", "b"), spaces.select(F.col("ns").alias("id")))
    big = roots.groupBy("root").agg((F.count("*") > 1).alias("cyclic"))
    info = keep(place.join(roots.join(big, "root").select(F.col("id").alias("ns"), "cyclic"), "ns"), "places")
    at = lambda end: info.select(F.col("ns").alias(end), F.col("at").alias(f"at_{end}"), F.col("cyclic").alias(f"cyclic_{end}"))
    back = ns_edges.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("weight").alias("back"))
    e = ns_edges.join(at("a"), "a").join(at("b"), "b").join(back, ["a", "b"], "left")
    signal = F.when(F.col("cyclic_a") | F.col("cyclic_b"), "cyclic").when(F.coalesce("back", F.lit(0)) == 0, "layered").when(F.col("back") > F.col("weight"), "backward-heavy").otherwise("acyclic")
    return e.select("a", "b", F.col("at_a").alias("row"), F.col("at_b").alias("col"), "weight", F.coalesce("back", F.lit(0)).alias("back"), signal.alias("signal"))
