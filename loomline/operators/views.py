"""What a viewer of the graph shows: playback, history steps, rays between agents, points to follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def playback_nodes(nodes: DataFrame, decay: DataFrame, changed: DataFrame, revealed: DataFrame, always: tuple[str, ...] = ("namespace",)) -> DataFrame:
    """Nodes that a playback shows: kinds that are ``always`` there, and others while they haven't faded.

    ``decay``: (id, value). What the current frame changes (``changed``: id) shows once it is ``revealed``.
    """
    lit = decay.where("value > 0").select("id").distinct()
    hidden = changed.select("id").distinct().join(revealed.select("id"), "id", "left_anti")
    shown = lit.join(hidden, "id", "left_anti")
    return nodes.where(F.col("kind").isin(*always)).unionByName(nodes.where(~F.col("kind").isin(*always)).join(shown, "id", "left_semi").select(*nodes.columns))


def playback_edges(edges: DataFrame, decay: DataFrame, changed: DataFrame, revealed: DataFrame, changed_edges: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Edges that a playback shows: those with an end in sight; where it is known which edges a frame
    changes, ``requires`` edges only if they are among them (kind, source, target). ``tasks``: how many
    tasks the edges are dealt to for each join."""
    by = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    hidden = changed.select("id").distinct().join(revealed.select("id"), "id", "left_anti")
    shown = decay.where("value > 0").select("id").distinct().join(hidden, "id", "left_anti").withColumn("_seen", F.lit(True))
    at = lambda end: shown.select(F.col("id").alias(end), F.col("_seen").alias(f"_{end}"))
    out = by(by(edges, "source").join(at("source"), "source", "left"), "target").join(at("target"), "target", "left").where("_source or _target").select(*edges.columns)
    if changed_edges is None:
        return out
    known = by(out.where("kind = 'requires'"), "source", "target").join(by(changed_edges.where("kind = 'requires'").select("kind", "source", "target"), "source", "target").distinct(), ["kind", "source", "target"], "left_semi").select(*edges.columns)
    return out.where("kind <> 'requires'").unionByName(known)


def stepped(i: Column, by: Column | int, n: Column) -> Column:
    """The place ``by`` steps on in a history of ``n``, around its end; from before its start (-1) forwards
    to the first, backwards to the last. Null without a history."""
    by = F.lit(by) if isinstance(by, int) else by
    base = F.when(i >= 0, i).otherwise(F.when(by > 0, -1).otherwise(0))
    return F.when(n > 0, F.pmod(base + by, n))


def jumped_back(i: Column, amount: Column | int) -> Column:
    """The place some steps back, not before the first."""
    return F.greatest(F.lit(0), F.greatest(i, F.lit(0)) - amount)


def follow_points(agents: DataFrame, rays: DataFrame, points: DataFrame) -> DataFrame:
    """(agent, x, y, z): the mean of the points an agent's rays lead to, else its own place, else nothing.

    ``agents``: agent, x, y, z. ``rays``: agent, target. ``points``: target, x, y, z.
    """
    mean = rays.join(points, "target").groupBy("agent").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    out = agents.join(mean, "agent", "full_outer")
    return out.select("agent", *[F.coalesce(f"m{c}", c).alias(c) for c in "xyz"]).where("x is not null")


def compatible_rays(rays: DataFrame, agents: DataFrame) -> DataFrame:
    """Rays that may be drawn as to workspaces.

    ``rays``: ray, session, source (an agent's node), workspace, target (a node), target_workspace, link (the
    agent meant, or null), link_session, link_workspace. ``agents``: id, agent, session, workspace, visible.
    Within one workspace a ray is drawn unless its link names an agent of other session or workspace alone.
    Across workspaces exactly one visible source and one visible recipient must be there, with different
    workspaces, and the ray must lead to that recipient.
    """
    a = agents.select("id", "agent", F.col("session").alias("s"), F.col("workspace").alias("w"), "visible")
    source = rays.select("ray", "session", "source").join(a, (F.col("source") == a["id"]) & (F.col("session") == a["s"]))
    source = source.groupBy("ray").agg(F.count_if("visible").alias("sources"), F.min(F.when(F.col("visible"), F.col("w"))).alias("source_w"), F.collect_set("w").alias("source_ws"))
    # a link names a node or an agent: each agent under both, so that one equal key finds it
    by_node = F.col("link").startswith("agent:")
    known = a.withColumn("called", F.explode(F.array(F.struct(F.lit(True).alias("n"), F.col("id").alias("k")), F.struct(F.lit(False).alias("n"), F.col("agent").alias("k")))))
    meant = rays.where("link is not null").select("ray", "link", "link_session", "link_workspace", by_node.alias("n"))
    meant = meant.join(known.select(F.col("called.n").alias("n"), F.col("called.k").alias("link"), "id", "s", "w", "visible"), ["n", "link"])
    fits = (F.col("link_session").isNull() | (F.col("link_session") == F.col("s"))) & (F.col("link_workspace").isNull() | (F.col("link_workspace") == F.col("w")))
    meant = meant.withColumn("fits", F.coalesce(fits, F.lit(False))).groupBy("ray").agg(
        F.count("*").alias("called"), F.count_if("fits").alias("fitting"), F.count_if(F.col("fits") & F.col("visible")).alias("shown"),
        F.min(F.when(F.col("fits") & F.col("visible"), F.struct("id", "w"))).alias("to"), F.collect_set(F.when(F.col("fits"), F.col("w"))).alias("fit_ws"), F.collect_set("w").alias("all_ws"),
    )
    aimed = rays.select("ray", "target").join(a, F.col("target") == a["id"]).groupBy("ray").agg(F.collect_set("w").alias("aim_ws"))
    out = rays.join(source, "ray", "left").join(meant, "ray", "left").join(aimed, "ray", "left")
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, none)
    one = lambda c: F.filter(F.array(F.col(c)), lambda x: x.isNotNull())
    theirs = F.concat(one("target_workspace"), one("link_workspace"), F.when(F.col("fitting") > 0, some(F.col("fit_ws"))).otherwise(some(F.col("all_ws"))), some(F.col("aim_ws")))
    ours = F.concat(one("workspace"), some(F.col("source_ws")))
    crosses = F.exists(ours, lambda x: F.exists(theirs, lambda y: x != y))
    plain = F.when(F.col("workspace").isNotNull(), F.col("target_workspace").isNull() | (F.col("workspace") == F.col("target_workspace"))).otherwise(
        F.col("target_workspace").isNull() | ~F.coalesce((F.col("sources") > 0) & (F.col("source_w") != F.col("target_workspace")), F.lit(False))
    )
    near = ~F.coalesce((F.col("called") > 0) & (F.col("fitting") == 0), F.lit(False)) & (F.col("workspace").isNull() | F.col("target_workspace").isNull() | (F.col("workspace") == F.col("target_workspace")))
    far = (
        (F.col("sources") == 1) & F.col("source_w").isNotNull() & (F.col("workspace").isNull() | (F.col("workspace") == F.col("source_w")))
        & (F.col("shown") == 1) & (F.col("to.w") != F.col("source_w")) & (F.col("to.id") == F.col("target")) & F.col("target").startswith("agent:")
    )
    good = F.when(F.col("link").isNull(), plain).when(~crosses, near).otherwise(F.coalesce(far, F.lit(False)))
    return out.where(good).select(*rays.columns)
