"""Traversals: blast radius with shortest paths, and explanations of connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.storage import keep

MAX_DEPTH, MAX_PATHS = 3, 100


def blast_radius(arcs: DataFrame, roots: DataFrame, direction: str = "forward", max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, distance, path): what the roots reach, with the shortest, then smallest path of arc ids.

    ``arcs``: arc, a, b. Level by level: the frontier meets the arcs, each new id takes its smallest
    path, and known ids drop out. One level is a join and an aggregation; levels are bounded.
    """
    if direction == "both":
        return (
            blast_radius(arcs, roots, "forward", max_depth)
            .withColumn("direction", F.lit("forward"))
            .unionByName(blast_radius(arcs, roots, "reverse", max_depth).withColumn("direction", F.lit("reverse")))
        )
    ways = arcs.select("arc", "a", "b") if direction == "forward" else arcs.select("arc", F.col("b").alias("a"), F.col("a").alias("b"))
    front = keep(roots.select("id").distinct().withColumn("distance", F.lit(0)).withColumn("path", F.array().cast("array<string>")), "front")
    seen = front
    for depth in range(1, max_depth + 1):
        step = front.join(ways, front["id"] == ways["a"]).groupBy(F.col("b").alias("id")).agg(F.min(F.concat("path", F.array("arc"))).alias("path"))
        step = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("distance"), "path")
        front = keep(step, "front")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def truncated(arcs: DataFrame, reached: DataFrame, max_depth: int = MAX_DEPTH) -> bool:
    """Whether something lies just beyond the last level."""
    edge = reached.where(F.col("distance") == max_depth).select(F.col("id").alias("a"))
    beyond = arcs.join(edge, "a", "left_semi").select(F.col("b").alias("id"))
    return not beyond.join(reached.select("id"), "id", "left_anti").isEmpty()


def top_paths(reached: DataFrame, max_paths: int = MAX_PATHS) -> DataFrame:
    """The nearest ids with their paths; ties by id."""
    return reached.where("distance > 0").orderBy("distance", "id").limit(max_paths)


def distances(arcs: DataFrame, sources: DataFrame, max_depth: int) -> DataFrame:
    """(s, id, distance): shortest distances from each source, up to a depth."""
    front = keep(sources.select(F.col("id").alias("s"), "id").distinct().withColumn("distance", F.lit(0)), "front")
    seen = front
    for depth in range(1, max_depth + 1):
        step = front.join(arcs, front["id"] == arcs["a"]).select("s", F.col("b").alias("id")).distinct()
        front = keep(step.join(seen.select("s", "id"), ["s", "id"], "left_anti").withColumn("distance", F.lit(depth)), "front")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def shortest_paths(arcs: DataFrame, start: str, end: str, max_depth: int = 8, max_paths: int = 5) -> DataFrame:
    """(path, distance): the first shortest paths between two ids, in order of their ids.

    First the levels from the start, until the end is met; then only ids on a shortest path are kept,
    backwards from the end; then paths grow along those, so no other walk is ever built.
    """
    spark = arcs.sparkSession
    arcs = keep(arcs.select("a", "b").where("a <> b").distinct(), "arcs")
    front = spark.createDataFrame([(start, 0)], "id string, d int")
    levels = [front]
    seen = front.select("id")
    hit = start == end
    while not hit and len(levels) <= max_depth:
        front = levels[-1].join(arcs, levels[-1]["id"] == arcs["a"]).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        front = keep(front.withColumn("d", F.lit(len(levels))), "front")
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.union(front.select("id"))
        hit = not front.where(F.col("id") == end).isEmpty()
    if not hit:
        return spark.createDataFrame([], "path string, distance int")
    useful = [levels[-1].where(F.col("id") == end).select("id")]
    for level in reversed(levels[:-1]):
        ahead = arcs.join(useful[0].select(F.col("id").alias("b")), "b", "left_semi")
        useful.insert(0, keep(level.join(ahead.select(F.col("a").alias("id")), "id", "left_semi").select("id"), "useful"))
    paths = useful[0].select("id", F.array("id").alias("nodes"))
    for level in useful[1:]:
        paths = paths.join(arcs, paths["id"] == arcs["a"]).select(F.col("b").alias("id"), "nodes").join(level, "id", "left_semi")
        # every prefix on a shortest path leads to the end, so the first ones suffice
        paths = paths.select("id", F.concat("nodes", F.array("id")).alias("nodes")).orderBy("nodes").limit(max_paths)
    return paths.select(F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).alias("distance"))
