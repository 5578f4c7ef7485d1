"""Helpers shared by the training-data operators: shared storage, tables, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where the session names none (tests, one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_loomline_shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomline-")
        spark._loomline_shared = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for df in kept:
        path = getattr(df, "_kept_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Deal rows evenly over the shuffle partitions by a hash of the keys."""
    return df.repartition(partitions(df.sparkSession), *keys)


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def boxed(df: DataFrame) -> Column:
    """All columns of a table as one struct column ``row``: an operator's own names never clash with them."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row")


def unboxed(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns of a ``row`` again, under their names and in their order; ``new`` replaces some by name."""
    return df.select(*[new.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that ``running`` puts together before they join the rest.
RUN = 64


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(state, x)`` for each x of an array in order, where ``step(state, x)`` is the state behind x.

    ``kind``: type of what ``out`` gives. Works in runs, as an array that grows one by one is copied
    each time: first the state at the start of each run, then what comes of each run.
    """
    none = F.array().cast(f"array<{kind}>")

    def run(part: Column, state: Column) -> Column:
        made = lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["o"], F.array(out(a["s"], x))).alias("o"))
        return F.aggregate(part, F.struct(state.alias("s"), none.alias("o")), made, lambda a: a["o"])

    def whole(xs: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), (F.size(xs) / RUN).cast("int")), lambda k: k * RUN < F.size(xs))
        parts = F.transform(firsts, lambda k: F.slice(xs, k * RUN + 1, RUN))

        def runs(ps: Column) -> Column:
            start = F.struct(zero.alias("s"), F.slice(F.array(zero), 1, 0).alias("all"))
            states = F.aggregate(ps, start, lambda a, p: F.struct(F.aggregate(p, a["s"], step).alias("s"), F.concat(a["all"], F.array(a["s"])).alias("all")), lambda a: a["all"])
            return F.flatten(F.zip_with(ps, states, run))

        return let(parts, runs)

    return let(items, whole)


def joined_spans(spans: Column, start: str, end: str) -> Column:
    """Spans sorted by start as (a, b), with overlapping and touching ones joined."""
    ups = running(
        spans,
        F.lit(-1).cast("bigint"),
        lambda top, s: F.greatest(top, s[end].cast("bigint")),
        lambda top, s: F.struct(s[start].cast("bigint").alias("a"), F.greatest(top, s[end].cast("bigint")).alias("b"), (s[start] > top).alias("new")),
        "struct<a:bigint,b:bigint,new:boolean>",
    )
    firsts = lambda u: F.filter(u, lambda x: x["new"])
    lasts = lambda u: F.filter(u, lambda x, i: F.coalesce(F.get(u, i + 1)["new"], F.lit(True)))
    return let(ups, lambda u: F.zip_with(firsts(u), lasts(u), lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b"))))


#: Edges that one task may hold: 16 bytes each, so a few megabytes.
LOCAL_EDGES = 200_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as stars: every node with the smallest one that it reaches there.

    Works through the task's rows in steps, so it holds one step and the stars so far.
    """
    stars = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
    for pdf in batches:
        rows = pd.concat([stars, pdf[["u", "v"]]], ignore_index=True)
        ids, both = np.unique(np.concatenate([rows["u"].to_numpy(), rows["v"].to_numpy()]), return_inverse=True)
        root = local_roots(len(ids), both[: len(rows)], both[len(rows) :])
        own = root != np.arange(len(ids))
        stars = pd.DataFrame({"u": ids[own], "v": ids[root[own]]})
        if len(stars) > 4 * LOCAL_EDGES:
            yield stars
            stars = stars.iloc[:0]
    yield stars


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the pairs (a, b), for each of n positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Each task contracts its edges to stars. Once what is left fits one task (``local_edges``, a few
    megabytes) the same step ends the work there; until then large-star and small-star steps go on
    over the cluster, each pre-aggregating a hub before its shuffle. Every round writes its edges
    to the shared folder; only counts reach the driver. Integer nodes. Null ends and self loops are
    ignored; no edges give an empty result.
    """
    e = edges.select(F.greatest(src, dst).cast("bigint").alias("u"), F.least(src, dst).cast("bigint").alias("v"))
    e = e.where("u is not null and v is not null and u <> v")
    shape = "u bigint, v bigint"
    e = materialize(e.mapInPandas(_contract, shape), "cc")
    mark = None
    for _ in range(max_rounds):
        before, mark = mark, _edge_mark(e)
        if mark[0] <= local_edges:
            whole = materialize(e.coalesce(1).mapInPandas(_contract, shape), "cc")
            discard(e)
            e = whole
            break
        if mark == before:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(e)
        e = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _edge_mark(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
