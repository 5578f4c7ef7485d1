"""Shared storage for intermediate tables: cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder on one machine where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_loomline_shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark._loomline_shared = tempfile.mkdtemp(prefix="loomline-")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete what ``keep`` wrote for tables that nothing reads any more."""
    for df in kept:
        path = getattr(df, "_kept_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shares(df: DataFrame, each: int = 400_000) -> int:
    """How many tasks take about ``each`` rows of a table; at least one for each core.

    A number that is given isn't made smaller by adaptive execution, which goes by compressed bytes.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each))


def dealt(df: DataFrame, each: int = 400_000) -> DataFrame:
    """The rows over enough tasks for work that is heavy beside their bytes."""
    return df.repartition(shares(df, each))
