"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet files. Files of a similar size (a tier) are merged into
files of the target size, all merges of a round in one job, each in a partition of its own that gets
at most the target's bytes. A version of the store is a manifest that lists its files; a new one is
written under a temporary name and renamed, which fails where another writer has taken that version.
A writer that dies leaves a temporary file and files that no manifest lists, so nobody reads them.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TARGET_BYTES = 64 << 20
BASE_BYTES = 1 << 20
FAN_IN = 4
DAY_S = 86_400.0


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    bytes: int


class ConcurrentCommit(RuntimeError):
    """Another writer has committed this version."""


def tier_of(size: int, base: int = BASE_BYTES, fan_in: int = FAN_IN) -> int:
    """Tier 0 up to the base size, then one for each power of the fan-in."""
    return 0 if size <= base else 1 + int(math.log(size / base, fan_in))


def plan_merges(shards: list[Shard], target: int = TARGET_BYTES, base: int = BASE_BYTES, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """Groups of shards to merge: at least ``fan_in`` of one tier, together at most the target.

    Oldest first; shards of half the target or more are left as they are.
    """
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if 2 * s.bytes < target:
            tiers.setdefault(tier_of(s.bytes, base, fan_in), []).append(s)
    out = []
    for tier in sorted(tiers):
        group: list[Shard] = []
        size = 0
        for s in tiers[tier]:
            if size + s.bytes > target:
                if len(group) >= fan_in:
                    out.append(group)
                group, size = [], 0
            group.append(s)
            size += s.bytes
        if len(group) >= fan_in:
            out.append(group)
    return out


class ShardStore:
    """A folder of shards and manifests, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, base: int = BASE_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.base, self.fan_in = target, base, fan_in
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest by default; of an empty store one without shards."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": []}
        at = self._path(f"{self.root}/manifests/v{known[-1] if version is None else version:08d}.json")
        stream = self._fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _commit(self, before: dict, shards: list[Shard], schema: str) -> int:
        version = before["version"] + 1
        text = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]})
        new = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        final = self._path(f"{self.root}/manifests/v{version:08d}.json")
        self._fs.mkdirs(new.getParent())
        stream = self._fs.create(new, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # never overwrites: of two writers of a version one gets the name
        files = self.spark._jvm.org.apache.hadoop.fs
        once = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
        once[0] = files.Options.Rename.NONE
        try:
            files.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, final, once)
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            raise ConcurrentCommit(f"version {version} is taken") from e
        return version

    def _written(self, folder: str) -> list[Shard]:
        found, files = [], self._fs.listFiles(self._path(f"{self.root}/{folder}"), True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if name.endswith(".parquet"):
                found.append(Shard(name[name.index(folder) :], f.getLen()))
        return sorted(found, key=lambda s: s.path)

    def _folder(self, before: dict) -> str:
        return f"data/{before['version'] + 1:08d}-{uuid.uuid4().hex}"

    def _add(self, new: list[Shard], schema: str) -> int:
        before = self.manifest()
        return self._commit(before, [*(Shard(**s) for s in before["shards"]), *new], schema)

    def append(self, rows: DataFrame) -> int:
        """Add rows as new shards, one for each task that has some; gives the new version."""
        folder = self._folder(self.manifest())
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._add(self._written(folder), rows.schema.json())

    def append_waves(self, rows: DataFrame, wave: Column, waves: int) -> Iterator[int]:
        """Add rows in waves 0 to ``waves - 1``, a version each, written by one job that reads them once."""
        folder, name = self._folder(self.manifest()), f"wave_{uuid.uuid4().hex}"
        rows.withColumn(name, wave).write.partitionBy(name).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        found = self._written(folder)
        for k in range(waves):
            yield self._add([s for s in found if f"/{name}={k}/" in s.path], rows.schema.json())

    def compact(self) -> int:
        """Merge until no tier holds enough shards; gives the latest version."""
        while True:
            before = self.manifest()
            shards = [Shard(**s) for s in before["shards"]]
            merges = plan_merges(shards, self.target, self.base, self.fan_in)
            if not merges:
                return before["version"]
            folder, name = self._folder(before), f"merge_{uuid.uuid4().hex}"
            paths = [(s.path, i) for i, group in enumerate(merges) for s in group]
            plan = self.spark.createDataFrame(paths, "path string, merge int")
            rows = self._read(before["schema"], [p for p, _ in paths])
            boxed = rows.select(common.boxed(rows), F.regexp_extract(F.input_file_name(), r"(data/[^/]+/.*)\z", 1).alias("path"))
            # one small row for each file to merge
            boxed = boxed.join(F.broadcast(plan), "path").repartitionById(len(merges), "merge")
            merged = boxed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rows.columns)], F.col("merge").alias(name))
            merged.write.partitionBy(name).option("compression", "zstd").parquet(f"{self.root}/{folder}")
            gone = {p for p, _ in paths}
            self._commit(before, [*[s for s in shards if s.path not in gone], *self._written(folder)], before["schema"])

    def vacuum(self, older_than_s: float = DAY_S, versions: int = 1) -> None:
        """Delete files that none of the latest ``versions`` lists and that are older than an age.

        The age spares what a writer hasn't committed yet and what readers of older versions still read.
        """
        kept = self.versions()[-versions:]
        live = {s.path for v in kept for s in self.shards(v)}
        before = (time.time() - older_than_s) * 1000
        for s in self._written("data"):
            at = self._path(f"{self.root}/{s.path}")
            if s.path not in live and self._fs.getFileStatus(at).getModificationTime() <= before:
                self._fs.delete(at, False)

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).option("recursiveFileLookup", True).parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; an empty store can't be read."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("nothing has been appended")
        if not found["shards"]:
            from pyspark.sql.types import StructType

            return self.spark.createDataFrame([], StructType.fromJson(json.loads(found["schema"])))
        return self._read(found["schema"], [s["path"] for s in found["shards"]])


def ingest(docs: DataFrame, waves: int = 4, id_col: str = "doc_id", root: str | None = None, **sizes: int) -> ShardStore:
    """Append a table in waves of arrivals, compacting after each; gives the store.

    Rows keep all columns, whatever their names; nulls, empty texts and repeated rows stay as they are.
    An empty table gives a store without rows. A store under no given ``root`` is this call's alone, so
    what a compaction replaces is deleted at once; elsewhere ``vacuum`` is the owner's to call.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or common.fresh_path(spark, "shards"), **sizes)
    wave = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(waves)).cast("int")
    for _ in store.append_waves(docs, wave, waves):
        store.compact()
    if not root:
        store.vacuum(0)
    return store


def digest(docs: DataFrame, waves: int = 4) -> DataFrame:
    """What the committed version holds: a row for every document, read back from its shards."""
    held = ingest(docs, waves).read()
    text = F.coalesce("text", F.lit(""))
    return held.select("doc_id", "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
