"""A table of immutable shards with size-tiered compaction and a versioned manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import free, new_folder


class ManifestConflict(RuntimeError):
    """Another writer has committed this version first."""


class ShardedTable:
    """Shards are files of Parquet folders below ``root``; a version's manifest lists those that it consists of.

    Every write goes to a folder with a name of its own, so writers never touch each other's files, and readers take
    a version's files only, so files of failed or later jobs don't show. A manifest is written whole to a hidden file
    and then gets its version's name by a rename that never replaces: of several writers one wins.
    Manifests hold names, sizes and levels of files; no row passes through the driver.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, (root or new_folder(spark, "shards")).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def shards(self, version: int | None = None) -> list[dict]:
        """Name, bytes and level of each shard of a version."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema("name string, bytes long, level int, place int").json(f"{self.root}/manifests/v{version:08}.json")
        return [{k: r[k] for k in ("name", "bytes", "level")} for r in sorted(rows.collect(), key=lambda r: r.place)]

    def commit(self, shards: list[dict], based_on: int) -> int:
        """Make ``shards`` the next version after ``based_on``, or raise ManifestConflict.

        The file system refuses the rename where the version exists (atomically so on HDFS; a store without such a
        rename needs its own committer here).
        """
        to = self._path(f"{self.root}/manifests/v{based_on + 1:08}.json")
        hidden = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        out.write(bytearray("".join(json.dumps(s | {"place": k}) + "\n" for k, s in enumerate(shards)).encode()))
        out.close()
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), conf).rename(hidden, to, options)
        except Exception as error:
            self._fs.delete(hidden, False)
            if self._fs.exists(to):
                raise ManifestConflict(f"version {based_on + 1} exists") from error
            raise
        return based_on + 1

    def _files(self, folder: str, level: int) -> list[dict]:
        found = []
        listing = self._fs.listFiles(self._path(f"{self.root}/{folder}"), True)
        while listing.hasNext():
            x = listing.next()
            path = x.getPath().toString()
            if path.endswith(".parquet"):
                found.append({"name": path[path.index(f"/{folder}/") + 1 :], "bytes": x.getLen(), "level": level})
        return sorted(found, key=lambda s: s["name"])

    def append(self, rows: DataFrame) -> int:
        """Write arrivals as small shards, as they come from their tasks, and commit them."""
        based_on = self.version()
        folder = f"data/append-{based_on + 1:08}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self.commit(self.shards(based_on) + self._files(folder, 0), based_on)

    def plan(self, shards: list[dict], target: int, fan_in: int) -> list[list[dict]]:
        """Runs to merge: shards below half the target, in tiers (the largest of a tier is at most ``fan_in`` times
        its smallest), in runs of at most the target. A run with one shard, or below ``fan_in`` shards that don't
        fill half the target, waits for more."""
        tiers: list[list[dict]] = []
        age = {s["name"]: k for k, s in enumerate(shards)}
        for s in sorted((s for s in shards if s["bytes"] < target // 2), key=lambda s: s["bytes"]):
            if not tiers or s["bytes"] > fan_in * max(tiers[-1][0]["bytes"], 1):
                tiers.append([])
            tiers[-1].append(s)
        runs = []
        for tier in tiers:
            run, held = [], 0
            for s in sorted(tier, key=lambda s: age[s["name"]]):
                if run and held + s["bytes"] > target:
                    runs.append(run)
                    run, held = [], 0
                run.append(s)
                held += s["bytes"]
            if len(run) >= fan_in or held >= target // 2:
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, target: int = 128 << 20, fan_in: int = 4) -> int:
        """Merge similarly sized shards into files of about ``target`` bytes and commit; returns the version.

        Each run is one output file, written by one task that reads at most ``target`` bytes; all runs of a
        compaction are one job. Without a run to merge, the version stays.
        """
        based_on = self.version()
        shards = self.shards(based_on)
        runs = self.plan(shards, target, fan_in)
        if not runs:
            return based_on
        folder = f"data/merge-{based_on + 1:08}-{uuid.uuid4().hex}"
        where = {s["name"].rsplit("/", 1)[-1]: k for k, run in enumerate(runs) for s in run}
        merged = self.spark.read.parquet(*(f"{self.root}/{s['name']}" for run in runs for s in run))
        own_file, own_run = free(merged.columns, "own_file", "own_run")
        schema = T.StructType([T.StructField(own_file, T.StringType()), T.StructField(own_run, T.IntegerType())])
        plan = self.spark.createDataFrame(list(where.items()), schema)
        named = merged.withColumn(own_file, F.col("_metadata.file_name"))
        dealt = named.join(F.broadcast(plan) if len(where) <= 100_000 else plan, own_file).drop(own_file).repartitionById(len(runs), own_run)
        dealt.write.option("compression", "zstd").partitionBy(own_run).parquet(f"{self.root}/{folder}")
        gone = {s["name"] for run in runs for s in run}
        return self.commit([s for s in shards if s["name"] not in gone] + self._files(folder, max(s["level"] for r in runs for s in r) + 1), based_on)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files of versions before the last ``keep``; returns how many.

        Only files that an older manifest names go, so another writer's files that aren't committed yet are safe.
        """
        last = self.version()
        old = {s["name"] for v in range(1, last - keep + 1) for s in self.shards(v)}
        gone = sorted(old - {s["name"] for v in range(max(1, last - keep + 1), last + 1) for s in self.shards(v)})
        return sum(self._fs.delete(self._path(f"{self.root}/{name}"), False) for name in gone)

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The rows of a version, with the column ``shard``: the name of the file each row lies in."""
        shards = self.shards(version)
        if not shards:
            return self.spark.createDataFrame([], schema).withColumn("shard", F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['name']}" for s in shards))
        return rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"/(data/.*)$", 1))


def shard_documents(docs: DataFrame, batches: int = 4, small: int = 4 << 20, target: int = 64 << 20, fan_in: int = 4, root: str | None = None) -> tuple[ShardedTable, DataFrame]:
    """Append docs in ``batches`` arrivals, compact, and return the table and its rows with their shard.

    Arrivals are dealt by a hash of doc_id (null: the first one), so that each is a part of the whole table; an
    arrival is one file for each of its tasks. Every row and column stays as it is, repeated rows, nulls and
    empty texts included; a column called ``shard`` is replaced in the result. An empty table commits shards
    without rows.
    """
    table = ShardedTable(docs.sparkSession, root)
    turn = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(batches))
    for k in range(batches):
        table.append(docs.where(turn == k))
    table.compact(target, fan_in)
    table.vacuum()
    return table, table.read(docs.schema)
