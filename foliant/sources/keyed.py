"""Stored tables by key: deliveries replace or remove the rows of their keys, and only the folders that they touch are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.lineage import cut
from foliant.sources.store import small
from foliant.sources.versions import Versions


class KeyedTable:
    """Rows in buckets by the hash of their key; a version names a folder for each bucket that has rows.

    ``replace`` and ``remove`` are copy-on-write: touched buckets get new folders, all others keep theirs, and the new
    version is committed at once, so readers see all of a delivery or nothing. A delivery (source, number) is taken once:
    the version has each source's last number, and one that isn't beyond it changes nothing. So a stream's batch, or a
    job that is run again after a failure, can be delivered any number of times. The bucket count is fixed when the table is made and bounds the
    manifest; a bucket is rewritten as a distributed job whatever its size.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.versions = Versions(spark, root)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, some: list[int] | None = None) -> DataFrame:
        """The rows of the last version, or of some buckets."""
        folders = self.versions.last()[1].get("folders", {})
        paths = [p for b, p in folders.items() if some is None or int(b) in some]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, delivery: tuple[str, int] | None = None, keys: DataFrame | None = None) -> int:
        """The delivered rows in place of what their keys had, and the version that has them.

        ``keys`` names keys that are replaced although no row is delivered for them. Rows without a key are kept under
        a null key, which is a key like others.
        """
        number, manifest = self.versions.last()
        taken = manifest.get("deliveries", {})
        if delivery is not None and delivery[1] <= taken.get(delivery[0], -1):
            return number
        new = cut(rows.select(*self.schema.names))
        named = new.select(self.key) if keys is None else new.select(self.key).unionByName(keys.select(self.key))
        touched = cut(named.distinct().withColumn("_bucket", self._bucket()))
        some = sorted(r["_bucket"] for r in touched.select("_bucket").distinct().collect())  # as many as there are buckets at most
        gone = small(touched.select(F.col(self.key).alias("_key")))
        old = self.read(some)
        kept = old.join(gone, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        folder = f"{self.root}/{uuid.uuid4().hex}"
        both = kept.unionByName(new).withColumn("_bucket", self._bucket())
        both.write.partitionBy("_bucket").parquet(folder)
        filled = {r["_bucket"] for r in self.spark.read.parquet(folder).select("_bucket").distinct().collect()} if both.limit(1).count() else set()
        folders = {b: p for b, p in manifest.get("folders", {}).items() if int(b) not in some} | {str(b): f"{folder}/_bucket={b}" for b in some if b in filled}
        deliveries = taken | ({delivery[0]: delivery[1]} if delivery is not None else {})
        return self.versions.commit({"folders": folders, "deliveries": deliveries}, number)

    def remove(self, keys: DataFrame, delivery: tuple[str, int] | None = None) -> int:
        """Without the rows of these keys."""
        return self.replace(self.spark.createDataFrame([], self.schema), delivery, keys)


class Cache:
    """Values by content hash, appended by each call and read by the next.

    A call's new rows are a folder of their own, visible once the version that names it is committed. Keys that two
    calls add at the same time stand twice with equal values; reading takes each once.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), T.StructType.fromDDL(schema)
        self.versions = Versions(spark, root)

    def read(self) -> DataFrame:
        paths = self.versions.last()[1].get("folders", [])
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows.dropDuplicates(["key"])

    def misses(self, wanted: DataFrame) -> DataFrame:
        """The rows (key, ...) whose key isn't there, as they are."""
        return wanted.join(self.read().select("key"), "key", "left_anti")

    def append(self, rows: DataFrame) -> int:
        folder = f"{self.root}/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(folder)
        number, manifest = self.versions.last()
        return self.versions.commit({"folders": [*manifest.get("folders", []), folder]}, number)
