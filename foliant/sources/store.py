"""Stored tables that are derived from a source table and refreshed for its changed rows only.

A table consists of segments. Each refresh compares the source with the hashes of the rows that were derived before,
derives new and changed rows into a segment of their own, and names the rows of earlier segments that are no longer
valid. Nothing is rewritten; when segments grow many, their valid rows become one segment without being derived again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.versions import VersionConflict, Versions

#: A table of keys is broadcast up to this many rows.
MOST_KEYS = 200_000
#: Segments before their rows are put together.
MOST_SEGMENTS = 8
#: Bytes of an index's row groups: what a writer holds, and the least that a task reads.
ROW_GROUP = 1 << 25
#: Codec of rows and indexes, which are written once and read often: an index's rows take a third less than with Parquet's usual one, its blocks a tenth.
CODEC = "zstd"


def small(frame: DataFrame, rows: int = MOST_KEYS) -> DataFrame:
    """The frame, to be broadcast if it is counted to have at most this many rows. It should be cheap to count."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


class DerivedTable:
    """A table of rows derived from a source (key, ...), in a folder of its own.

    ``derive`` turns source rows into rows that carry the column ``key``; ``index``, where there is one, turns the rows
    of a segment into another table. Source rows without a key are left out; several rows of one key belong together
    and are derived together.
    """

    def __init__(self, spark: SparkSession, root: str, derive: Callable[[DataFrame], DataFrame], index: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.root, self.derive, self.index = spark, root.rstrip("/"), derive, index
        self.versions = Versions(spark, root)

    def refresh(self, source: DataFrame, plain: DataFrame | None = None) -> dict:
        """Bring the table up to the source, and give the manifest of its version.

        An unchanged source costs one scan of it, without a shuffle, and derives nothing. ``derived`` and ``dropped``
        in the manifest say how many keys the last change derived anew and took away. ``plain`` is the same source as it
        lies, where it has been dealt out to the cores: rows are hashed where they lie, and only derived from once dealt out.
        """
        columns = [c for c in sorted(source.columns) if c != "key"]
        # Structs of columns are hashed with a mark for null, which xxhash64 alone would pass over.
        parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
        hashed = (source if plain is None else plain).where("key is not null").select("key", F.xxhash64(F.lit(0), *parts).alias("h"))
        mixed = F.xxhash64("key", "h")
        total = F.coalesce(F.sum(mixed.cast("decimal(38,0)")), F.lit(0)).cast("string")
        fingerprint = list(hashed.agg(F.count("*"), F.coalesce(F.bit_xor(mixed), F.lit(0)), total).first())
        number, manifest = self.versions.last()
        if manifest.get("fingerprint") == fingerprint:
            return manifest
        # One hash for each key: a sum doesn't depend on the order of a key's rows and counts repeated ones.
        now = hashed.groupBy("key").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
        folder = f"{self.root}/{uuid.uuid4().hex}"
        segments = manifest.get("segments", [])
        if segments:
            before = self.read("keys")
            now.write.parquet(f"{folder}/now")
            now = self.spark.read.parquet(f"{folder}/now")
            changed = now.join(before.select("key", "h", "n"), ["key", "h", "n"], "left_anti")
            dead = before.join(now, ["key", "h", "n"], "left_anti").select("key", "segment")
            dead.write.parquet(f"{folder}/dead")
            changed.write.parquet(f"{folder}/keys")
            keys = self.spark.read.parquet(f"{folder}/keys")
            fresh = source.join(small(keys.select("key")), "key", "left_semi")
            dropped = self.spark.read.parquet(f"{folder}/dead").count()
        else:
            now.write.parquet(f"{folder}/keys")
            keys, fresh, dropped = self.spark.read.parquet(f"{folder}/keys"), source.where("key is not null"), 0
        derived = keys.count()
        if derived:
            self.derive(fresh).write.option("compression", CODEC).parquet(f"{folder}/rows")
            self._index(folder)
        added = [{"folder": folder, "name": uuid.uuid4().hex, "filled": derived > 0, "dead": dropped}]
        manifest = {"fingerprint": fingerprint, "derived": derived, "dropped": dropped, "segments": segments + added}
        if len(manifest["segments"]) > MOST_SEGMENTS:
            manifest["segments"] = [self._together(manifest["segments"])]
        try:
            self.versions.commit(manifest, number)
        except VersionConflict:  # another job has brought the table up to the same source meanwhile
            manifest = self.versions.last()[1]
            if manifest["fingerprint"] != fingerprint:
                raise
        return manifest

    def _index(self, folder: str) -> None:
        if self.index:
            # As it comes: folders would have each task sort all its rows, which spills once they outgrow the memory.
            self.index(self.spark.read.parquet(f"{folder}/rows")).write.option("parquet.block.size", ROW_GROUP).option("compression", CODEC).parquet(f"{folder}/index")

    def _together(self, segments: list[dict]) -> dict:
        folder = f"{self.root}/{uuid.uuid4().hex}"
        for what in ("keys", "rows"):
            self.read(what, segments).drop("segment").write.option("compression", CODEC).parquet(f"{folder}/{what}")
        self._index(folder)
        return {"folder": folder, "name": uuid.uuid4().hex, "filled": True, "dead": 0}

    def dead(self, segments: list[dict] | None = None) -> DataFrame | None:
        """(key, segment) of the rows that are no longer valid; None if there are none."""
        segments = self.versions.last()[1]["segments"] if segments is None else segments
        found = None
        for s in segments:
            if s["dead"]:
                one = self.spark.read.parquet(f"{s['folder']}/dead")
                found = one if found is None else found.unionByName(one)
        return found

    def read(self, what: str = "rows", segments: list[dict] | None = None, valid: bool = True) -> DataFrame | None:
        """The rows (or keys, or index) of the last version with their segment; only the valid ones, unless asked otherwise."""
        segments = self.versions.last()[1]["segments"] if segments is None else segments
        rows = None
        for s in segments:
            if s["filled"]:
                one = self.spark.read.parquet(f"{s['folder']}/{what}").withColumn("segment", F.lit(s["name"]))
                rows = one if rows is None else rows.unionByName(one)
        gone = self.dead(segments) if valid and rows is not None else None
        return rows if gone is None else rows.join(small(gone), ["key", "segment"], "left_anti").select(*rows.columns)
