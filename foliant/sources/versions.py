"""Versions of a table as small manifests that are committed by a rename which never replaces."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class VersionConflict(RuntimeError):
    """Another writer has committed this version first."""


class Versions:
    """Manifests v1, v2, ... in a folder of any file system that Spark reaches; each is one JSON value.

    A manifest names folders of rows, so its size doesn't depend on theirs. Of two writers of one version the second
    gets VersionConflict (atomically so on HDFS; a store without such a rename needs its own committer here).
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = self._hadoop.Path(f"{self.root}/versions")
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> tuple[int, dict]:
        """The last version and its manifest; 0 and an empty one before the first."""
        if not self._fs.exists(self._at):
            return 0, {}
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at)]
        number = max([0, *(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())])
        if not number:
            return 0, {}
        return number, json.loads(self.spark.read.text(f"{self.root}/versions/v{number}", wholetext=True).first()[0])

    def commit(self, manifest: dict, based_on: int) -> int:
        """Make this manifest the version after ``based_on``."""
        self._fs.mkdirs(self._at)
        hidden = self._hadoop.Path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        to = self._hadoop.Path(f"{self.root}/versions/v{based_on + 1}")
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(hidden, to, options)
        except Exception as error:
            self._fs.delete(hidden, False)
            if self._fs.exists(to):
                raise VersionConflict(f"version {based_on + 1} exists") from error
            raise
        return based_on + 1
