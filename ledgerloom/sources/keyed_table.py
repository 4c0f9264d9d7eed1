"""A table of rows by key, as Parquet files under a version pointer: the last writer of a key wins, and readers see whole versions only.

Rows lie in a fixed number of buckets by their keys' hash. An upsert rewrites the buckets that it touches, into a new folder, and then creates the next version's
file, which names each bucket's folder. That file is created only if nobody else has created it; who comes second merges anew into what the first one wrote.
So nothing is lost, whatever the order, and a job that dies leaves files that no version names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds after which a version file that was begun and not ended counts as given up.
PATIENCE = 30


class KeyedTable:
    """``schema`` is the columns' DDL, ``keys`` those that identify a row (nulls are equal). The folder must be on a file system that creates a file once only."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def _folders(self, version: int) -> dict[str, str] | None:
        """What a version names; None while its file is being written."""
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:09d}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}\n") else None

    def version(self) -> tuple[int, dict[str, str]]:
        """The latest version's number and folders by bucket; 0 for none."""
        began = time.monotonic()
        while True:
            found = self._versions()
            if not found:
                return 0, {}
            folders = self._folders(found[-1])
            if folders is not None:
                return found[-1], folders
            if time.monotonic() - began > PATIENCE:
                raise TimeoutError(f"version {found[-1]} of {self.path} was begun and not ended")
            time.sleep(0.2)

    def _commit(self, version: int, folders: dict[str, str]) -> bool:
        """Creates a version, unless there is one."""
        path = self._path(f"{self.path}/versions/{version:09d}")
        try:
            if self._fs.getScheme() == "file":  # here only the operating system's own call creates a file once
                self._fs.mkdirs(path.getParent())
                files = self.spark._jvm.java.nio.file.Files
                files.createFile(self.spark._jvm.java.io.File(path.toUri().getPath()).toPath(), self.spark._sc._gateway.new_array(self.spark._jvm.java.nio.file.attribute.FileAttribute, 0))
                stream = self._fs.create(path, True)
            else:
                stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray((json.dumps(folders) + "\n").encode()))
        stream.close()
        return True

    def _of(self, folders: dict[str, str]) -> DataFrame:
        paths = sorted(f"{self.path}/data/{folder}/bucket={b}" for b, folder in folders.items())
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the latest version, or of an earlier one."""
        return self._of(self.version()[1] if version is None else self._folders(version) or {})

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Puts ``rows`` in the place of those of equal keys; of several rows of one key that with the largest ``order`` stays. Gives the new version's number."""
        names = self.schema.names
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        whole = F.to_json(F.struct(*names))  # of rows that tie, always the same one
        last = F.max_by(F.struct(*names), F.struct(order, whole) if order else whole)
        key = [F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys)]
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.groupBy(*key).agg(last.alias("_row")).select("_row.*").withColumn("bucket", bucket).write.parquet(staged)
        new = self.spark.read.parquet(staged)
        touched = {str(r.bucket) for r in new.select("bucket").distinct().collect()}  # at most as many as there are buckets
        while True:
            number, folders = self.version()
            if not touched:
                return number
            old = self._of({b: f for b, f in folders.items() if b in touched}).withColumn("bucket", bucket)
            same = [old[k].eqNullSafe(new[k]) for k in self.keys]
            merged = old.join(new, same, "left_anti").unionByName(new)
            folder = uuid.uuid4().hex
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            if self._commit(number + 1, folders | {b: folder for b in touched}):
                self._fs.delete(self._path(staged), True)
                return number + 1
