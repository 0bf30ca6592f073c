"""Tables whose versions are named by manifests: a commit writes the files it changes and then one small manifest.

A table's rows are dealt to buckets by a hash of its key columns, each bucket being any number of files.  `append` adds files, `merge`
writes the touched buckets anew (rows with a changed or deleted key are replaced), everything else is named again
by the new manifest.  Readers take the newest manifest and never see half a commit; of two writers that start from
the same version the second one fails with `Conflict` and can try again.  Files that no manifest names any more are
deleted by `vacuum`.

Defined results: a null key is a key like any other; of several rows of a key in one merge all are kept; a merge that touches
nothing still makes a version; an empty table has no files and its schema.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit came first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        """The newest version of the table at `path`, or the one that is asked for."""
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version = max(self.versions(), default=-1) if version is None else version
        if self.version >= 0:
            text = spark.read.text(self._manifest(self.version), wholetext=True).first()[0]
            state = json.loads(text)
            self.keys, self.buckets, self.extra = state["keys"], state["buckets"], state["extra"]
            self.schema, self.files = StructType.fromJson(state["schema"]), {int(b): f for b, f in state["files"].items()}

    @classmethod
    def staged(cls, df: DataFrame, path: str, keys: list[str], buckets: int = 16) -> VersionedTable:
        """A table whose rows are written and which nobody sees before `publish`."""
        table = cls(df.sparkSession, path, -1)
        if table.versions():
            raise Conflict(f"there is a table at {path}")
        table.keys, table.buckets, table.schema, table.extra = keys, buckets, df.schema, {}
        table.files = table._written(df)
        return table

    def publish(self, extra: dict | None = None) -> VersionedTable:
        return self._commit(self.files, extra or {})

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int = 16, extra: dict | None = None) -> VersionedTable:
        return cls.staged(df, path, keys, buckets).publish(extra)

    @property
    def exists(self) -> bool:
        return self.version >= 0

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:08d}.json"

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{8})\.json", n)))

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _written(self, df: DataFrame) -> dict[int, list[str]]:
        """New files of the rows, by bucket; large buckets are split by the adaptive rebalancing."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = df.select(*self.schema.fieldNames()).withColumn("quill_bucket", self.bucket())
        rows.hint("rebalance", "quill_bucket").sortWithinPartitions("quill_bucket", *self.keys).write.partitionBy("quill_bucket").parquet(folder)
        out: dict[int, list[str]] = {}
        files = self._files.listFiles(self._at(folder), True)
        while files.hasNext():
            name = files.next().getPath().toString()
            if m := re.search(r"quill_bucket=(\d+)/[^/]+\.parquet$", name):
                out.setdefault(int(m[1]), []).append(name)
        return out

    def _commit(self, files: dict[int, list[str]], extra: dict) -> VersionedTable:
        state = {"keys": self.keys, "buckets": self.buckets, "schema": json.loads(self.schema.json()), "files": files, "extra": extra}
        at = self._at(self._manifest(self.version + 1))
        own = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._files.create(own, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._files.exists(at) or not self._files.rename(own, at):
            self._files.delete(own, False)
            raise Conflict(f"version {self.version + 1} of {self.path} is there already")
        return VersionedTable(self.spark, self.path, self.version + 1)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets only."""
        files = [f for b, names in sorted(self.files.items()) if buckets is None or b in buckets for f in names]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that hold some keys: at most `buckets` numbers."""
        return [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def append(self, df: DataFrame, extra: dict | None = None) -> VersionedTable:
        new = self._written(df)
        return self._commit({b: self.files.get(b, []) + new.get(b, []) for b in {*self.files, *new}}, self.extra | (extra or {}))

    def merge(self, rows: DataFrame, gone: DataFrame | None = None, extra: dict | None = None) -> VersionedTable:
        """`rows` in place of the rows with their keys, and none with the keys of `gone`; only the touched buckets are read and written."""
        keys = rows.select(*self.keys)
        keys = (keys if gone is None else keys.unionByName(gone.select(*self.keys))).distinct()
        touched = self.buckets_of(keys)
        on = [F.col(f"quill_old.{k}").eqNullSafe(F.col(f"quill_new.{k}")) for k in self.keys]
        old = self.read(touched).alias("quill_old").join(keys.alias("quill_new"), on, "left_anti")
        new = self._written(old.unionByName(rows.select(*self.schema.fieldNames())))
        return self._commit({b: f for b, f in self.files.items() if b not in touched} | new, self.extra | (extra or {}))

    def rewrite(self, df: DataFrame, extra: dict | None = None) -> VersionedTable:
        """The same rows or others in new files."""
        return self._commit(self._written(df), self.extra | (extra or {}))

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the manifests before the last `keep`, and the folders of files that none of those names."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._files.delete(self._at(self._manifest(v)), False)
        named = {f.split("/data/")[1].split("/")[0] for v in versions[-keep:] for names in VersionedTable(self.spark, self.path, v).files.values() for f in names}
        folder = self._at(f"{self.path}/data")
        for s in self._files.listStatus(folder) if self._files.exists(folder) else []:
            if s.getPath().getName() not in named:
                self._files.delete(s.getPath(), True)
