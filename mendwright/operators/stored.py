"""Stored tables: insert, update and delete rows of a Parquet table in place, version by version.

Rows are dealt into buckets by a hash of their key. A version is a small manifest that names a folder of Parquet files for each
bucket; a change writes new folders for the buckets that its keys fall into, and a manifest that names these beside the
untouched old ones. Manifests are numbered, and a number is taken by one atomic step (a link or a rename that fails if the
name is there), so a version is either wholly there or not at all. A writer that finds its number taken looks at what the others have
changed: if they left its buckets alone, its folders go into the next manifest as they are, otherwise it works its change out
anew. Readers hold on to the version they began with, whatever is written meanwhile.

With ``who``, changes are the caller's: rows that are stored under another owner stay as they are, and new rows become the caller's.

Defined cases: null keys and keys that occur twice in one change are refused; null owners are nobody's; changes without rows make no
version; deleting what isn't there changes nothing. The manifest grows with the buckets, never with the rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """A change that other writers overtook time and again."""


class StoredTable:
    """A table in a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, tries: int = 20) -> None:
        self.spark, self.path, self.tries = spark, path.rstrip("/"), tries
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._hadoop = jvm.org.apache.hadoop.fs.Path

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, owner: str | None = None, buckets: int = 64) -> StoredTable:
        """A new table of these rows."""
        table = cls(rows.sparkSession, path)
        if table._numbers():
            raise FileExistsError(path)
        head = {"key": key, "owner": owner, "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": {}}
        table._check(rows, head)
        head["folders"] = table._written(rows.withColumn(BUCKET, table._bucket(head)))
        if not table._take(0, head):
            raise FileExistsError(path)
        return table

    # reading

    def version(self) -> int:
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(self.path)
        return max(numbers)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest unless told."""
        return self._rows(self._manifest(self.version() if version is None else version))

    def owned(self, who) -> DataFrame:
        """The caller's rows."""
        head = self._manifest(self.version())
        return self._rows(head).where(F.col(head["owner"]) == F.lit(who))

    def get(self, key, who=None) -> DataFrame:
        """The row of a key, from its bucket alone."""
        head = self._manifest(self.version())
        number = self.spark.range(1).select(F.lit(key).cast(self._kind(head)).alias(head["key"])).select(self._bucket(head)).first()[0]
        row = self._rows(head, {number}).where(F.col(head["key"]) == F.lit(key))
        return row if who is None else row.where(F.col(head["owner"]) == F.lit(who))

    # changing

    def upsert(self, rows: DataFrame, who=None) -> int:
        """Rows take the place of those with their key, others are added. The version that has them."""

        def changed(old: DataFrame, new: DataFrame, head: dict) -> DataFrame:
            key, owner = head["key"], head["owner"]
            if who is not None:
                theirs = old.where(~F.col(owner).eqNullSafe(F.lit(who))).select(key)
                new = new.withColumn(owner, F.lit(who).cast(old.schema[owner].dataType)).join(theirs, key, "left_anti").select(*new.columns)
            return old.join(new.select(key), key, "left_anti").unionByName(new)

        return self._change(rows, changed)

    def update(self, keys: DataFrame, columns: dict[str, object], who=None) -> int:
        """Sets columns (values, or expressions over the row) where the key is among ``keys``."""

        def changed(old: DataFrame, new: DataFrame, head: dict) -> DataFrame:
            hit = old.join(new.withColumn("_hit", F.lit(True)), head["key"], "left")
            mine = F.coalesce("_hit", F.lit(False)) & (F.lit(True) if who is None else F.col(head["owner"]).eqNullSafe(F.lit(who)))
            value = lambda c: columns[c] if hasattr(columns[c], "alias") else F.lit(columns[c])
            return hit.select(*[F.when(mine, value(c).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])

        return self._change(keys, changed, keys_only=True)

    def delete(self, keys: DataFrame, who=None) -> int:
        """Removes the rows whose key is among ``keys``."""

        def changed(old: DataFrame, new: DataFrame, head: dict) -> DataFrame:
            gone = new if who is None else old.where(F.col(head["owner"]).eqNullSafe(F.lit(who))).select(head["key"]).join(new, head["key"], "left_semi")
            return old.join(gone, head["key"], "left_anti")

        return self._change(keys, changed, keys_only=True)

    def vacuum(self, keep: int = 10) -> int:
        """Removes the folders that none of the last ``keep`` versions names, and older manifests; how many. For times without writers."""
        numbers = sorted(self._numbers())
        for n in numbers[:-keep]:
            self._fs.delete(self._hadoop(self._name(n)), False)
        used = {f.split("/")[0] for n in numbers[-keep:] for f in self._manifest(n)["folders"].values()}
        folders = [s.getPath() for s in self._fs.listStatus(self._hadoop(f"{self.path}/data"))]
        gone = [p for p in folders if p.getName() not in used]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    # versions

    def _change(self, rows: DataFrame, changed: Callable[[DataFrame, DataFrame, dict], DataFrame], keys_only: bool = False) -> int:
        base = self.version()
        head = self._manifest(base)
        schema = T.StructType.fromJson(head["schema"])
        new = rows.select(head["key"]).distinct() if keys_only else rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names])
        new = self._checked(new, head)
        numbers = {r[0] for r in new.select(BUCKET).distinct().collect()}
        if not numbers:
            return base
        ours: dict[str, str] | None = None
        for _ in range(self.tries):
            if ours is None:
                old = self._rows(head, numbers)
                done = changed(old, new.drop(BUCKET), head)
                ours = self._written(done.withColumn(BUCKET, self._bucket(head)))
            folders = {b: f for b, f in head["folders"].items() if int(b) not in numbers} | ours
            if self._take(base + 1, head | {"folders": folders}):
                return base + 1
            seen, base = head["folders"], self.version()
            head = self._manifest(base)
            if any(seen.get(str(b)) != head["folders"].get(str(b)) for b in numbers):
                ours = None  # someone changed our buckets
        raise Conflict(f"{self.path}: overtaken {self.tries} times")

    def _checked(self, new: DataFrame, head: dict) -> DataFrame:
        """The rows with their bucket, written once: a change may be worked out several times, from the same rows."""
        self._check(new, head)
        folder = f"{self.path}/changes/{uuid.uuid4().hex}"
        marked = new.withColumn(BUCKET, self._bucket(head))
        marked.write.parquet(folder)
        self._fs.deleteOnExit(self._hadoop(folder))
        return self.spark.read.schema(marked.schema).parquet(folder)

    def _check(self, rows: DataFrame, head: dict) -> None:
        key = F.col(head["key"])
        if not rows.groupBy(key).agg(F.count("*").alias("n")).where(key.isNull() | (F.col("n") > 1)).isEmpty():
            raise ValueError(f"{head['key']} is null or occurs twice in a change")

    def _bucket(self, head: dict):
        return F.pmod(F.xxhash64(F.col(head["key"]).cast(self._kind(head))), F.lit(head["buckets"])).cast("int").alias(BUCKET)

    def _kind(self, head: dict) -> T.DataType:
        return T.StructType.fromJson(head["schema"])[head["key"]].dataType

    def _rows(self, head: dict, numbers: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(head["schema"])
        folders = [f"{self.path}/data/{f}" for b, f in head["folders"].items() if numbers is None or int(b) in numbers]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        name = uuid.uuid4().hex
        folder = self._hadoop(f"{self.path}/data/{name}")
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder.toString())
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return {n.split("=")[1]: f"{name}/{n}" for n in found if n.startswith(f"{BUCKET}=")}

    def _name(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def _numbers(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return [int(n[:-5]) for n in (s.getPath().getName() for s in self._fs.listStatus(folder)) if n.endswith(".json") and n[:-5].isdigit()]

    def _manifest(self, number: int) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(self._name(number), wholetext=True).collect()))

    def _take(self, number: int, head: dict) -> bool:
        """Makes this manifest the version of that number, unless there is one."""
        temp, name = self._hadoop(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._hadoop(self._name(number))
        out = self._fs.create(temp)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # renames take the place of what is there, links don't
                try:
                    os.link(temp.toUri().getPath(), name.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(name) and self._fs.rename(temp, name)
        finally:
            if self._fs.exists(temp):
                self._fs.delete(temp, False)
