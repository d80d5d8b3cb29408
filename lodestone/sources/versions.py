"""Versioned tables in a shared folder: numbered snapshots and deltas, merged when they are read, and names that point at them.

A table is a folder of Parquet data and a log. Version n is log entry n: a small file that appears by one rename which never
replaces another, so of two writers that saw the same version one commits and the other gets a Conflict. Data is written
before its entry, so a writer that dies leaves the old version as it was. A reader takes the last snapshot up to its version and
the deltas after it; the last delta that has a key decides it. A name is a file that one rename replaces: readers see the old
target or the new one, in every session. Renames are atomic on HDFS and local folders; on an object store without such a rename
two writers at the same moment could both believe they were first.
"""

from __future__ import annotations

import json
import os
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import delete, exists
from lodestone.sources.io import check_unique

GONE, AT = "__gone", "__version"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def rename(spark: SparkSession, old: str, new: str, replace: bool) -> None:
    """One rename; without `replace` an existing target is a Conflict."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    source, target = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if replace else kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)
    except Py4JJavaError as e:
        delete(spark, old)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"{new} is there already") from None
        raise


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _entry(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}.json"

    def entries(self) -> list[dict]:
        """The log: version, kind (snapshot or delta), data, rows."""
        if not exists(self.spark, f"{self.path}/log"):
            return []
        rows = self.spark.read.schema("version long, kind string, data string, rows long").json(f"{self.path}/log/*.json").collect()
        return [r.asDict() for r in sorted(rows, key=lambda r: r["version"])]

    def version(self) -> int:
        """The last version; -1 if there is none."""
        return max((e["version"] for e in self.entries()), default=-1)

    def _commit(self, df: DataFrame, kind: str, at: int) -> int:
        data, new = f"data/{at + 1:012d}-{os.urandom(6).hex()}", at + 1
        df.write.parquet(f"{self.path}/{data}")
        rows = self.spark.read.parquet(f"{self.path}/{data}").count()
        draft = f"{self.path}/drafts/{os.urandom(8).hex()}.json"
        write_text(self.spark, draft, json.dumps({"version": new, "kind": kind, "data": data, "rows": rows}))
        if not exists(self.spark, f"{self.path}/log"):
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        try:
            rename(self.spark, draft, self._entry(new), False)
        except Conflict:
            delete(self.spark, f"{self.path}/{data}")
            raise
        return new

    def create(self, df: DataFrame) -> int:
        """The first version; a Conflict if there is one."""
        return self._commit(check_unique(df, self.key), "snapshot", -1)

    def upsert(self, df: DataFrame, at: int | None = None) -> int:
        """New rows, and new values of known keys. `at` is the version that the rows were made from, the last one by default."""
        at = self.version() if at is None else at
        return self._commit(check_unique(df, self.key).withColumn(GONE, F.lit(False)), "delta", at)

    def remove(self, keys: DataFrame, at: int | None = None) -> int:
        """Rows of these keys go; unknown keys are no error."""
        at = self.version() if at is None else at
        columns = self.read(at).schema
        rows = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return self._commit(rows.select(*[F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in columns], F.lit(True).alias(GONE)), "delta", at)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one by default)."""
        log = [e for e in self.entries() if version is None or e["version"] <= version]
        if not log or (version is not None and log[-1]["version"] != version):
            raise ValueError(f"{self.path} has no version {version}")
        base = max(k for k, e in enumerate(log) if e["kind"] == "snapshot")
        rows = self.spark.read.parquet(f"{self.path}/{log[base]['data']}")
        deltas = [self.spark.read.parquet(f"{self.path}/{e['data']}").withColumn(AT, F.lit(e["version"])) for e in log[base + 1 :]]
        if not deltas:
            return rows
        last = reduce(DataFrame.unionByName, deltas).groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != self.key], GONE), AT).alias("r"))
        alive = last.where(f"NOT r.{GONE}").select(*[F.col(c) if c == self.key else F.col(f"r.`{c}`").alias(c) for c in rows.columns])
        return rows.join(last.select(self.key), self.key, "left_anti").select(*rows.columns).unionByName(alive)

    def compact(self) -> int:
        """The last version as one snapshot, so that reading it merges nothing."""
        at = self.version()
        return self._commit(self.read(at), "snapshot", at)

    def sweep(self, keep: int) -> int:
        """Delete data that no version from `keep` on reads, and what writers left that never committed; their number."""
        log = self.entries()
        base = max((k for k, e in enumerate(log) if e["kind"] == "snapshot" and e["version"] <= keep), default=0)
        used = {e["data"] for e in log[base:]}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        gone = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f"data/{f.getPath().getName()}" not in used]
        for e in log[:base]:
            delete(self.spark, self._entry(e["version"]))
        for p in gone:
            delete(self.spark, p.toString())
        return len(gone)


def set_name(spark: SparkSession, folder: str, name: str, target: str) -> None:
    """Point a name at a target, in one rename; doing it again changes nothing."""
    draft = f"{folder}/drafts/{os.urandom(8).hex()}.json"
    write_text(spark, draft, json.dumps({"target": target}))
    final = f"{folder}/names/{name}.json"
    parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/names")
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(parent)
    rename(spark, draft, final, True)


def target_of(spark: SparkSession, folder: str, name: str) -> str | None:
    path = f"{folder}/names/{name}.json"
    return spark.read.schema("target string").json(path).first()["target"] if exists(spark, path) else None
