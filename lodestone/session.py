"""Session settings that the engine is designed for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("lodestone")
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by spark.checkpoint.dir. Where it is unset, a temporary one serves a
    local master; on a cluster that is an error, since executors would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{os.urandom(6).hex()}"


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, by Hadoop's file systems."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB where the session has Spark's own 64 MB: a task holds a batch several times, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB"):
        spark.conf.set(key, SETTINGS[key])


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage with a written table: it outlives lost executors, is read by column, and tells its size to the optimizer. Row
    groups are of 32 MB, since each writing task holds one."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, name)
    df.write.option("parquet.block.size", str(32 << 20)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def spread(df: DataFrame, per_core: int = 4 << 20) -> DataFrame:
    """The rows of a small input dealt out to all cores, for stages that compute long on each row: a file of one row group is
    one task otherwise. Inputs of more than `per_core` bytes a core have row groups enough and stay as they are."""
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * per_core else df


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for t in tables:
        if getattr(t, "stored_at", None):
            delete(t.sparkSession, t.stored_at)
