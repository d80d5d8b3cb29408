"""Readers and writers with declared schemas, and the checks that go with them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schemas import struct
from lodestone.session import delete, shared_dir


def read_shards(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet shards with a fixed schema and only the columns asked for; shard and row number come from file metadata."""
    df = spark.read.schema(schema).parquet(path)
    shard = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1).try_cast("int")
    return df.select(*(columns or schema.fieldNames()), shard.alias("source_shard"), F.col("_metadata.row_index").cast("int").alias("source_row"))


def read_range(df: DataFrame, ident: str, low: int, high: int) -> DataFrame:
    """Rows of [low, high): a predicate that row-group statistics of a sorted file answer."""
    if low >= high:
        raise IndexError(f"empty range [{low}, {high})")
    return df.where((F.col(ident) >= low) & (F.col(ident) < high))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that are no JSON of the schema are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """key, name, patterns of a dictionary of lines `key: {name: "...", patterns: ['...', '...']}`; comments and blank lines go, a
    key that comes twice or a line of another form is an error."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    form = r"""^([A-Za-z0-9_]+):\s*\{name:\s*"([^"]*)",\s*patterns:\s*\[(.*)\]\s*\}\s*$"""
    key = F.when(F.col("value").rlike(form), F.regexp_extract("value", form, 1)).otherwise(F.raise_error(F.concat(F.lit("no dictionary line: "), F.col("value"))).cast("string"))
    found = lines.select(key.alias("key"), F.regexp_extract("value", form, 2).alias("name"), F.regexp_extract_all(F.regexp_extract("value", form, 3), F.lit("'([^']*)'"), 1).alias("patterns"))
    return check_unique(found, "key")


def read_questions(spark: SparkSession, path: str, schema: T.StructType, ident: str = "id") -> DataFrame:
    df = read_jsonl(spark, path, schema)
    twice = df.groupBy(ident).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"repeated id {twice[0][ident]}")
    if df.isEmpty():
        raise ValueError("no question")
    return df


def as_view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def swap_view(spark: SparkSession, alias: str, df: DataFrame) -> str | None:
    """Point an alias at new data; readers see the old rows or the new ones. Returns the alias if it existed."""
    had = spark.catalog.tableExists(alias)
    df.createOrReplaceTempView(alias)
    return alias if had else None


def write_sorted(df: DataFrame, path: str, key: str) -> None:
    """A range-partitioned, sorted zstd file set; the commit protocol makes it appear as a whole."""
    df.sort(key).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(spark: SparkSession, path: str, body: dict[str, Any], version: int = 1, revision: str = "") -> None:
    """A small report under a header, written beside and renamed, by Hadoop's file systems."""
    text = json.dumps({"schema_version": version, "generated_at": datetime.now(timezone.utc).isoformat(), "git_sha": revision, **body}, ensure_ascii=False)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    tmp, final = hadoop(f"{path}.tmp"), hadoop(path)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not fs.rename(tmp, final):  # not all file systems rename onto a file
        fs.delete(final, False)
        fs.rename(tmp, final)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files under the paths."""
    found = []
    for path in paths:
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def cached(spark: SparkSession, name: str, sources: Sequence[str], build: Callable[[str], None]) -> str:
    """The path of what `build` wrote for these sources: built once for each state of their files."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{fingerprint(spark, *sources)[:24]}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.done")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        delete(spark, path)
        build(path)
        fs.create(done, True).close()
    return path


def markdown_block(text: str, name: str, rows: Sequence[dict[str, Any]]) -> str:
    """Replace what stands between <!-- name:start --> and <!-- name:end --> by a table; missing marks are an error."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    a, b = text.find(start), text.find(end)
    if a < 0 or b < a:
        raise ValueError(f"marks of {name} are missing")
    cols = list(rows[0]) if rows else []
    lines = ["| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)] + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in cols) + " |" for r in rows]
    return text[: a + len(start)] + "\n" + "\n".join(lines) + "\n" + text[b:]


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows in place of old ones with their key; doing it again changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"not unique: {twice[0]}")
    return df


def check_dimension(df: DataFrame, vector: str, dims: int) -> DataFrame:
    if df.where(F.col(vector).isNotNull() & (F.size(vector) != dims)).take(1):
        raise ValueError(f"{vector} must have {dims} components")
    return df


class Manifest:
    """Which outputs are up to date: a small table of (name, fingerprint), kept as JSON lines in the shared folder."""

    SCHEMA = struct("name string, fingerprint string, seq bigint")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def current(self) -> dict[str, str]:
        try:
            rows = read_jsonl(self.spark, self.path, self.SCHEMA).groupBy("name").agg(F.max_by("fingerprint", "seq").alias("f")).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        return {r["name"]: r["f"] for r in rows}

    def done(self, name: str, fingerprint: str) -> None:
        n = len(self.current())
        row = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(fingerprint).alias("fingerprint"), F.lit(n + int(datetime.now().timestamp() * 1e6)).alias("seq"))
        append_jsonl(row, self.path)

    def run(self, name: str, fingerprint: str, step: Callable[[], None]) -> bool:
        """Runs the step unless it is recorded with the same fingerprint; tells whether it ran."""
        if self.current().get(name) == fingerprint:
            return False
        step()
        self.done(name, fingerprint)
        return True
