"""Gold values with their checks, chunk-level fusion, the retrieval driver, and legacy-style error lists."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import filters, search


def gold_value(spark: SparkSession, sql: str, least: int = 20) -> dict:
    """One row without nulls; counts (n or n_*) of at least `least`. All that is wrong is told at once."""
    rows = filters.gated_sql(spark, sql).limit(2).collect()
    errors = [] if len(rows) == 1 else [f"{len(rows)} rows instead of one"]
    for k, v in (rows[0].asDict().items() if rows else ()):
        if v is None or v != v:
            errors.append(f"{k} is missing")
        elif (k == "n" or k.startswith("n_")) and v < least:
            errors.append(f"{k} = {v} is below {least}")
    if errors:
        raise ValueError("; ".join(errors))
    return rows[0].asDict()


def gold_ids(spark: SparkSession, sql: str, ident: str = "listing_id", cluster: str = "dup_cluster_id", most: int = 5) -> list[int]:
    """The clusters that a lookup asks for: at least one row with an id, at most `most` clusters."""
    df = filters.gated_sql(spark, sql)
    if ident not in df.columns:
        raise ValueError(f"the statement must give {ident}")
    found = [r[0] for r in df.select(F.coalesce(F.col(cluster), F.col(ident)) if cluster in df.columns else F.col(ident)).distinct().limit(most + 1).collect()]
    if not 0 < len(found) <= most:
        raise ValueError(f"{len(found)} clusters; 1 to {most} are allowed")
    return sorted(found)


def fuse_chunks(lists: Sequence[DataFrame], k: int, depth: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Fusion on chunks, then the first chunk of each listing: doc_id is a point id (listing * 64 + chunk)."""
    fused = search.hybrid(lists, depth, depth, by).withColumn("listing_id", F.floor(F.col("doc_id") / 64))
    best = fused.groupBy(*by, "listing_id").agg(F.min(F.struct((-F.col("rrf")).alias("s"), "doc_id")).alias("b"))
    out = best.select(*by, "listing_id", F.col("b.doc_id").alias("point_id"), (-F.col("b.s")).alias("rrf"))
    if not by:
        return out.orderBy(F.desc("rrf"), "point_id").limit(k)
    return search.best_rows(out, k, by, "rrf", "point_id").drop("rank")


def retrieve(df: DataFrame, given: dict, period: tuple[str, str], find: Callable[[DataFrame], DataFrame], k: int, kinds: Sequence[str]) -> tuple[DataFrame, str | None]:
    """Validated filters, relaxed until rows are left, then any search over those rows."""
    rows, note = filters.relax(df, filters.validate(given, property_types=kinds), period)
    return find(rows).limit(k), note


def failures(scores: DataFrame, n: int, skip: str = "llm_only") -> DataFrame:
    """First n rows without full points, leaving out one system."""
    return scores.where((F.col("system") != skip) & (F.coalesce("points", F.lit(0)) < 2)).orderBy("id", "system").limit(n)


def cards(hits: DataFrame) -> DataFrame:
    """Rounded score, joined address, one-line excerpt."""
    return hits.select("listing_id", F.round("score", 3).alias("score"), F.concat_ws(", ", "ward", "district", "province").alias("address"), F.left(F.regexp_replace("description", "\n", " · "), F.lit(70)).alias("excerpt"))


def plain(value):
    """A collected cell as a plain value: NaN, NaT and infinities are null, numpy scalars Python ones, rows dicts."""
    if value is None or value != value:
        return None
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and math.isinf(value) else value


def collect_within(df: DataFrame, rows: int, seconds: float) -> list[dict]:
    """At most `rows` plain rows; the job is cancelled on the cluster after `seconds`."""
    sc = df.sparkSession.sparkContext
    tag = f"lodestone-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: sc.cancelJobsWithTag(tag))
    sc.addJobTag(tag)
    timer.start()
    try:
        return [plain(r) for r in df.limit(rows).collect()]
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
