"""Queries over the vector collection and over versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import collection, search
from lodestone.plans.analytics import DENSE_SQL, vectors
from lodestone.plans.bindings import table
from lodestone.plans.registry import query
from lodestone.sources import io


def embeddings_collection(spark, d):
    """The collection of all embeddings with their labels as payload, written once for a table."""
    def build(to):
        collection.write_collection(table(spark, d, "embeddings"), "vec_id", "embedding", to, 64, ["label"])

    return collection.open_collection(spark, io.cached(spark, "collection", [f"{d}/embeddings.parquet"], build))


@query("SELECT count(*) AS points, count(embedding) AS indexed, true AS in_cells, count(*) FILTER (WHERE vec_id BETWEEN 10 AND 99) AS in_range, true AS recalled FROM embeddings")
def s17_vector_collection(spark, d):
    """The collection's counts, and whether a search of every fiftieth vector finds at least nine in ten of the exact ten best."""
    c, (e, q) = embeddings_collection(spark, d), vectors(spark, d)
    found = collection.search(c, q, "vec_id", "embedding", 10)
    measured = collection.recall(found, search.dense_batch(e, q, "vec_id", "embedding", 10))
    counts = collection.info(c).select("points", "indexed", (F.col("cells") > 1).alias("in_cells"), F.lit(collection.count_range(c, 10, 99)).cast("long").alias("in_range"))
    return counts.join(F.broadcast(measured.select((F.col("recall") >= 0.9).alias("recalled"))))


@query(f"WITH {DENSE_SQL}, r AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY q) AS n FROM s) SELECT q, least(n, 10)::BIGINT AS hits, doc_id AS best, round(score, 5) AS best_score FROM r WHERE rank = 1")
def c08_collection_search(spark, d):
    """Hits of every fiftieth vector; its best one is itself, or a copy with a smaller id."""
    found = collection.search(embeddings_collection(spark, d), vectors(spark, d)[1], "vec_id", "embedding", 10)
    first = F.min_by(F.struct("doc_id", "score"), "rank")
    return found.groupBy("q").agg(F.count("*").alias("hits"), first.alias("b")).select("q", "hits", F.col("b.doc_id").alias("best"), F.round("b.score", 5).alias("best_score"))


@query("SELECT vec_id AS q, (SELECT least(count(*), 10) FROM embeddings WHERE label < 3)::BIGINT AS hits, 0::BIGINT AS outside, true AS recalled FROM embeddings WHERE vec_id % 50 = 0")
def c08_filtered_collection(spark, d):
    """A search under a filter on payload: all hits pass it, none is missing, and nine in ten of the exact ones are found."""
    c, (e, q) = embeddings_collection(spark, d), vectors(spark, d)
    found = collection.search(c, q, "vec_id", "embedding", 10, F.col("label") < 3)
    measured = collection.recall(found, search.dense_batch(e, q, "vec_id", "embedding", 10, F.col("label") < 3)).select((F.col("recall") >= 0.9).alias("recalled"))
    inside = found.join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return inside.groupBy("q").agg(F.count("*").alias("hits"), F.count_if(F.col("label") >= 3).alias("outside")).join(F.broadcast(measured))
