"""Chunking, postings, BM25, dense search, rank fusion and hybrid retrieval over DataFrames.

Filters come before any scoring, so they reach the scan. A single query travels as literals. Sets of query vectors are taken
in slices of a bounded number, each of which is broadcast for one pass over the rows; sets of text queries are searched in
text_index.py.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import words
from lodestone.functions.values import bm25_idf, bm25_weight, cosine, dot, point_id, sql_key

RRF_K = 60
#: Query vectors of one pass over the rows, and digits of a score that count for ranking.
PER_PASS, DIGITS = 4096, 9


def chunks(df: DataFrame, ident: str, header: Column, text: str, size: int = 400, overlap: int = 100, header_max: int = 96, cap: int = 64, tokens: Column | None = None) -> DataFrame:
    """CHUNK rows: windows of tokens over the text, each behind the header. A window holds `size` tokens less the header's; an
    empty text is one chunk of the header alone; chunks above the cap are cut and counted in `truncated`."""
    toks = tokens if tokens is not None else F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    head = F.slice(F.filter(F.split(F.coalesce(header, F.lit("")), r"\s+"), lambda w: w != ""), 1, header_max)
    rows = df.select(F.col(ident).alias("listing_id"), head.alias("__h"), toks.alias("__t"))
    step = F.lit(size - overlap) - F.size("__h")
    body = F.lit(size) - F.size("__h")
    n = F.size("__t")
    total = F.when(n > body, F.ceil((n - overlap) / (body - overlap))).otherwise(1).cast("int")
    rows = rows.withColumns({"__n": total, "__step": F.greatest(step, F.lit(1)), "__body": body})
    out = rows.select("listing_id", (F.col("__n") > cap).alias("truncated"), "__h", "__t", "__step", "__body", F.posexplode(F.sequence(F.lit(0), F.least("__n", F.lit(cap)) - 1)).alias("chunk_index", "__i"))
    window = F.slice("__t", F.col("__i") * F.col("__step") + 1, F.col("__body"))
    body_text = F.array_join(window, " ")
    return out.select(
        point_id(F.col("listing_id"), F.col("chunk_index")).alias("point_id"), "listing_id", "chunk_index",
        F.concat_ws("\n", F.when(F.size("__h") > 0, F.array_join("__h", " ")), F.when(body_text != "", body_text)).alias("text"),
        (F.size("__h") + F.size(window)).alias("n_tokens"), "truncated",
    )


def whole_chunks(df: DataFrame, ident: str, text: str, size: int = 400, overlap: int = 100) -> DataFrame:
    """As chunks without a header, but of the whole text, however long. The point id is ident * 2^31 + chunk_index as a decimal,
    which no two chunks share. Windows are cut inside the document's row, so its words are not copied to every chunk."""
    rows = df.select(F.col(ident).alias("listing_id"), F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "").alias("__t"))
    n = F.size("__t")
    total = F.when(n > size, F.ceil((n - overlap) / (size - overlap))).otherwise(1).cast("int")
    windows = F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.slice("__t", i * (size - overlap) + 1, size))
    parts = F.transform(windows, lambda w: F.struct(F.array_join(w, " ").alias("text"), F.size(w).alias("n_tokens")))
    out = rows.select("listing_id", F.posexplode(parts).alias("chunk_index", "__c"))
    ident_part = F.col("listing_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    return out.select((ident_part + F.col("chunk_index")).cast("decimal(31,0)").alias("point_id"), "listing_id", "chunk_index", "__c.text", "__c.n_tokens")


def postings(df: DataFrame, ident: str, text: str, cap: int = 65535) -> DataFrame:
    """doc_id, term, tf (capped), doc_len: one row per distinct term of a document, counted inside the row."""
    rows = df.select(F.col(ident).alias("doc_id"), words(F.col(text)).alias("w"))
    each = rows.select("doc_id", F.size("w").alias("doc_len"), F.explode("w").alias("term"))
    return each.groupBy("doc_id", "term", "doc_len").agg(F.least(F.count("*"), F.lit(cap)).cast("int").alias("tf"))


def sparse_vectors(post: DataFrame) -> DataFrame:
    """doc_id, terms[], tfs[] (terms sorted), doc_len."""
    packed = post.groupBy("doc_id", "doc_len").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("v"))
    return packed.select("doc_id", F.col("v.term").alias("terms"), F.col("v.tf").alias("tfs"), "doc_len")


def corpus_stats(df: DataFrame, text: str) -> tuple[int, float]:
    """Documents and mean length; an empty corpus is an error."""
    n, avg = df.agg(F.count("*"), F.avg(F.size(words(F.col(text))))).first()
    if not n:
        raise ValueError("no documents")
    return n, float(avg)


def occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def bm25(df: DataFrame, ident: str, text: str, query: Sequence[str], k: int, where: Column | None = None) -> DataFrame:
    """Best k documents for a set of query terms, with scores; statistics are those of the whole corpus. No query term: no row.

    Only the query's terms are counted, by array functions inside the document's row, so the scan is the only full pass.
    """
    terms = sorted(set(query))
    source = df.select(F.col(ident).alias("doc_id"), F.col(text).alias("__text"), (F.lit(True) if where is None else where).alias("__ok"))
    if not terms:
        return source.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    # The tokens are a column of their own: it is used several times, so Catalyst keeps it apart and splits a text once.
    tokens = source.select("doc_id", "__ok", words(F.col("__text")).alias("w"))
    counted = tokens.select("doc_id", "__ok", F.size("w").alias("len"), *[occurrences(F.col("w"), t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    both = counted.where("__ok").join(F.broadcast(stats))
    score = sum((F.when(F.col(f"tf{i}") > 0, bm25_idf(F.col("n"), F.col(f"df{i}")) * bm25_weight(F.col(f"tf{i}"), F.col("len"), F.col("avgdl"))).otherwise(0.0) for i in range(len(terms))), F.lit(0.0))
    return both.select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def dense(df: DataFrame, ident: str, vector: str, query: Sequence[float], k: int, where: Column | None = None, unit: bool = False) -> DataFrame:
    """Best k by cosine (dot product for unit vectors), exact, filter first."""
    rows = df if where is None else df.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(F.col(vector), q) if unit else cosine(F.col(vector), q)
    return rows.select(F.col(ident).alias("doc_id"), score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "doc_id").limit(k)


def best_rows(scored: DataFrame, k: int, by: Sequence[str] = ("q",), score: str = "score", ident: str = "doc_id") -> DataFrame:
    """Adds rank; the best k rows of each query, ties by id."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), ident)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The best k rows of each query so far, over batches of scores."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        open_ = scores >= self.scores[:, -1:]
        for q in np.flatnonzero(open_.any(axis=1)):
            at = np.flatnonzero(open_[q] & (scores[q] > -np.inf))
            if len(at) > self.k:
                at = at[scores[q][at] >= np.partition(scores[q][at], -self.k)[-self.k]]
            s, i = np.concatenate((self.scores[q], scores[q][at])), np.concatenate((self.ids[q], ids[at]))
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]


    def add_some(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """As add(), for scores of some items of some queries; `queries` is in order."""
        last, at = self.scores[queries, -1], self.ids[queries, -1]
        good = (scores > last) | ((scores == last) & (ids < at))
        queries, scores, ids = queries[good], scores[good], ids[good]
        starts = np.flatnonzero(np.concatenate(([True], queries[1:] != queries[:-1]))) if len(queries) else []
        for a, b in zip(starts, np.append(starts[1:], len(queries))):
            q = queries[a]
            s, i = np.concatenate((self.scores[q], scores[a:b])), np.concatenate((self.ids[q], ids[a:b]))
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]


def vector_rows(vectors: pa.Array | pa.ChunkedArray, dims: int, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that have `dims` finite components (as unit vectors, if they are not zero), and which rows these are."""
    rows = vectors.to_pylist()
    ok = [i for i, x in enumerate(rows) if x is not None and len(x) == dims and None not in x]
    m = np.array([rows[i] for i in ok], dtype=np.float64).reshape(len(ok), dims)
    with np.errstate(invalid="ignore", over="ignore"):
        n = np.linalg.norm(m, axis=1)
    good = np.isfinite(n) & (n > 0) if unit else np.isfinite(n)
    m = m[good]
    return m / n[good][:, None] if unit else m, np.array(ok, dtype=np.int64)[good]


def scores_of(a: np.ndarray, b: np.ndarray, unit: bool) -> np.ndarray:
    """Cosines of unit vectors, or negative squared distances."""
    dot = a @ b.T
    return np.round(dot if unit else 2 * dot - (a * a).sum(axis=1)[:, None] - (b * b).sum(axis=1)[None, :], DIGITS)


def dense_batch(items: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, where: Column | None = None, others: bool = False, per_pass: int = PER_PASS, metric: str = "cosine") -> DataFrame:
    """q, doc_id, score, rank: for each query row (same column names) its best k items by exact cosine (or euclidean distance, as
    negative squares).

    Each task keeps the best k of every query of the pass while it reads its rows in blocks, so k rows a query leave a task.
    Scores count to nine digits, ties go to the least id; vectors that are null, zero, of another length or not finite have
    no score. others=True leaves out an item with the query's own id.
    """
    spark, cosine_ = items.sparkSession, metric == "cosine"
    rows = (items if where is None else items.where(where)).select(F.col(ident).cast("long").alias("doc_id"), F.col(vector).alias("x"))
    asked = queries.select(F.col(ident).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("x")).where("q IS NOT NULL AND x IS NOT NULL")
    passes = max(1, -(-asked.count() // per_pass))
    out = None
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64(F.lit(7), "q"), F.lit(passes)) == p).collect()
        by_dims = {}
        for dims in {len(r["x"]) for r in part}:
            own = [r for r in part if len(r["x"]) == dims]
            unit, at = vector_rows(pa.array([r["x"] for r in own]), dims, cosine_)
            by_dims[dims] = (np.array([own[i]["q"] for i in at], dtype=np.int64), unit)
        shared = spark.sparkContext.broadcast(by_dims)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: Best(len(q), k) for d, (q, _) in shared.value.items()}
            for batch in batches:
                for a in range(0, len(batch), 1024):
                    block = batch.slice(a, 1024)
                    for d, (q, unit) in shared.value.items():
                        x, at = vector_rows(block.column("x"), d, cosine_)
                        ids = block.column("doc_id").to_numpy(zero_copy_only=False)[at]
                        scores = scores_of(unit, x, cosine_)
                        if others:
                            scores[q[:, None] == ids[None, :]] = -np.inf
                        best[d].add(scores, ids)
            for d, (q, _) in shared.value.items():
                at, col = np.nonzero(best[d].scores > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(best[d].ids[at, col]), pa.array(best[d].scores[at, col])], names=["q", "doc_id", "score"])

        found = rows.where("doc_id IS NOT NULL").mapInArrow(search, "q long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    return best_rows(out, k)


def best_chunk(hits: DataFrame, group: str = "listing_id", chunk: str = "chunk_index") -> DataFrame:
    """One row per group: its best chunk."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), chunk)
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def ranked(hits: DataFrame, name: int, by: Sequence[str] = ()) -> DataFrame:
    """Positions from 1 on, for each query if `by` names its columns. Rankings are top-k results, so a window's rows are few."""
    return hits.withColumns({"list_no": F.lit(name), "rank": F.row_number().over(Window.partitionBy(*(by or [F.lit(name)])).orderBy(F.desc("score"), "doc_id"))})


def rrf(rankings: DataFrame, k: int, c: int = RRF_K, by: Sequence[str] = ()) -> DataFrame:
    """Sum of 1/(c + rank) over lists; ties by first appearance (list, then rank). `rankings`: doc_id, list_no, rank, and the
    columns of the query in `by`, if there are several."""
    fused = rankings.groupBy(*by, "doc_id").agg(F.sum(1.0 / (c + F.col("rank"))).alias("rrf"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = [F.desc("rrf"), "first", "doc_id"]
    if not by:
        return fused.orderBy(*order).limit(k).select("doc_id", "rrf")
    return fused.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("pos") <= k).select(*by, "doc_id", "rrf")


def hybrid(lists: Sequence[DataFrame], k: int, depth: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Each ranking cut to max(depth, k), fused by reciprocal rank; best_rank is the best position in any list."""
    parts = [ranked(h, i, by).where(F.col("rank") <= max(depth, k)).select(*by, "doc_id", "list_no", "rank") for i, h in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    # Dealt out anew: Spark 4.1 takes a union of parts that are dealt by q as dealt by q itself, though adaptive execution may have
    # merged the parts' partitions differently, and would then count a document of both lists as two.
    both = both.repartition(*by, "doc_id")
    best = both.groupBy(*by, "doc_id").agg(F.min("rank").alias("best_rank"))
    return rrf(both, k, by=by).join(best, [*by, "doc_id"])


def rerank(hits: DataFrame, score: Column, top: int = 20, k: int = 5) -> DataFrame:
    """The best `top` scored again by any expression (a pandas UDF around a model, for one), best k out."""
    return hits.orderBy(F.desc("score"), "doc_id").limit(top).withColumn("rerank", score).orderBy(F.desc("rerank"), "doc_id").limit(k)


def fetch_in_order(df: DataFrame, ident: str, ids: Sequence[int]) -> DataFrame:
    """Rows of the ids in the given order; missing ids are skipped, repeated ones come once."""
    order = df.sparkSession.range(1).select(F.posexplode(F.array_distinct(F.array(*[F.lit(int(i)) for i in ids]))).alias("pos", "__id"))
    return df.where(F.col(ident).isin(*[int(i) for i in ids])).join(F.broadcast(order), F.col(ident) == F.col("__id")).drop("__id").orderBy("pos")


def hashed(ident: Column | str, seed: int) -> Column:
    """A repeatable 60-bit number of an id, that other engines give as well (a prefix of an MD5)."""
    c = F.col(ident) if isinstance(ident, str) else ident
    return sql_key(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def sample_rows(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample without replacement: the n least hashes."""
    return df.orderBy(hashed(ident, seed), ident).limit(n)


def folds(ident: Column, k: int, seed: int = 42) -> Column:
    return F.pmod(hashed(ident, seed), F.lit(k)).cast("int")


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each group."""
    each = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def keyed_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A join of row-aligned tables by key; raises unless both have the same ids once each."""
    a = left.select(key).groupBy(key).agg(F.count("*").alias("l"))
    b = right.select(key).groupBy(key).agg(F.count("*").alias("r"))
    if a.join(b, key, "full").where("l IS NULL OR r IS NULL OR l <> 1 OR r <> 1").take(1):
        raise ValueError(f"the tables do not have the same {key} once each")
    return left.join(right, key)
