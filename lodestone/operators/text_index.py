"""A text index in shards of documents, for many queries at once.

A shard is one row: its documents (id, length, payload), and the postings of its terms as flat arrays in the order of terms. A task
makes shards of the documents as it reads them, so the index is written in one pass without a shuffle, and a shard holds a
bounded number of postings. A search reads each shard once for a pass of queries: scores of a block of queries and all its
documents are one array. Each task keeps the best k of every query over its shards, so k rows a query leave a task, however
common a term is; a query that cannot reach its k-th score in a shard (by the largest weight of each of its terms there) is not
scored in it, and terms that cannot reach it by themselves are only looked up. Filters on payload are Columns over the
documents' structs.

Document frequencies, their number and their mean length are those of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from lodestone.functions.text import words
from lodestone.operators.search import DIGITS, Best, best_rows
from lodestone.session import scratch, small_batches, spread

#: Tokens and documents of a shard at most (a longer text is a shard of its own).
MAX_TOKENS, MAX_DOCS = 1 << 20, 1 << 14
#: Queries of one pass (they are sent to all tasks), and scores or postings of a block of queries.
PER_PASS, CELLS = 1 << 14, 1 << 20
#: Bytes of a row group of shards.
ROW_GROUP = 16 << 20
K1, B = 1.2, 0.75


@dataclass
class ShardedIndex:
    shards: DataFrame
    documents: int
    mean_length: float


def shard(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """terms in order, [terms + 1] offsets, documents (places in the list) and counts of the postings of lists of words."""
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    cells, counts = np.unique(place[coded.indices.to_numpy()] * max(1, len(lists)) + owner, return_counts=True)
    terms, docs = cells // max(1, len(lists)), cells % max(1, len(lists))
    return coded.dictionary.take(pa.array(order)), np.searchsorted(terms, np.arange(len(order) + 1)), docs, counts


def write_shards(df: DataFrame, ident: str, text: str, path: str, payload: Sequence[str] = (), cap: int = 65535) -> None:
    """Tokenises the corpus once; counts above `cap` are cut. Documents without a word are kept for the statistics."""
    split = spread(df.select(ident, text, *payload)).withColumn("__words", words(col(text)))
    rows = split.select(F.struct(col(ident).cast("long").alias("id"), F.size("__words").alias("len"), *payload).alias("doc"), col("__words").alias("words"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, docs = [], 0, 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            lists, own = table.column("words").combine_chunks(), table.column("doc").combine_chunks()
            terms, offsets, at, counts = shard(lists)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            cells = [one(x) for x in (own, terms, pa.array(offsets.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(np.minimum(counts, cap).astype(np.int32)))]
            return pa.RecordBatch.from_arrays(cells, names=["docs", "terms", "offsets", "at", "tf"])

        for batch in batches:
            sizes = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
            a = 0
            while a < len(batch):
                room = np.searchsorted(np.cumsum(sizes[a:]), MAX_TOKENS - tokens, side="right")
                take = min(int(room), MAX_DOCS - docs, len(batch) - a)
                if not take and docs:
                    yield out()
                    held, tokens, docs = [], 0, 0
                    continue
                take = max(1, take)
                held.append(batch.slice(a, take))
                tokens, docs, a = tokens + int(sizes[a : a + take].sum()), docs + take, a + take
        if docs:
            yield out()

    made = rows.mapInArrow(run, f"docs array<{kind}>, terms array<string>, offsets array<int>, at array<int>, tf array<int>")
    # A shard is a row of some MB. Parquet looks at the size of a row group after 100 rows by default, and readers hold a row group.
    each_row = {f"parquet.page.size.row.check.{end}": "1" for end in ("min", "max")}
    made.write.options(**{"parquet.block.size": str(ROW_GROUP), **each_row}).parquet(f"{path}/shards")
    spark = df.sparkSession
    sums = spark.read.parquet(f"{path}/shards").select(F.size("docs").alias("n"), F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d["len"]).alias("len"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), (F.sum("len") / F.sum("n")).alias("mean_length"))
    if not total.first()["documents"]:
        raise ValueError("no documents")
    total.coalesce(1).write.parquet(f"{path}/statistics")


def read_shards(spark: SparkSession, path: str) -> ShardedIndex:
    s = spark.read.parquet(f"{path}/statistics").first()
    return ShardedIndex(spark.read.parquet(f"{path}/shards"), s["documents"], s["mean_length"])


def frequencies(index: ShardedIndex, terms: DataFrame) -> DataFrame:
    """term, df (documents that hold it) of the terms that occur in any. A task's shards are added up before they move."""
    sizes = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.element_at("offsets", i + 2) - F.element_at("offsets", i + 1)).alias("df")))
    each = index.shards.select("terms", "offsets").select(F.explode(sizes).alias("t")).select("t.term", "t.df")
    return each.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def postings(index: ShardedIndex) -> DataFrame:
    """doc_id, term, tf, doc_len: the postings as rows."""
    cut = lambda c, i: F.slice(c, F.element_at("offsets", i + 1) + 1, F.element_at("offsets", i + 2) - F.element_at("offsets", i + 1))
    each = index.shards.select("docs", F.explode(F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.arrays_zip(cut("at", i).alias("at"), cut("tf", i).alias("tf")).alias("p")))).alias("t"))
    one = each.select("docs", "t.term", F.explode("t.p").alias("p")).select(F.element_at("docs", col("p.at") + 1).alias("d"), "term", col("p.tf").alias("tf"))
    return one.select(col("d.id").alias("doc_id"), "term", "tf", col("d.len").alias("doc_len"))


def weights_of(index: ShardedIndex) -> DataFrame:
    """doc_id, weight: the sum of the weights of a document's terms; documents without a word have no row. A document's postings
    are in one shard, so they are added up inside it."""
    mean = index.mean_length
    small_batches(index.shards.sparkSession)
    rows = index.shards.select(F.transform("docs", lambda d: d["id"]).alias("id"), F.transform("docs", lambda d: d["len"]).alias("len"), "at", "tf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, length, at, tf = (batch.column(c).slice(i, 1).flatten() for c in ("id", "len", "at", "tf"))
                length, at = length.to_numpy(), at.to_numpy()
                sums = np.bincount(at, posting_weights(tf.to_numpy().astype(np.float64), length[at], mean), len(ids))
                some = pa.array(length > 0)
                yield pa.RecordBatch.from_arrays([ids.filter(some), pa.array(sums).filter(some)], names=["doc_id", "weight"])

    return rows.mapInArrow(run, "doc_id long, weight double").groupBy("doc_id").agg(F.sum("weight").alias("weight"))


def posting_weights(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def search_shards(index: ShardedIndex, queries: DataFrame, k: int, where: Callable[[Column], Column] | None = None, per_pass: int = PER_PASS) -> DataFrame:
    """q, doc_id, score, rank: the best k documents of each query (q, terms) with a score above 0, ties to the least id. Repeated
    terms count once; `where` makes a condition of a document's struct."""
    spark, n, mean = index.shards.sparkSession, index.documents, index.mean_length
    asked = queries.where("q IS NOT NULL").select(col("q").cast("long").alias("q"), F.explode(F.array_distinct("terms")).alias("term"))
    idf = frequencies(index, asked).select("term", F.log(1 + (n - col("df") + 0.5) / (col("df") + 0.5)).alias("idf"))
    known = asked.join(idf, "term")
    passes = max(1, -(-known.select("q").distinct().count() // per_pass))
    keep = F.transform("docs", where) if where is not None else F.transform("docs", lambda d: F.lit(True))
    rows = index.shards.select(F.transform("docs", lambda d: d["id"]).alias("id"), F.transform("docs", lambda d: d["len"]).alias("len"), keep.alias("keep"), "terms", "offsets", "at", "tf")
    path = scratch(spark, "hits")
    for p in range(passes):
        own = known.where(F.pmod(F.xxhash64(F.lit(11), "q"), F.lit(passes)) == p).collect()
        ids = np.array(sorted({r["q"] for r in own}), dtype=np.int64)
        own.sort(key=lambda r: r["term"])
        terms = np.array([r["term"] for r in own], dtype=object)
        starts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(own) else np.zeros(0, dtype=np.int64)
        shared = spark.sparkContext.broadcast((ids, Asked(
            pa.array(terms[starts], pa.string()), np.array([own[i]["idf"] for i in starts], dtype=np.float64), np.append(starts, len(own)), np.searchsorted(ids, np.array([r["q"] for r in own], dtype=np.int64)))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            best = Best(len(ids), k)
            for batch in batches:
                for i in range(len(batch)):
                    part = lambda c: batch.column(c).slice(i, 1).flatten()  # noqa: B023, E731
                    score_shard(best, part, asked, mean)
            at, rank = np.nonzero(best.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best.ids[at, rank]), pa.array(best.scores[at, rank])], names=["q", "doc_id", "score"])

        rows.mapInArrow(run, "q long, doc_id long, score double").write.mode("append").parquet(path)
    return best_rows(spark.read.schema("q long, doc_id long, score double").parquet(path), k)


@dataclass
class Asked:
    """The terms of a pass in order, with their idf and queries: those of term i are queries[starts[i]:starts[i + 1]]."""

    terms: pa.Array
    idf: np.ndarray
    starts: np.ndarray
    queries: np.ndarray


def flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, dtype=np.int64)


def score_shard(best: Best, part: Callable[[str], pa.Array], asked: Asked, mean: float) -> None:
    """Add a shard's documents to the best k of each query.

    Of a query's terms, those of the least bounds that cannot reach its k-th score together are left for later: only documents that
    hold another term are looked at, and only those that reach the k-th score with these bounds are scored in full. So common terms
    cost nothing but in the first shards of a task. Terms are added up in their order in either case.
    """
    keep = part("keep").to_numpy(zero_copy_only=False)
    keep = np.array([x is True for x in keep]) if keep.dtype == object else keep.astype(bool)
    place = pc.index_in(part("terms"), value_set=asked.terms)
    met = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
    if not len(met) or not keep.any():
        return
    place = place.take(pa.array(met)).to_numpy()
    ids, length, offsets = part("id").to_numpy(zero_copy_only=False), part("len").to_numpy(), part("offsets").to_numpy().astype(np.int64)
    # The postings of the terms asked for, in documents that the filter keeps.
    counts = offsets[met + 1] - offsets[met]
    own = flat(offsets[met], counts)
    at, term = part("at").to_numpy()[own], np.repeat(np.arange(len(met)), counts)
    kept = keep[at]
    own, at, term = own[kept], at[kept].astype(np.int64), term[kept]
    weights = posting_weights(part("tf").to_numpy()[own].astype(np.float64), length[at], mean)
    starts = np.searchsorted(term, np.arange(len(met) + 1))
    size, some = np.diff(starts), np.diff(starts) > 0
    most = np.zeros(len(met))
    if some.any():
        most[some] = np.maximum.reduceat(weights, starts[:-1][some])
    # One entry for each term of each query, in the order of queries and then of terms.
    times = asked.starts[place + 1] - asked.starts[place]
    t = np.repeat(np.arange(len(met)), times)
    q = asked.queries[flat(asked.starts[place], times)]
    q, t = (x[some[t]] for x in (q, t))
    order = np.argsort(q, kind="stable")
    q, t = q[order], t[order]
    if not len(q):
        return
    idf = asked.idf[place[t]]
    bound = idf * most[t]
    first = np.concatenate(([True], q[1:] != q[:-1]))
    rising = np.lexsort((bound, q))
    sums = np.cumsum(bound[rising])
    upto = sums - np.repeat((sums - bound[rising])[first], np.diff(np.append(np.flatnonzero(first), len(q))))
    slack = 10.0**-DIGITS * 2
    later = np.empty(len(q), dtype=bool)
    later[rising] = upto + slack < best.scores[q[rising], -1]
    rows, row = q[first], np.cumsum(first) - 1
    rest = np.bincount(row, weights=bound * later, minlength=len(rows))
    postponed = np.bincount(row, weights=later, minlength=len(rows)) > 0
    begin = np.append(np.flatnonzero(first), len(q))
    now = np.flatnonzero(~later)
    cost = np.bincount(row[now], weights=size[t[now]], minlength=len(rows))
    open_ = np.flatnonzero(cost > 0)
    cuts = np.searchsorted(np.cumsum(np.maximum(cost[open_], len(ids))), np.arange(CELLS, CELLS + np.maximum(cost[open_], len(ids)).sum(), CELLS), side="left") + 1
    cells = term * len(ids) + at
    table = None
    if len(met) * len(ids) <= 4 * CELLS:
        table = np.zeros(len(met) * len(ids))
        table[cells] = weights

    def weight(key: np.ndarray) -> np.ndarray:
        if table is not None:
            return table[key]
        found = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
        return np.where(cells[found] == key, weights[found], 0.0)

    for a, b in zip(np.concatenate(([0], cuts)), cuts):
        block = open_[a:b]
        if not len(block):
            continue
        e = now[np.searchsorted(row[now], block[0]) : np.searchsorted(row[now], block[-1], side="right")]
        local, n = np.searchsorted(block, row[e]), size[t[e]]
        p = flat(starts[:-1][t[e]], n)
        scores = np.bincount(np.repeat(local * len(ids), n) + at[p], weights=np.repeat(idf[e], n) * weights[p], minlength=len(block) * len(ids)).reshape(len(block), len(ids))
        least = np.maximum(best.scores[rows[block], -1] - rest[block] - slack, 1e-300)
        i, doc = np.nonzero(scores >= least[:, None])
        full = scores[i, doc]
        wide = np.flatnonzero(postponed[block[i]])
        for c in range(0, len(wide), CELLS // 16):
            few = wide[c : c + CELLS // 16]
            r = block[i[few]]
            m = begin[r + 1] - begin[r]
            x, pair = flat(begin[r], m), np.repeat(np.arange(len(r)), m)
            full[few] = np.bincount(pair, weights=idf[x] * weight(t[x] * len(ids) + doc[few][pair]), minlength=len(r))
        full = np.round(full, DIGITS)
        good = full > 0
        best.add_some(rows[block[i[good]]], full[good], ids[doc[good]])
