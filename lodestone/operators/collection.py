"""A collection of vectors with payload, searched by cells: approximate candidates from byte codes, exact scores for the best.

Layout: one row a vector (id, payload columns, cell, scale, code, vector), dealt by ranges of (cell, id) and sorted, so that a
search reads the row groups of the cells it probes, filters on payload reach the scan, and the wide `vector` column is read
for candidates only. Cells are those of k-means by cosine over a bounded sample; every row is indexed. A code is the unit
vector in signed bytes under a scale of its own. Vectors that are null, zero or hold null or non-finite components are kept
with their payload in cell -1, where no search looks.

How many cells a search probes is measured when the collection is written: for a bounded sample of rows, the exact nearest
neighbours are looked up, and enough cells are probed that TARGET of these lie in them.

A search sends each query to its nearest cells. Rows of a cell are packed into blocks inside the scanning tasks, queries of a
cell into blocks as well, and blocks meet in an equi-join by cell: a product of two small matrices for each pair of blocks, the
best candidates of each query out. So neither a cell nor its queries are ever one group, and hot cells are split by adaptive
execution. Queries that find fewer candidates than asked for (few rows pass the filter) probe four times as many cells, up to
all of them, so a short answer means that no more rows exist.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.values import cosine
from lodestone.operators.search import DIGITS, best_rows, dense_batch
from lodestone.session import exists, materialize, release
from lodestone.sources import io

#: Cells: about the root of the number of rows, at most MAX_CELLS (their centres are sent to all tasks: 64 MB at 1024 dimensions).
MAX_CELLS = 1 << 14
#: Rows of the k-means sample for each cell.
SAMPLE_PER_CELL = 64
#: Rows whose neighbours are looked up to choose the number of probes, neighbours of each, and the share to lie in probed cells.
PROBE_SAMPLE, PROBE_K, TARGET = 256, 10, 0.97
#: Rows and queries of a block.
ROWS, QUERIES = 512, 256
#: Numbers of a block of products with all centres, and rows of a batch of queries and cells.
PRODUCTS, PROBED = 1 << 21, 1 << 13
#: Up to so many probed cells are a predicate of the scan.
FEW_CELLS = 1000
NO_CELL = -1


@dataclass
class Collection:
    path: str
    dims: int
    centres: np.ndarray
    rows: DataFrame
    probes: int


def unit_vectors(vectors: Sequence, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """[rows, dims] unit vectors (zeros where there is none) and which rows have one."""
    out = np.zeros((len(vectors), dims), dtype=np.float32)
    ok = np.zeros(len(vectors), dtype=bool)
    for i, x in enumerate(vectors):
        if x is None or len(x) != dims:
            continue
        x = np.asarray(x, dtype=np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            n = np.sqrt((x * x).sum())
        if np.isfinite(n) and n > 0:
            out[i], ok[i] = x / n, True
    return out, ok


def train_centres(df: DataFrame, ident: str, vector: str, cells: int, n: int, seed: int) -> np.ndarray:
    """Centres of k-means by cosine, over at most about SAMPLE_PER_CELL * cells rows, chosen by a hash of the id."""
    share = min(1.0, SAMPLE_PER_CELL * cells / max(1, n))
    x = F.transform(vector, lambda v: v.cast("double"))
    norm = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    rows = df.where((F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1 << 30)) < int(share * (1 << 30))) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v)))
    rows = rows.select(x.alias("x"), norm.alias("norm")).where((F.col("norm") > 0) & (F.col("norm") < float("inf"))).select(array_to_vector("x").alias("v"))
    rows = materialize(rows.select("v"), "sample")
    if rows.isEmpty():
        release(rows)
        return np.zeros((0, 0), dtype=np.float32)
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10, initMode="random", distanceMeasure="cosine", featuresCol="v").fit(rows)
    release(rows)
    centres = np.array(model.clusterCenters(), dtype=np.float64)
    return (centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-300)[:, None]).astype(np.float32)


def write_collection(df: DataFrame, ident: str, vector: str, path: str, dims: int, payload: Sequence[str] = (), cells: int | None = None, seed: int = 42) -> bool:
    """Write a collection; False if there is one at the path already. A vector of another length, a repeated id, and a collection
    of other dimensions at the path are errors."""
    spark = df.sparkSession
    if exists(spark, f"{path}/config"):
        have = spark.read.parquet(f"{path}/config").first()["dims"]
        if have != dims:
            raise ValueError(f"the collection at {path} has {have} dimensions, not {dims}")
        return False
    io.check_dimension(df, vector, dims)
    io.check_unique(df.where(F.col(ident).isNotNull()), ident)
    n = df.count()
    cells = cells or int(min(MAX_CELLS, max(1, round(n**0.5))))
    centres = train_centres(df, ident, vector, cells, n, seed)
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("cell int, scale float, code binary")
    def coded(vectors: pd.Series) -> pd.DataFrame:
        unit, ok = unit_vectors(vectors.tolist(), dims)
        cell = np.full(len(unit), NO_CELL, dtype=np.int32)
        at = np.flatnonzero(ok)
        step = max(1, PRODUCTS // max(1, len(shared.value)))
        for a in range(0, len(at) if len(shared.value) else 0, step):
            cell[at[a : a + step]] = (unit[at[a : a + step]] @ shared.value.T).argmax(axis=1)
        scale = np.abs(unit).max(axis=1, initial=0.0) / 127
        code = np.rint(unit / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
        return pd.DataFrame({"cell": cell, "scale": scale.astype(np.float32), "code": [c.tobytes() for c in code]})

    rows = df.select(F.col(ident).cast("long").alias("id"), *payload, F.col(vector).alias("vector"), coded(vector).alias("c"))
    rows = rows.select("id", *payload, "c.cell", "c.scale", "c.code", "vector")
    rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    probes = measured_probes(spark.read.parquet(f"{path}/rows"), centres, seed, n)
    # The configuration comes last: a collection without it is not there yet.
    spark.range(1).select(F.lit(dims).alias("dims"), F.lit(n).cast("long").alias("points"), F.lit(probes).alias("probes")).coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    return True


def measured_probes(rows: DataFrame, centres: np.ndarray, seed: int, n: int) -> int:
    """Cells to probe so that TARGET of the exact neighbours of a sample of rows lie in them."""
    if len(centres) < 2:
        return 1
    share = min(1 << 30, -(-(PROBE_SAMPLE << 30) // max(1, n)))
    sample = rows.where("cell >= 0").where(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1 << 30)) < share).select("id", "vector").limit(2 * PROBE_SAMPLE)
    sample = materialize(sample, "probes")
    near = dense_batch(rows.where("cell >= 0"), sample, "id", "vector", PROBE_K, others=True).select("q", F.col("doc_id").alias("id"))
    met = near.join(rows.select("id", "cell"), "id").join(sample.select(F.col("id").alias("q"), "vector"), "q").select("cell", "vector").collect()
    release(sample)
    if not met:
        return 1
    unit, _ = unit_vectors([r["vector"] for r in met], centres.shape[1])
    order = np.argsort(-(unit @ centres.T), axis=1, kind="stable")
    rank = (order == np.array([r["cell"] for r in met])[:, None]).argmax(axis=1)
    return int(np.quantile(rank, TARGET, method="higher")) + 1


def open_collection(spark: SparkSession, path: str) -> Collection:
    config = spark.read.parquet(f"{path}/config").first()
    dims = config["dims"]
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return Collection(path, dims, np.array([r["centre"] for r in found], dtype=np.float32).reshape(len(found), dims), spark.read.parquet(f"{path}/rows"), config["probes"])


def info(c: Collection) -> DataFrame:
    """points, indexed (those with a cell) and cells in use, from the cell column alone."""
    return c.rows.agg(F.count("*").alias("points"), F.count_if(F.col("cell") >= 0).alias("indexed"), F.countDistinct(F.when(F.col("cell") >= 0, F.col("cell"))).alias("cells"))


def count_range(c: Collection, low: int, high: int) -> int:
    """Points with an id of low to high, both included."""
    return c.rows.where(F.col("id").between(low, high)).count()


def queries_at_once(cells: int, probes: int) -> int:
    """Queries whose products with all centres, and whose rows for all probed cells, are held at once."""
    return max(1, min(QUERIES, PRODUCTS // max(1, cells), PROBED // max(1, probes)))


def probes_of(c: Collection, queries: DataFrame, probes: int) -> DataFrame:
    """q, x (unit vector), cell: each query once for each of its nearest cells."""
    shared, dims, n = c.rows.sparkSession.sparkContext.broadcast(c.centres), c.dims, min(probes, len(c.centres))
    step = queries_at_once(len(c.centres), n)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                unit, ok = unit_vectors(part.column("x").to_pylist(), dims)
                unit, q = unit[ok], np.repeat(part.column("q").to_numpy()[ok], n)
                cells = np.argsort(-(unit @ shared.value.T), axis=1, kind="stable")[:, :n] if n else np.zeros((len(unit), 0))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array([x.tobytes() for x in np.repeat(unit, n, axis=0)], pa.binary()), pa.array(cells.ravel().astype(np.int32))], names=["q", "x", "cell"])

    return queries.mapInArrow(near, "q long, x binary, cell int")


def blocks(rows: DataFrame, columns: dict[str, str], size: int, prefix: str) -> DataFrame:
    """Rows of the same cell that follow each other in a task, packed: cell, and an array of each column."""
    kinds = {"long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary()}
    types = [("cell", pa.int32()), *[(prefix + k, pa.list_(kinds[t])) for k, t in columns.items()]]
    schema = pa.schema(types)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell, n = None, 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *[pa.array([t.column(k).to_pylist()], pa.list_(kinds[v])) for k, v in columns.items()]], schema=schema)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else [0]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if held and (cells[a] != cell or n == size):
                        yield out()
                        held, n = [], 0
                    take = min(b - a, size - n)
                    cell = int(cells[a])
                    held.append(batch.slice(a, take))
                    n, a = n + take, a + take
        if held:
            yield out()

    return rows.select("cell", *columns).mapInArrow(pack, ", ".join(["cell int", *[f"{prefix}{k} array<{t}>" for k, t in columns.items()]]))


def candidates(c: Collection, asked: DataFrame, k: int, where: Column | None) -> DataFrame:
    """q, doc_id, cell, score, rank: the best k rows of each query in its cells, by codes."""
    rows = c.rows if where is None else c.rows.where(where)
    few = [r["cell"] for r in asked.select("cell").distinct().limit(FEW_CELLS + 1).collect()]
    rows = rows.where(F.col("cell").isin(few)) if len(few) <= FEW_CELLS else rows.where("cell >= 0")
    packed = blocks(rows, {"id": "long", "scale": "float", "code": "binary"}, ROWS, "r_")
    # The queries of a hot cell come from several tasks, each of which packs its own.
    dealt = asked.repartition("cell", F.pmod(F.xxhash64("q"), F.lit(16))).sortWithinPartitions("cell", "q")
    wanted = blocks(dealt, {"q": "long", "x": "binary"}, QUERIES, "q_")
    dims = c.dims

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.slice(0).to_pylist():
                codes = np.frombuffer(b"".join(pair["r_code"]), dtype=np.int8).reshape(-1, dims).astype(np.float32)
                x = np.frombuffer(b"".join(pair["q_x"]), dtype=np.float32).reshape(-1, dims)
                s = (x @ codes.T) * np.array(pair["r_scale"], dtype=np.float32)[None, :]
                m = min(k, s.shape[1])
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                ids = np.array(pair["r_id"], dtype=np.int64)
                cell = np.full(top.size, pair["cell"], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(pair["q_q"], dtype=np.int64), m)), pa.array(ids[top].ravel()), pa.array(cell), pa.array(np.take_along_axis(s, top, axis=1).ravel().astype(np.float64))], names=["q", "doc_id", "cell", "score"])

    met = packed.join(wanted, "cell").select("cell", "r_id", "r_scale", "r_code", "q_q", "q_x")
    return best_rows(met.mapInArrow(score, "q long, doc_id long, cell int, score double"), k)


def search(c: Collection, queries: DataFrame, ident: str, vector: str, k: int, where: Column | None = None, probes: int | None = None, oversample: int = 2) -> DataFrame:
    """q, doc_id, score, rank: the best k of the candidates of each query by exact cosine, to nine digits, ties to the least id.
    `oversample` times k candidates are scored exactly. `where` is a predicate on payload columns.
    `probes` is the collection's own number by default."""
    own = queries.select(F.col(ident).cast("long").alias("q"), F.col(vector).alias("x")).where("q IS NOT NULL AND x IS NOT NULL")
    probes = probes or c.probes
    depth, found, open_ = max(1, oversample * k), None, own
    while True:
        some = materialize(candidates(c, probes_of(c, open_, probes), depth, where).select("q", "doc_id", "cell"), "candidates")
        if probes >= len(c.centres):
            found = some if found is None else found.unionByName(some)
            break
        full = some.groupBy("q").count().where(F.col("count") >= depth).select("q")
        done = some.join(full, "q", "left_semi")
        found = done if found is None else found.unionByName(done)
        open_ = open_.join(full, "q", "left_anti")
        if open_.isEmpty():
            break
        probes *= 4
    exact = found.join(c.rows.select(F.col("id").alias("doc_id"), "cell", "vector"), ["cell", "doc_id"]).join(own, "q")
    scored = exact.select("q", "doc_id", F.round(cosine(F.col("vector"), F.col("x")), DIGITS).alias("score"))
    return best_rows(scored, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: expected (rows of the exact answer), met (of these, those that were found) and recall. Hits as good as the exact
    answer's last one count as met: which of equal rows is listed is a matter of ids."""
    worst = exact.groupBy("q").agg(F.min("score").alias("worst"), F.count("*").alias("expected"))
    met = found.join(worst, "q").where("score >= worst").groupBy("q").agg(F.count("*").alias("met"))
    total = worst.join(met, "q", "left").agg(F.sum("expected").alias("expected"), F.sum(F.least(F.coalesce("met", F.lit(0)), "expected")).alias("met"))
    return total.withColumn("recall", F.try_divide("met", "expected"))
