"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialize, release, spread  # noqa: F401

#: Code points removed from the ends of lines and from whole texts: space, tab, LF, VT, FF, CR.
BLANKS = r"[\x20\x09-\x0D]"
#: Ids of rows that have none sort behind all others.
LAST_ID = (1 << 63) - 1
#: Bits of a Bloom filter: 16 for each id, up to 16 MB in all; beyond, more rows pass it than need be.
BLOOM_BITS, MAX_BLOOM_BITS, BLOOM_HASHES = 16, 1 << 27, 5
CHUNK = 1 << 15
#: A Bloom filter is filled by one task for so many ids, by MAX_FILLS tasks at most, so no more parts of it than that are moved.
FILL_IDS, MAX_FILLS = 1 << 18, 512


_CACHES: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = []


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Give the worker's memory for caches to one operator: workers live on between stages, so the others' caches are dropped."""
    _CACHES[owner] = clear
    if _OWNER != [owner]:
        for name, drop in _CACHES.items():
            if name != owner:
                drop()
        _OWNER[:] = [owner]
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: freed memory goes back later
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for ids whose crc32 (of the id as text) has remainder 2 modulo 4; no label of these is learnt from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def uniform(column: str, seed: int) -> Column:
    """A repeatable number in [0, 1) for each id, for bounded samples."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 30)) / float(1 << 30)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def byte_parts(batch: pa.RecordBatch, column: str, size: int, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes of a text column and of at most `rows` rows; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(batch):
        before = int(ends[a - 1]) if a else 0
        b = min(max(a + 1, int(np.searchsorted(ends, before + size, side="right"))), a + rows)
        yield batch.slice(a, b - a)
        a = b


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def fresh(taken: list[str], *names: str) -> list[str]:
    """Helper column names that clash with none of the table's (column names do not tell case apart)."""
    known = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def inline(spark: SparkSession, rows: list[tuple], names: list[str], types: list[str]) -> DataFrame:
    """A small fixed table as literals, so that no Python worker takes part."""
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """[hashes, ids] places of ids in a Bloom filter."""
    seeds = splitmix(np.arange(1, BLOOM_HASHES + 1, dtype=np.uint64))
    return np.stack([splitmix(ids.view(np.uint64) ^ s) & np.uint64(bits - 1) for s in seeds]).astype(np.int64)


def bloom_of(rows: DataFrame, column: str, bits_each: int = BLOOM_BITS, most: int = MAX_BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of a column of ids: at most `most` bits. A bounded number of tasks fill filters of their own; these are
    dealt out by chunk and merged one by one as they stream in, so a task holds its own chunks and no more."""
    n = rows.count()
    bits = 1 << max(12, min(most.bit_length() - 1, (n * bits_each).bit_length()))
    chunk = min(bits, CHUNK)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, dtype=bool)
        for batch in batches:
            own[bloom_places(batch.column(0).to_numpy(), bits).ravel()] = True
        at = [k for k in range(bits // chunk) if own[k * chunk : (k + 1) * chunk].any()]
        for a in range(0, len(at), 256):
            some = at[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.packbits(own[k * chunk : (k + 1) * chunk]).tobytes() for k in some], pa.binary())], names=["at", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("at").to_pylist(), batch.column("part")):
                part = np.frombuffer(x.as_buffer(), dtype=np.uint8)
                if k in held:
                    held[k] |= part
                else:
                    held[k] = part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["at", "part"])

    ids = rows.select(column).repartition(max(1, min(MAX_FILLS, n // FILL_IDS)))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in ids.mapInArrow(fill, "at int, part binary").repartition("at").mapInArrow(merge, "at int, part binary").collect():
        out[r["at"] * chunk // 8 : (r["at"] + 1) * chunk // 8] = np.frombuffer(bytes(r["part"]), dtype=np.uint8)
    return out


def may_hold(shared, ids: np.ndarray) -> np.ndarray:
    filter_ = shared.value
    at = bloom_places(ids, 8 * len(filter_))
    return ((filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def bloom_filter(rows: DataFrame, column: str, **more) -> Callable[[Column], Column]:
    """A predicate on ids that is true for all ids of the column, and for few others. It spares rows a shuffle to a join with
    `rows`; it takes ids only, so the rows' other columns do not pass through Python."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom_of(rows, column, **more))

    @F.pandas_udf("boolean")
    def held(ids: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared, ids.to_numpy(dtype=np.int64)))

    return held
