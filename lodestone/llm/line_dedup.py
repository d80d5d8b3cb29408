"""Line deduplication over sharded minimal perfect hashes.

A line's key is the line without blanks at both ends and with A-Z lower-cased. Keys of `min_points` code points that
occur in two documents lose all their lines except in the smallest doc_id that holds them.

1. Each document gives the 128-bit hashes of its distinct long keys (no line text is shuffled). Counts and smallest ids
   are aggregated by hash, in the map tasks first.
2. All distinct hashes are dealt into shards by their remainder. Each shard gets a minimal perfect hash function (levels
   of bit arrays: a key that is alone in its place of a level is named by that bit's rank, the others go on to the next
   level) and two arrays in slot order: 32-bit fingerprints and document counts. The smallest ids of the keys that more
   than one document holds follow in slot order.
3. Documents probe the arrays, which alone decide: a line goes if its slot's fingerprint fits, its count is over one and
   another document is the smallest. Probes are (hash, doc_id) pairs routed to the shard's task, which holds one shard at a
   time and reads probes as a stream. A shard is repeated for as many probe lanes as its counts call for, so a line in a
   third of all documents is spread over lanes. All probes are of hashes in the arrays, so no fingerprint errs.
4. The answers are one row per document that loses lines. A Bloom filter of these documents, of bounded size, is sent to
   the scan: documents that it lacks keep all lines where they are, and only the others are shuffled to their answers.

Nothing that grows is collected to the driver: only the Bloom filter and the lane counts of a checked number of shards.

Defined cases: null and empty texts are one empty line; null ids count as one document behind all others; rows that repeat
a doc_id are one document (a count is over one only if two ids hold the line) and each keep their row; lines that only
repeat within one document stay; an empty table gives no rows; further columns, of any name, are kept by the filter and
ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, bloom_filter, claim, columns_of, fresh, materialize, release, slices, spread, texts_of

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Places of a level of the hash function for each key that comes to it.
ROOM = 2
#: The lane counts (12 bytes a shard) are broadcast up to this many shards.
MAX_BROADCAST_SHARDS = 1_000_000


def line_key(line: str) -> str:
    line = line.strip(STRIP)
    return line.lower() if line.isascii() else line.translate(LOWER)


def key_hash(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def mix(h: np.ndarray, seed) -> np.ndarray:
    """splitmix64 of h and a seed."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, dtype=np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mphf(keys: np.ndarray) -> list[np.ndarray]:
    """The levels' bits of a minimal perfect hash function over distinct 64-bit keys."""
    levels = []
    while len(keys):
        place = (mix(keys, len(levels)) % np.uint64(ROOM * len(keys) + 1)).astype(np.int64)
        alone = np.bincount(place, minlength=ROOM * len(keys) + 1) == 1
        levels.append(alone)
        keys = keys[~alone[place]]
    return levels


def mphf_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slots 0 to n - 1 of the function's keys; other keys get any slot, or -1."""
    out = np.full(len(keys), -1, dtype=np.int64)
    open_, base = np.arange(len(keys)), 0
    for k, alone in enumerate(levels):
        place = (mix(keys[open_], k) % np.uint64(len(alone))).astype(np.int64)
        rank = np.cumsum(alone)
        here = alone[place]
        out[open_[here]] = base + rank[place[here]] - 1
        open_, base = open_[~here], base + int(rank[-1])
    return out


def build_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> dict[str, bytes]:
    """Arrays of one shard. h1 finds the slot and h2 gives the fingerprint; keys that share h1 (never seen) go to a spare list."""
    _, at = np.unique(h1, return_index=True)
    spare = np.setdiff1d(np.arange(len(h1)), at)
    levels = build_mphf(h1[at])
    order = np.empty(len(at), dtype=np.int64)
    order[mphf_slots(levels, h1[at])] = at
    n, repeated = counts[order], order[counts[order] > 1]
    sizes = np.array([len(x) for x in levels], dtype=np.int64)
    return {
        "levels": b"".join([np.int64(len(levels)).tobytes(), sizes.tobytes(), *[np.packbits(x).tobytes() for x in levels]]),
        "prints": (h2[order] & 0xFFFFFFFF).astype(np.uint32).tobytes(),
        "counts": n.astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.uint64).tobytes(),
        "firsts": firsts[repeated].astype(np.int64).tobytes(),
        "spare": b"".join(x[spare].astype(np.int64).tobytes() for x in (h1, h2, counts, firsts)),
    }


class Shard:
    def __init__(self, levels: bytes, prints: bytes, counts: bytes, firsts: bytes, spare: bytes):
        n = int(np.frombuffer(levels[:8], dtype=np.int64)[0])
        sizes, at = np.frombuffer(levels[8 : 8 + 8 * n], dtype=np.int64), 8 + 8 * n
        self.levels = []
        for size in sizes.tolist():
            self.levels.append(np.unpackbits(np.frombuffer(levels[at : at + -(-size // 8)], dtype=np.uint8), count=size).astype(bool))
            at += -(-size // 8)
        self.prints = np.frombuffer(prints, dtype=np.uint32)
        self.counts = np.frombuffer(counts, dtype=np.uint32 if len(counts) == len(prints) else np.uint64).astype(np.int64)
        self.firsts = np.append(np.frombuffer(firsts, dtype=np.int64), -1)
        self.rank = np.cumsum(self.counts > 1)
        self.spare = np.frombuffer(spare, dtype=np.int64).reshape(4, -1)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, smallest id) of the probed hashes; the count is 0 for unknown ones, and the id is -1 unless it is over one."""
        slot = mphf_slots(self.levels, h1.view(np.uint64))
        known = (slot >= 0) & (self.prints[slot] == (h2 & 0xFFFFFFFF)) if len(self.prints) else np.zeros(len(h1), dtype=bool)
        slot = np.where(known, slot, 0)
        count = np.where(known, self.counts[slot] if len(self.counts) else 0, 0)
        first = self.firsts[np.where(count > 1, self.rank[slot] - 1 if len(self.rank) else 0, -1)]
        for a, b, n, f in self.spare.T:
            same = (h1 == a) & (h2 == b)
            count[same], first[same] = n, f if n > 1 else -1
        return count, first


def keys_of(min_points: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none", lambda: None)
        for batch in slices(batches):
            found, docs = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), texts_of(batch)):
                keys = {k for line in set(text.split("\n")) if len(line) >= min_points and len(k := line_key(line)) >= min_points}
                found += map(key_hash, keys)
                docs += [doc] * len(keys)
            h = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(docs, pa.int64())], schema=schema)

    return run


BLOBS = ("levels", "prints", "counts", "firsts", "spare")


def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, kind): a shard's arrays come before its probes, so one shard is held at a time."""
    schema = pa.schema([("doc", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
    shard, number = None, None
    for batch in batches:
        ids = batch.column("shard").to_numpy()
        blobs = np.flatnonzero(batch.column("kind").to_numpy() == 0)
        bounds = sorted({0, len(ids), *blobs.tolist(), *(blobs + 1).tolist(), *(np.flatnonzero(np.diff(ids)) + 1).tolist()})
        isblob = set(blobs.tolist())
        for a, b in zip(bounds, bounds[1:]):
            if a in isblob:
                row = batch.slice(a, 1).to_pylist()[0]
                shard, number = Shard(*[row[k] for k in BLOBS]), row["shard"]
            elif ids[a] == number:
                part = batch.slice(a, b - a)
                doc, h1, h2 = (part.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "h1", "h2"))
                count, first = shard.probe(h1, h2)
                go = (count > 1) & (first != doc)
                if go.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[go]) for x in (doc, h1, h2)], schema=schema)


def repeated_lines(docs: DataFrame, doc_id: str, text: str, min_points: int, keys_per_shard: int, probes_per_lane: int, shards: int | None) -> DataFrame:
    """doc, drop (concatenated 16-byte hashes): the keys whose lines each document loses."""
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"), F.col(text).alias("text"))
    keys = materialize(spread(source).mapInArrow(keys_of(min_points), "h1 long, h2 long, doc long"), "line-keys")
    several = F.min("doc") != F.max("doc")
    counted = keys.groupBy("h1", "h2").agg(F.when(several, F.count("*")).otherwise(1).alias("n"), F.min("doc").alias("first"), F.count("*").alias("probes"))
    shards = shards or max(8, -(-keys.count() // keys_per_shard))
    shard_of = F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")

    def build(t: pa.Table) -> pa.Table:
        h1, h2, n, first = (t.column(k).to_numpy() for k in ("h1", "h2", "n", "first"))
        row = build_shard(h1.view(np.uint64), h2, n, first)
        probes = int(t.column("probes").to_numpy().sum())
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "probes": pa.array([probes], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in row.items()}})

    blob = ", ".join(f"{k} binary" for k in BLOBS)
    built = materialize(counted.select(shard_of, "*").groupBy("shard").applyInArrow(build, f"shard int, probes long, {blob}"), "line-shards")
    lanes = built.select("shard", F.greatest(F.lit(1), F.ceil(F.col("probes") / probes_per_lane)).cast("int").alias("lanes"))
    arrays = built.join(lanes, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(0).alias("kind"),
        *[F.lit(None).cast("long").alias(c) for c in ("doc", "h1", "h2")], *BLOBS,
    )
    near = F.broadcast if shards <= MAX_BROADCAST_SHARDS else (lambda df: df)
    probes = keys.select(shard_of, "*").join(near(lanes), "shard").select(
        "shard", F.pmod(F.xxhash64("doc"), F.col("lanes")).cast("int").alias("lane"), F.lit(1).alias("kind"), "doc", "h1", "h2",
        *[F.lit(None).cast("binary").alias(c) for c in BLOBS],
    )
    routed = arrays.unionByName(probes).repartition("shard", "lane").sortWithinPartitions("shard", "lane", "kind")
    hits = routed.mapInArrow(probing, "doc long, h1 long, h2 long")
    pair = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("h1", "h2")])
    drops = materialize(hits.groupBy("doc").agg(F.collect_set(pair).alias("drop")), "line-drops")
    release(keys, built)
    return drops


def big_endian(h: bytes) -> bytes:
    """The key's hash as Spark's hex() of two longs writes it."""
    a, b = np.frombuffer(h, dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def kept_lines(text: str, drop: set[bytes], min_points: int) -> tuple[list[str], int]:
    """Lines that stay, and the number of lines before."""
    lines = text.split("\n")
    if not drop:
        return lines, len(lines)
    gone = {line for line in set(lines) if len(line) >= min_points and len(k := line_key(line)) >= min_points and big_endian(key_hash(k)) in drop}
    return [line for line in lines if line not in gone], len(lines)


def joined(docs: DataFrame, doc_id: str, text: str, min_points: int, keys_per_shard: int, probes_per_lane: int, shards: int | None) -> tuple[DataFrame, DataFrame, str]:
    """Rows that stay as they are, and rows (with a further column: the drop list of their document, or null) that may lose lines."""
    drops = repeated_lines(docs, doc_id, text, min_points, keys_per_shard, probes_per_lane, shards)
    losing = bloom_filter(drops, "doc")
    doc, drop = fresh(docs.columns, "doc", "drop")
    marked = docs.withColumn(doc, F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)))
    own = columns_of(docs)
    stay = marked.where(~losing(F.col(doc))).select(*own)
    moved = marked.where(losing(F.col(doc))).join(drops.toDF(doc, drop).hint("merge"), doc, "left").select(*own, drop)
    return stay, moved, drop


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_points: int = 10, keys_per_shard: int = 1 << 17, probes_per_lane: int = 1 << 20, shards: int | None = None) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept_sha256 for every row."""
    stay, moved, drop = joined(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", min_points, keys_per_shard, probes_per_lane, shards)
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, sha = [], [], []
            for text_, gone_ in zip(texts_of(batch), batch.column(drop).to_pylist()):
                lines, total = kept_lines(text_, set(gone_ or ()), min_points)
                n.append(total)
                gone.append(total - len(lines))
                sha.append(hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], schema=schema)

    return stay.withColumn(drop, F.lit(None).cast("array<binary>")).unionByName(moved).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: str = "n_chars", min_points: int = 10, keys_per_shard: int = 1 << 17, probes_per_lane: int = 1 << 20, shards: int | None = None) -> DataFrame:
    """The documents with their columns; texts (and their length in `count`, where there is such a column) lose repeated lines."""
    stay, moved, drop = joined(docs, doc_id, text, min_points, keys_per_shard, probes_per_lane, shards)

    @F.pandas_udf("string")
    def keep(texts: pd.Series, drops: pd.Series) -> pd.Series:
        return pd.Series([t if d is None else "\n".join(kept_lines(t or "", {bytes(x) for x in d}, min_points)[0]) for t, d in zip(texts, drops)], dtype=object)

    kept = fresh(moved.columns, "kept")[0]
    shorter = moved.withColumn(kept, keep(F.col(text), F.col(drop)))
    cols = {text: F.col(kept)}
    if count in docs.columns:
        lost = F.col(drop).isNotNull()
        cols[count] = F.when(lost, F.length(F.col(kept)).cast(docs.schema[count].dataType)).otherwise(F.col(count))
    return stay.unionByName(shorter.select(*[cols[n].alias(n) if n in cols else c for n, c in zip(docs.columns, columns_of(docs))]))
