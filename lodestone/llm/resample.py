"""Importance resampling towards a target distribution, from a persisted count matrix.

Features are runs of one to `order` words; each falls into one of `buckets` by the crc32 of its bytes. The sparse matrix of
documents by buckets is written once, as compressed sparse row blocks of up to ROWS documents or about PART bytes of text. Column sums of the
source's and the target's matrix give two distributions and so a gain for each bucket; a product of each block with the gains
gives the weights, without reading a text again. Adding Gumbel noise from a hash of the id to the weights and keeping the
highest is sampling without replacement in proportion to exp(weight / 1000).

crc32 is linear, so the crc of a run of words comes from those of its words: crc(a + b) is the crc of a, carried over len(b)
bytes by a linear map, xor the crc of b. Words are looked up once in each part; runs cost a few table reads in numpy.

Defined cases: a null text has no word; a document without words has weight 0; with equal distributions all gains are those
of the smoothed ratio, about 0; a null id is drawn as an empty id and comes last among equals; repeated rows are drawn one by
one, in any order among themselves; an empty table gives no rows, an empty target or source has counts of 0; further columns
are ignored; very long texts are counted in parts of about PART bytes, so memory does not grow with them (but for a single
word, which stays whole).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, materialize, release, spread, texts_of

BUCKETS, ORDER, SEED, PERCENT, LEAST_WORDS = 10_000, 3, 42, 5, 20
#: Words: runs of bytes that are digits, small letters or beyond ASCII, after A-Z are lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ROWS, PART = 128, 1 << 20
#: Words kept in a worker's table, maps kept for lengths of words.
MAX_WORDS, MAX_MAPS = 200_000, 4096
#: Rows of the totals table (16 bytes each) that may be broadcast: one per task of the ranking.
MAX_PARTITIONS = 4_000_000

ZERO_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)


def zero_byte(crc: np.ndarray) -> np.ndarray:
    """The linear part of appending one byte."""
    return ZERO_STEP[crc & 255] ^ (crc >> np.uint32(8))


def power(length: int) -> np.ndarray:
    """Images of the 32 bits under `length` appended bytes, by repeated squaring."""
    result, square = 1 << np.arange(32, dtype=np.uint32), zero_byte(1 << np.arange(32, dtype=np.uint32))
    while length:
        if length & 1:
            result = through(square, result)
        square, length = through(square, square), length >> 1
    return result


def through(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1) == 1, images[bit], np.uint32(0))
    return out


class Words:
    """A worker's table of words: crc32 of each, crc32 behind a space, and the map that carries a crc over space and word."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.crc, self.spaced, self.map_of = (np.zeros(1024, dtype=t) for t in (np.uint32, np.uint32, np.int64))
        self.maps: dict[int, int] = {}
        self.tables = np.zeros((0, 4, 256), dtype=np.uint32)

    def _map(self, length: int) -> int:
        if length not in self.maps:
            images, bytes_ = power(length), np.arange(256, dtype=np.uint32)
            table = np.stack([through(images, bytes_ << np.uint32(8 * k)) for k in range(4)])
            self.maps[length] = len(self.tables)
            self.tables = np.concatenate((self.tables, table[None]))
        return self.maps[length]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; valid until the next part is begun."""
        try:
            return np.array([self.number[w] for w in words], dtype=np.int64)
        except KeyError:
            for w in set(words).difference(self.number):
                i = self.number[w] = len(self.number)
                if i == len(self.crc):
                    self.crc, self.spaced, self.map_of = (np.concatenate((x, np.zeros_like(x))) for x in (self.crc, self.spaced, self.map_of))
                self.crc[i], self.spaced[i], self.map_of[i] = zlib.crc32(w), zlib.crc32(b" " + w), self._map(len(w) + 1)
            return np.array([self.number[w] for w in words], dtype=np.int64)

    def make_room(self) -> None:
        """Between parts: numbers given before are forgotten once the tables are full."""
        if len(self.number) > MAX_WORDS or len(self.maps) > MAX_MAPS:
            self.clear()

    def runs(self, numbers: np.ndarray, owner: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For one to `order` words: crc32 of each run inside one owner, and its owner."""
        crc, out = self.crc[numbers], [(self.crc[numbers], owner)]
        for n in range(1, order):
            if len(numbers) <= n:
                break
            last = numbers[n:]
            t, c = self.tables.reshape(-1), crc[:-1]
            base = self.map_of[last] * 1024
            crc = self.spaced[last] ^ t[base + (c & 255)] ^ t[base + 256 + ((c >> 8) & 255)] ^ t[base + 512 + ((c >> 16) & 255)] ^ t[base + 768 + (c >> 24)]
            inside = owner[n:] == owner[:-n]
            out.append((crc[inside], owner[n:][inside]))
        return out


_WORDS = Words()


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about PART bytes, cut behind a word."""
    at = 0
    while at < len(text):
        end = at + PART
        while end < len(text) and (found := WORD.match(text, end)):
            end = found.end()
        yield text[at:end]
        at = end


def long_counts(text: bytes, buckets: int, order: int) -> tuple[np.ndarray, int]:
    """Bucket counts of one long text, part by part; the last words of a part lead into the next one."""
    total, n_words, before = np.zeros(buckets, dtype=np.int64), 0, []
    for part in pieces(text):
        words = WORD.findall(part)
        _WORDS.make_room()
        own = _WORDS.numbers(before + words)
        for n, (crc, _) in enumerate(_WORDS.runs(own, np.zeros(len(own), dtype=np.int64), order)):
            # Runs of n + 1 words that end in this part: those that lie in `before` alone were counted with their part.
            total += np.bincount(crc[max(0, len(before) - n) :] % np.uint32(buckets), minlength=buckets)
        n_words += len(words)
        before = (before + words)[-(order - 1) :] if order > 1 else []
    return total, n_words


def csr(texts: list[str], buckets: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """indptr, indices, counts, words and features of each text."""
    raw = [t.encode("utf-8").lower() for t in texts]
    short = [x if len(x) <= PART else b"" for x in raw]
    found = [WORD.findall(x) for x in short]
    n_words = np.array([len(f) for f in found], dtype=np.int64)
    _WORDS.make_room()
    numbers = _WORDS.numbers([w for f in found for w in f])
    owner = np.repeat(np.arange(len(texts)), n_words)
    cells = np.concatenate([o * buckets + (crc % np.uint32(buckets)).astype(np.int64) for crc, o in _WORDS.runs(numbers, owner, order)])
    if 16 * len(cells) > buckets * len(texts):
        dense = np.bincount(cells, minlength=buckets * len(texts))
        at = np.flatnonzero(dense)
        counts = dense[at]
    else:
        at, counts = np.unique(cells, return_counts=True)
    row, index = at // buckets, at % buckets
    for k in [k for k, x in enumerate(raw) if len(x) > PART]:
        total, n_words[k] = long_counts(raw[k], buckets, order)
        own, i = np.flatnonzero(total), int(np.searchsorted(row, k))
        row, index, counts = np.insert(row, i, np.full(len(own), k)), np.insert(index, i, own), np.insert(counts, i, total[own])
    indptr = np.searchsorted(row, np.arange(len(texts) + 1))
    return indptr, index, counts, n_words, sum(np.maximum(n_words - n, 0) for n in range(order))


def narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs: one, two, four or eight."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]).astype(np.int64) if n else np.zeros(0, dtype=np.int64)


BLOCK = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("n_features", pa.list_(pa.int64())), ("indptr", pa.list_(pa.int64())), ("indices", pa.binary()), ("counts", pa.binary())])


def count_matrix(docs: DataFrame, buckets: int = BUCKETS, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The persisted matrix, one compressed sparse row block a row: doc_ids, n_words, n_features, indptr, indices, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_parts(batch, "text", PART, ROWS):
                indptr, indices, counts, n_words, n_features = csr(texts_of(part), buckets, order)
                columns = [[part.column("doc_id").to_pylist()], [n_words], [n_features], [indptr], [narrow(indices)], [narrow(counts)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, BLOCK)], schema=BLOCK)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    types = "doc_ids array<long>, n_words array<long>, n_features array<long>, indptr array<long>, indices binary, counts binary"
    return materialize(spread(source).mapInArrow(run, types), "counts")


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. Each task sums its blocks, so at most `buckets` rows leave a task, and as many come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for n, indices, counts in zip(*[batch.column(c).to_pylist() for c in ("n", "indices", "counts")]):
                total += np.bincount(wide(indices, n), weights=wide(counts, n), minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = np.zeros(buckets, dtype=np.int64)
    for r in matrix.select(F.element_at("indptr", -1).alias("n"), "indices", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r["bucket"]] = r["n"]
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of the ratio of the smoothed distributions, rounded down, of each bucket."""
    k = len(source)
    s_all, t_all = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the product of the matrix with the gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                indptr = np.array(block["indptr"], dtype=np.int64)
                n = int(indptr[-1])
                upto = np.concatenate(([0], np.cumsum(gain[wide(block["indices"], n)] * wide(block["counts"], n))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc_ids"], pa.int64()), pa.array(block["n_words"], pa.int64()), pa.array(block["n_features"], pa.int64()), pa.array(upto[indptr[1:]] - upto[indptr[:-1]])],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from eight hex digits of the hash of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank to the highest scores of documents with enough words.

    The narrow rows are sorted by ranges once; a row's place is the number of rows in the ranges before plus its place in its
    own. Candidates sort first, so places of candidates are ranks. A number of the row ends the sort key, so rows that are
    alike (one id a third of the table) still fall into many ranges.
    """
    rows = materialize(scored.withColumns({"candidate": F.col("n_words") >= least_words, "row": F.monotonically_increasing_id()}), "scores")
    order = [F.desc("candidate"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    places = {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    laid = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(places), "ranked")
    totals = sorted((r["part"], r["n"], r["c"]) for r in laid.groupBy("part").agg(F.count("*").alias("n"), F.count_if("candidate").alias("c")).collect())
    release(rows)
    if len(totals) > MAX_PARTITIONS:
        raise ValueError(f"{len(totals)} ranges; lower the number of shuffle partitions")
    drawn = percent * sum(c for *_, c in totals) // 100
    before = np.cumsum([0, *[n for _, n, _ in totals]])
    bases = laid.sparkSession.createDataFrame([(p, int(b)) for (p, *_), b in zip(totals, before)], "part int, base long")
    place = F.col("base") + F.col("at") + 1
    return laid.join(F.broadcast(bases), "part").withColumn("rank", F.when(F.col("candidate") & (place <= drawn), place)).drop("part", "at", "base", "row", "candidate")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text", target_id: str = "item_id", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, and rank (1, 2, 3 ... of the documents drawn; else null) of every document."""
    wanted = count_matrix(target, buckets, order, target_id, target_text)
    matrix = count_matrix(docs, buckets, order, doc_id, text)
    gain = gains(column_sums(matrix, buckets), column_sums(wanted, buckets))
    scored = weights(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    out = ranked(scored, percent, least_words)
    release(matrix, wanted)
    return out
