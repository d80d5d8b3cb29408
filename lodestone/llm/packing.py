"""Packing by concatenating and cutting.

All documents are laid end to end and cut into windows of `length` tokens. The first pass encodes each document once and
keeps its ids, its partition and its place there (in tokens); one total per partition goes to the driver, whose prefix sums
are the partitions' global offsets. The second pass adds them and cuts at multiples of the window, giving one boundary
record per piece. There is no order to agree on and no shuffle: only totals, one number per input partition, meet.
All windows are full but the last one, so padding is below one window for the whole corpus.

Defined cases: null texts are empty and hold only the end id; each row is packed, repeated ones too; an empty table gives
no rows; further columns are ignored; very long texts go through as many windows as they need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread, texts_of, trim
from .pieces import encoder

LENGTH = 2048
END = 1
#: Rows of one totals table (16 bytes each) that may be broadcast: one per partition of the input.
MAX_PARTITIONS = 4_000_000


def encoded(docs: DataFrame, path: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part (partition), at (tokens before it there), n, ids (little-endian unsigned 16 or 32-bit), kept by a checkpoint."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path, "word"), TaskContext.get().partitionId(), 0
        small = enc.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16
        for batch in batches:
            for a in range(0, len(batch), 512):
                piece = batch.slice(a, 512)
                found = [np.append(enc.encode(t), np.uint32(end)) for t in texts_of(piece)]
                n = np.array([len(x) for x in found], dtype=np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                ids = [(x.astype(np.uint16) if small else x.astype(np.uint32)).tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.full(len(n), part)), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], schema=schema)
        trim()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(spread(source).mapInArrow(run, "doc_id long, part long, at long, n long, ids binary"))


def placed(tokens: DataFrame) -> DataFrame:
    """Adds base: the number of tokens in all partitions before the row's."""
    totals = sorted((r["part"], r["total"]) for r in tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total")).collect())
    if len(totals) > MAX_PARTITIONS:
        raise ValueError(f"{len(totals)} partitions; coalesce the input")
    sums = np.cumsum([0, *[t for _, t in totals]])
    bases = tokens.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, sums)], "part long, base long")
    return tokens.join(F.broadcast(bases), "part")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False, **more) -> DataFrame:
    """One boundary record per piece; with_ids adds the piece's ids as an array."""
    types = [("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    schema = pa.schema(types + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, at, n, raw, base in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "at", "n", "ids", "base")]):
                ids = np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                first = base + at
                cuts = [0, *range(length - first % length, n, length), n]
                for a, b in zip(cuts, cuts[1:]):
                    seq, off = divmod(first + a, length)
                    out.append((doc, a, b - a, zlib.crc32(ids[a:b].tobytes()), n, seq, off, *([ids[a:b].astype(np.int32)] if with_ids else [])))
            cols = list(zip(*out)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    return placed(encoded(docs, path, end, **more)).mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, pad: int = 0, **more) -> DataFrame:
    """sequence_id, ids (padded to `length`, except where their number is a power of two), boundaries (doc_id, start, length, offset)."""
    cut = pieces(docs, path, length, end, with_ids=True, **more)
    rows = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    n = F.size(ids)
    padded = F.when(n.bitwiseAND(n - 1) == 0, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad), F.lit(length) - n)))
    return rows.select("sequence_id", padded.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("boundaries"))
