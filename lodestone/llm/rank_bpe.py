"""Byte-level BPE by a file of ranks, through the tiktoken library.

Each match of the split pattern is encoded on its own. The library matches a whole text in one call, which overflows its
stack on very long runs of blanks, so long texts are split beforehand, only where every way of matching begins a new match:

* before a blank that follows something else: no match holds a blank behind its first sign unless it is all blanks;
* between a letter or digit and a listed punctuation sign: runs of letters, of digits and of other signs do not mix;
* inside a run of blanks, before its last one if something follows: the run without it is one match.

Such parts give the same matches as the whole text, so their ids are simply joined. A run of more than LONG_BLANKS blanks is
handed to the library as the single match that it is. Decoding joins the raw bytes of the ids; they need not be valid UTF-8.

Defined cases: null is empty (no ids); strings that look like special tokens are ordinary text; repeated rows stay repeated;
an empty table gives no rows; further columns are ignored; texts of any length go through, in parts of about PART signs
(longer where nothing allows a cut). Unknown or null ids in decoding are an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, slices, spread, texts_of

#: Texts of more signs than this are split.
LONG = 1 << 16
PART = 1 << 15
LONG_BLANKS = 1 << 12

#: The code points of Unicode's White_Space property.
BLANK = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Some signs that are letters or digits in every version of Unicode, and some that are neither.
SURE_WORD = "0-9A-Za-zぁ-ゖァ-ヺ一-鿌가-힣"
SURE_SIGN = ",.;:!?()\"。，、！？；："
SAFE = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])|(?<=[{SURE_WORD}])(?=[{SURE_SIGN}])")
RUN = re.compile(f"[{BLANK}]{{{LONG_BLANKS},}}")

_LOADED: dict[tuple[str, str], "Ranks"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class Ranks:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.lib = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})

    def _short(self, text: str) -> np.ndarray:
        return self.lib.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LONG:
            return self._short(text)
        out, at = [], 0
        for run in RUN.finditer(text):
            # Of a run with something behind it, the last blank belongs to what follows.
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out += [self._short(text[a:b]) for a, b in safe_parts(text, at, run.start())]
            out.append(np.array(self.lib._encode_single_piece(text[run.start() : stop]), dtype=np.uint32))
            at = stop
        out += [self._short(text[a:b]) for a, b in safe_parts(text, at, len(text))]
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.lib.decode_bytes(ids.tolist())


def safe_parts(text: str, start: int, end: int, size: int = PART) -> list[tuple[int, int]]:
    """start to end in parts of about `size`, cut where a match must begin."""
    out = []
    while end - start > size:
        found = SAFE.search(text, start + size, end)
        if found is None or found.start() >= end:
            break
        out.append((start, found.start()))
        start = found.start()
    return out + [(start, end)] if start < end else out


def ranks(path: str, pattern: str) -> Ranks:
    """The worker's own encoder, kept between tasks."""
    claim(f"ranks {path}", lambda: _LOADED.pop((path, pattern), None))
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Ranks(path, pattern)
    return _LOADED[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, columns: str, emit: Callable[[Ranks, list[np.ndarray]], list[pa.Array]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and what `emit` makes of the ids of each whole text (`columns` is its schema)."""
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranks(path, pattern)
        for part in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *emit(enc, [enc.encode(t) for t in texts_of(part)])], names=names)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return spread(source).mapInArrow(run, f"doc_id long, {columns}")


def encode(docs: DataFrame, path: str, pattern: str, **more) -> DataFrame:
    """doc_id, ids array<int>."""
    return encoded(docs, path, pattern, "ids array<int>", lambda _, found: [pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], **more)


def decode(rows: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, data: the raw bytes of the ids; a null list has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranks(path, pattern)
        for part in slices(batches, 256):
            found = [enc.decode(np.array(x or [], dtype=np.int64)) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "data"])

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str, **more) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256 (decoded bytes)."""

    def emit(enc: Ranks, found: list[np.ndarray]) -> list[pa.Array]:
        n = [len(x) for x in found]
        a = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
        b = [hashlib.sha256(enc.decode(x)).hexdigest() for x in found]
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return encoded(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", emit, **more)
