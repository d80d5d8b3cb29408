"""Byte-level BPE encoding and decoding, with tree concatenation for long texts.

Texts of up to `leaf` bytes are encoded at once. Longer ones are halved until the parts are that short, the parts are
encoded on their own, and neighbours are joined: a window around the join is encoded again, and grows until it agrees
with both sides exactly. It agrees at a piece start common to both (pieces are found from left to right, so from a common
start on both go on alike), or, inside one long unsplit piece, at a token common to both: tokens of a piece are right if
every adjacent pair is, and a common token hands the pairs over. Texts above `spread` characters are dealt out as leaves,
so that one huge document is encoded by many tasks; only its tokens come together again.

Defined cases: null is empty (no tokens); special strings in a text become their ids, as the library does by default;
repeated rows stay repeated; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of
from .common import spread as spread_rows
from .pieces import Encoded, PieceEncoder, byte_letters, encoder

LEAF = 1 << 14
SPREAD = 1 << 16
WINDOW = 64
MARGIN = 16
UNSPLIT = 1 << 10

_TABLES: dict[str, "ByteTables"] = {}


class ByteTables:
    """Bytes, byte lengths and decimal strings of all ids."""

    def __init__(self, enc: PieceEncoder):
        letters, vocab = byte_letters(), enc.tok.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in enc.special else bytes(letters[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes))]


def tables(path: str) -> ByteTables:
    if path not in _TABLES:
        _TABLES[path] = ByteTables(encoder(path, "byte"))
    return _TABLES[path]


def decode(path: str, ids: np.ndarray) -> str:
    return b"".join(map(tables(path).bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class Tree:
    """Joins encoded parts of one text (as UTF-8) without special strings."""

    def __init__(self, path: str, data: bytes, leaf: int = LEAF, encode: Callable[[str], Encoded] | None = None):
        self.data, self.leaf = data, leaf
        self.lengths = tables(path).lengths
        self.encode = encode or encoder(path, "byte").encode_split

    def part(self, a: int, b: int) -> Encoded:
        return self.encode(self.data[a:b].decode("utf-8"))

    def cuts(self) -> list[int]:
        """Ends of the leaves."""
        n = len(self.data)
        ends = [char_start(self.data, a) for a in range(self.leaf, n, self.leaf)]
        return [e for e in ends if e < n] + [n]

    def build(self, leaves: list[Encoded], ends: list[int]) -> Encoded:
        starts = [0, *ends[:-1]]
        while len(leaves) > 1:
            out, s, e = [], [], []
            for k in range(0, len(leaves), 2):
                if k + 1 == len(leaves):
                    out.append(leaves[k])
                    e.append(ends[k])
                else:
                    out.append(self.join(leaves[k], leaves[k + 1], starts[k], ends[k], ends[k + 1]))
                    e.append(ends[k + 1])
                s.append(starts[k])
            leaves, starts, ends = out, s, e
        return leaves[0]

    def all(self) -> Encoded:
        ends = self.cuts()
        return self.build([self.part(a, b) for a, b in zip([0, *ends[:-1]], ends)], ends)

    def join(self, left: Encoded, right: Encoded, lo: int, mid: int, hi: int) -> Encoded:
        lpos = lo + np.concatenate(([0], np.cumsum(self.lengths[left.ids])))
        rpos = mid + np.concatenate(([0], np.cumsum(self.lengths[right.ids])))
        width = WINDOW
        while True:
            end = char_start(self.data, min(mid + width, hi))
            k = np.searchsorted(lpos[left.starts], mid - width, side="right") - 1
            i = int(left.starts[k]) if k >= 0 else 0  # a piece start: from here the split is that of the whole text
            if lpos[i] < mid - UNSPLIT and (whole := self.inside(left, right, lpos, rpos, i, mid, width, end)) is not None:
                return whole
            if lpos[i] >= mid - 2 * width or width > UNSPLIT:
                win = self.part(int(lpos[i]), end)
                wpos = lpos[i] + np.concatenate(([0], np.cumsum(self.lengths[win.ids])))
                if end == hi:
                    return self.splice(left, i, win, len(win), right, len(right))
                both = np.intersect1d(wpos[win.starts], rpos[right.starts])
                both = both[(both >= mid) & (both <= end - MARGIN)]
                if len(both):
                    return self.splice(left, i, win, int(np.searchsorted(wpos, both[0])), right, int(np.searchsorted(rpos, both[0])))
            if end == hi and lpos[i] == lo and width >= hi - lo:
                return self.part(lo, hi)
            width *= 2

    def inside(self, left: Encoded, right: Encoded, lpos, rpos, i: int, mid: int, width: int, end: int) -> Encoded | None:
        """A join in one unsplit piece that begins far to the left: hand over at tokens common to both sides."""
        k = int(np.searchsorted(lpos, mid - width, side="right")) - 1
        while k > i and self.data[lpos[k]] & 0xC0 == 0x80:
            k -= 1
        if k <= i:
            return None
        win = self.part(int(lpos[k]), end)
        wpos = lpos[k] + np.concatenate(([0], np.cumsum(self.lengths[win.ids])))
        piece_end = wpos[win.starts[1]] if len(win.starts) > 1 else wpos[-1]
        if piece_end <= mid + MARGIN and end < int(rpos[-1]):
            return None  # the piece ends near the join
        ltok = {(int(s), int(t)) for s, t, e in zip(lpos[k:-1], left.ids[k:], lpos[k + 1 :]) if e <= mid - MARGIN}
        at = next((j for j, (s, t, e) in enumerate(zip(wpos[:-1], win.ids, wpos[1:])) if (int(s), int(t)) in ltok and e <= piece_end), None)
        if at is None:
            return None
        n = int(np.searchsorted(rpos, end, side="right"))
        first_end = rpos[right.starts[1]] if len(right.starts) > 1 else rpos[-1]
        rtok = {(int(s), int(t)): j for j, (s, t, e) in enumerate(zip(rpos[:n], right.ids[:n], rpos[1 : n + 1])) if e <= first_end}
        stop = next(
            (j for j, (s, t, e) in enumerate(zip(wpos[:-1], win.ids, wpos[1:])) if s >= mid + MARGIN and e <= min(piece_end, end - MARGIN) and (int(s), int(t)) in rtok),
            None,
        )
        if stop is None:
            return None
        lcut = int(np.searchsorted(lpos, wpos[at]))
        win = Encoded(win.ids[at:], np.zeros(0, dtype=np.int64))
        return self.splice(left, lcut, win, stop - at, right, rtok[int(wpos[stop]), int(win.ids[stop - at])])

    @staticmethod
    def splice(left: Encoded, i: int, win: Encoded, j: int, right: Encoded, k: int) -> Encoded:
        ids = np.concatenate((left.ids[:i], win.ids[:j], right.ids[k:]))
        starts = np.concatenate((left.starts[left.starts < i], win.starts[win.starts < j] + i, right.starts[right.starts >= k] - k + i + j))
        return Encoded(ids, starts)


def encode_text(path: str, text: str, leaf: int = LEAF) -> np.ndarray:
    enc = encoder(path, "byte")
    if len(text) <= leaf // 4:
        return enc.encode(text)
    out = []
    for part, special in enc.segments(text):
        data = part.encode("utf-8")
        out.append(Tree(path, data, leaf).all().ids if len(data) > leaf else enc.encode_split(part).ids)
        if special is not None:
            out.append(np.array([special], dtype=np.uint32))
    return np.concatenate(out)


LEAVES = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("leaf", pa.int32()), ("data", pa.binary()), ("special", pa.int32()), ("ids", pa.binary()), ("starts", pa.binary())])
LEAVES_SQL = "key binary, doc_id long, leaf int, data binary, special int, ids binary, starts binary"


def encode_documents(
    docs: DataFrame,
    path: str,
    emit: Callable[[list[np.ndarray]], list[pa.Array]],
    columns: str,
    doc_id: str = "doc_id",
    text: str = "text",
    leaf: int = LEAF,
    spread: int = SPREAD,
) -> DataFrame:
    """doc_id and what `emit` makes of the ids of each whole text (`columns` is its schema)."""
    source = spread_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    long = F.coalesce(F.length("text") > spread, F.lit(False))
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]
    schema = f"doc_id long, {columns}"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *emit([encode_text(path, t, leaf) for t in texts_of(part)])], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for doc, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                key = hashlib.sha256(f"{doc}\n{t}".encode("utf-8", "surrogatepass")).digest()
                rows = []
                for part, special in encoder(path, "byte").segments(t):
                    data = part.encode("utf-8")
                    ends = Tree(path, data, leaf).cuts()
                    rows += [(data[a:b], -1) for a, b in zip([0, *ends[:-1]], ends)]
                    rows[-1] = (rows[-1][0], -2 if special is None else special)
                yield pa.RecordBatch.from_pylist([{"key": key, "doc_id": doc, "leaf": i, "data": d, "special": s, "ids": None, "starts": None} for i, (d, s) in enumerate(rows)], schema=LEAVES)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [encoder(path, "byte").encode_split(d.decode("utf-8")) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([e.ids.tobytes() for e in done], pa.binary()), pa.array([e.starts.astype(np.int64).tobytes() for e in done], pa.binary())], schema=LEAVES
            )

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["leaf"])
        copies = sum(r["leaf"] == 0 for r in rows)
        rows = rows[::copies]
        out, part = [], []
        for r in rows:
            part.append(r)
            if r["special"] != -1:  # the last leaf of a part
                data = b"".join(x["data"] for x in part)
                ends = np.cumsum([len(x["data"]) for x in part]).tolist()
                encoded = [Encoded(np.frombuffer(x["ids"], dtype=np.uint32), np.frombuffer(x["starts"], dtype=np.int64)) for x in part]
                out.append(Tree(path, data, leaf).build(encoded, ends).ids)
                if r["special"] >= 0:
                    out.append(np.array([r["special"]], dtype=np.uint32))
                part = []
        made = emit([np.concatenate(out)] * copies)
        return pa.Table.from_arrays([pa.array([rows[0]["doc_id"]] * copies, pa.int64()), *made], names=names)

    spread_out = source.where(long).mapInArrow(cut, LEAVES_SQL).repartition("key", "leaf").mapInArrow(leaves, LEAVES_SQL)
    return source.where(~long).mapInArrow(short, schema).unionByName(spread_out.groupBy("key").applyInArrow(join, schema))


def ids_of(docs: DataFrame, path: str, **more) -> DataFrame:
    """doc_id, ids array<int>."""
    return encode_documents(docs, path, lambda found: [pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], "ids array<int>", **more)


def digests(docs: DataFrame, path: str, **more) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def emit(found: list[np.ndarray]) -> list[pa.Array]:
        decimal, n, a, b = tables(path).decimal.__getitem__, [], [], []
        for ids in found:
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(decimal, ids.tolist())).encode()).hexdigest())
            b.append(hashlib.sha256(decode(path, ids).encode("utf-8")).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return encode_documents(docs, path, emit, "n_tokens long, ids_sha256 string, decoded_sha256 string", **more)
