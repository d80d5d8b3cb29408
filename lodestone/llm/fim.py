"""Fill-in-the-middle transformation of whole Arrow batches.

The texts of a batch lie end to end in one UTF-8 buffer. A table of 256 entries gives each byte its class, a mask over pairs
of adjacent classes marks where units begin (code points, words or lines), and the mask's running sums, taken anew for each
document, number the units. One binary search over the running sums finds all cuts of all rows; one gather writes all outputs.
The draws (form and cuts) are digits of a keyed hash of the id, so they do not depend on partitions, order or retries.

Forms: "plain" is the text; "psm" is prefix mark, prefix, suffix mark, suffix, middle mark, middle; "spm" is suffix mark,
suffix, prefix mark, prefix, middle mark, middle. `restored` rebuilds the exact text from an output and its form.

Defined cases: a null text is empty; empty texts and texts that hold a mark stay plain, with null cuts; a null id is drawn as
an empty id; rows are handled one by one, so repeated rows stay repeated; an empty table gives no rows; further columns are
ignored. A batch is cut into parts of about PART bytes; a longer text is a part of its own and needs memory in proportion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, spread

#: Marks of the parts: prefix, suffix, middle.
MARKS = ("<P>", "<S>", "<M>")
PART = 4 << 20
#: Segments longer than this on average are copied as slices, shorter ones by one gather.
LONG_SEGMENT = 4096


def byte_classes(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """[256] class of each byte, and [class before, class] whether a unit begins between two adjacent bytes.

    "character": every byte but a continuation byte begins one. "word": a unit is a word with the blanks behind it.
    "line": a unit is a line with its line feed.
    """
    table = np.zeros(256, dtype=np.uint8)
    if unit == "character":
        table[0x80:0xC0] = 1
        return table, np.array([[True, False], [True, False]])
    if unit == "word":
        table[[0x20, *range(0x09, 0x0E)]] = 1
        return table, np.array([[False, False], [True, False]])
    if unit == "line":
        table[0x0A] = 1
        return table, np.array([[False, False], [True, True]])
    raise ValueError(f"unknown unit {unit}")


@dataclass(frozen=True)
class Rule:
    """How documents are drawn and written. Percentages are of all documents (fim) and of the transformed ones (spm)."""

    fim_percent: int = 90
    spm_percent: int = 20
    unit: str = "character"
    marks: tuple[str, str, str] = MARKS
    raw_marks: tuple[bytes, ...] = field(init=False)

    def __post_init__(self):
        raw = tuple(m.encode("utf-8") for m in self.marks)
        for a in raw:
            for b in raw:
                if not a or any(a.endswith(b[:k]) for k in range(1, len(b))) or (a is not b and b in a):
                    raise ValueError("marks must not be empty, hold or overlap each other")
        object.__setattr__(self, "raw_marks", raw)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one buffer of bytes, and the [rows + 1] offsets into it, from 0."""
    big = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"").cast(pa.large_binary())
    _, offsets, data = big.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[big.offset : big.offset + len(big) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def joined(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[rows, segments] parts of `source` laid end to end: the bytes, and the offsets of the rows."""
    ends = np.concatenate(([0], np.cumsum(lengths.sum(axis=1))))
    s, n = starts.ravel(), lengths.ravel()
    if ends[-1] > LONG_SEGMENT * max(1, len(n)):
        parts = [source[a : a + k] for a, k in zip(s.tolist(), n.tolist()) if k]
        return (np.concatenate(parts) if parts else source[:0]), ends
    at = np.cumsum(n) - n
    return source[np.repeat(s - at, n) + np.arange(ends[-1])], ends


def strings(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    big = pa.Array.from_buffers(pa.large_utf8(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    return big.cast(pa.string())


def unit_starts(raw: np.ndarray, at: np.ndarray, unit: str) -> np.ndarray:
    """Mask of the bytes that begin a unit; the first byte of each document does."""
    table, begins = byte_classes(unit)
    cls = table[raw]
    mask = np.empty(len(raw), dtype=bool)
    if len(raw):
        mask[1:] = begins[cls[:-1], cls[1:]]
        mask[at[:-1][at[:-1] < at[1:]]] = True
    return mask


@dataclass
class Cut:
    """The transformed rows of a part: form of each (0 plain, 1 psm, 2 spm), unit counts, outputs."""

    form: np.ndarray
    n: np.ndarray
    prefix: np.ndarray
    middle: np.ndarray
    raw: np.ndarray
    ends: np.ndarray


FORMS = np.array(["plain", "psm", "spm"], dtype=object)


def transformed(texts: pa.Array, draws: list[np.ndarray], rule: Rule) -> Cut:
    """The whole kernel: all rows of a part together. `draws` are four arrays of 32-bit numbers."""
    h1, h2, h3, h4 = draws
    raw, at = buffers(texts)
    marked = np.zeros(len(texts), dtype=bool)
    binary = texts.cast(pa.large_binary())
    for m in rule.raw_marks:
        marked |= pc.fill_null(pc.match_substring(binary, m), False).to_numpy(zero_copy_only=False)
    running = np.cumsum(unit_starts(raw, at, rule.unit), dtype=np.int64)
    upto = np.concatenate(([0], running))
    first = upto[at[:-1]]
    n = upto[at[1:]] - first
    x, y = h1 % (n + 1), h2 % (n + 1)
    lo, hi = np.minimum(x, y), np.maximum(x, y)
    # The k-th unit of a document begins where the running sum first reaches first + k + 1; at k = n that is its end.
    cuts = np.minimum(np.searchsorted(running, np.concatenate((first + lo, first + hi)) + 1), np.tile(at[1:], 2))
    a, b = cuts[: len(n)], cuts[len(n) :]
    form = np.where((n == 0) | marked | (h3 % 100 >= rule.fim_percent), 0, np.where(h4 % 100 < rule.spm_percent, 2, 1))
    marks = np.frombuffer(b"".join(rule.raw_marks), dtype=np.uint8)
    size = np.array([len(m) for m in rule.raw_marks])
    mark_at = len(raw) + np.cumsum(size) - size
    start, end = at[:-1], at[1:]
    plain, psm = (form == 0)[:, None], (form == 1)[:, None]
    none = np.zeros_like(start)
    rows = lambda *cols: np.stack([np.broadcast_to(c, start.shape) for c in cols], axis=1)
    p, s, m = range(3)
    starts = np.where(plain, rows(start, none, none, none, none, none), np.where(psm, rows(mark_at[p], start, mark_at[s], b, mark_at[m], a), rows(mark_at[s], b, mark_at[p], start, mark_at[m], a)))
    lengths = np.where(
        plain, rows(end - start, none, none, none, none, none),
        np.where(psm, rows(size[p], a - start, size[s], end - b, size[m], b - a), rows(size[s], end - b, size[p], a - start, size[m], b - a)),
    )
    out, ends = joined(np.concatenate((raw, marks)), starts, lengths)
    return Cut(form, n, lo, hi - lo, out, ends)


def restored(output: pa.Array, form: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The exact texts from outputs and forms alone, as bytes and offsets. A mark's first place is the operator's own, since no
    transformed text holds a mark."""
    raw, at = buffers(output)
    start, end = at[:-1], at[1:]
    binary = output.cast(pa.large_binary())
    p, s, m = [pc.fill_null(pc.find_substring(binary, x), 0).to_numpy(zero_copy_only=False).astype(np.int64) + start for x in rule.raw_marks]
    np_, ns, nm = (len(x) for x in rule.raw_marks)
    psm, spm = form == 1, form == 2
    prefix = np.where(psm, start + np_, np.where(spm, p + np_, start))
    prefix_end = np.where(psm, s, np.where(spm, m, end))
    suffix = np.where(psm, s + ns, np.where(spm, start + ns, end))
    suffix_end = np.where(psm, m, np.where(spm, p, end))
    middle = np.where(psm | spm, m + nm, end)
    return joined(raw, np.stack((prefix, middle, suffix), axis=1), np.stack((prefix_end - prefix, end - middle, suffix_end - suffix), axis=1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the hash of `seed:id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def mapped(docs: DataFrame, rule: Rule, seed: int, doc_id: str, text: str, columns: str, emit: Callable[[Cut], list[pa.Array]]) -> DataFrame:
    schema = f"{CUT}, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_parts(batch, "text", PART):
                cut = transformed(part.column("text"), [part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)], rule)
                plain = cut.form == 0
                cols = [part.column("doc_id"), pa.array(cut.n), pa.array(FORMS[cut.form], pa.string()), pa.array(cut.prefix, mask=plain), pa.array(cut.middle, mask=plain)]
                yield pa.RecordBatch.from_arrays([*cols, *emit(cut)], names=names)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *draws(F.col(doc_id), seed))
    return spread(source).mapInArrow(run, schema)


def transform(docs: DataFrame, rule: Rule = Rule(), seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (units; null if plain), output."""
    return mapped(docs, rule, seed, doc_id, text, "output string", lambda cut: [strings(cut.raw, cut.ends)])


def restore(rows: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", output: str = "output", form: str = "form") -> DataFrame:
    """doc_id and text, rebuilt from outputs and forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_parts(batch, "output", PART):
                kinds = (pc.equal(part.column("form"), "psm").to_numpy(zero_copy_only=False) + 2 * pc.equal(part.column("form"), "spm").to_numpy(zero_copy_only=False)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), strings(*restored(part.column("output"), kinds, rule))], names=["doc_id", "text"])

    source = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(output, F.lit("")).alias("output"), F.coalesce(form, F.lit("plain")).alias("form"))
    return source.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, rule: Rule = Rule(), seed: int = 1, **more) -> DataFrame:
    """transform() with the digests of the output and of the text restored from it, in place of the output."""

    def hexes(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
        view, at = memoryview(np.ascontiguousarray(raw)), ends.tolist()
        return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())

    def emit(cut: Cut) -> list[pa.Array]:
        return [hexes(cut.raw, cut.ends), hexes(*restored(strings(cut.raw, cut.ends), cut.form, rule))]

    return mapped(docs, rule, seed, more.get("doc_id", "doc_id"), more.get("text", "text"), "output_sha256 string, restored_sha256 string", emit)
