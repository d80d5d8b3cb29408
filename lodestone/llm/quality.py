"""Quality classification by nearest-neighbour voting among latent-semantic vectors.

A text's terms are the shapes of its words (letter runs shortened to A, Aa or a, digits to 0, other signs kept), pairs of
neighbouring shapes, and how often words and word pairs come again; a word whose shape is longer than SYMBOLS, as texts
without spaces have, counts as the consecutive pieces it is cut into. Terms are hashed into a fixed number of dimensions and
weighted by tf-idf. A truncated singular value decomposition of a bounded labelled sample (numpy, randomised range finder
with a fixed seed) gives the latent space. The labelled vectors, at most `per_class` of each class, are broadcast; for every
document exact cosines to all of them are computed in blocks, and the `neighbours` nearest vote with weights that grow with
similarity. The vote is corrected for the classes' numbers in the sample against those in all labels.

All sizes of the model are fixed by parameters. The corpus is read once, without a shuffle, and whole texts are scored.

Defined cases: null texts count as empty and are scored too; texts without a term get the share of label 1; labels other
than 0 and 1 and null labels are not learnt from, and of repeated labels of a document the least counts; with no label at
all the score is 1; an empty table gives no rows; repeated rows stay repeated; further columns are kept by the filter and
ignored by the query.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, held_out, slices, spread, texts_of, trim, uniform

THRESHOLD = 0.7
CACHE_WORDS = 120_000
SYMBOLS = 40
UPPER_RUN, CAPITAL, LOWER_RUN, DIGITS = (re.compile(p) for p in ("\x01{2,}", "\x01\x02*", "\x02+", "\x03+"))
UNIT = re.compile("\x01{2,}|\x01\x02*|\x02+|\x03+|(.)\\1*")
_SHAPES: dict[str, int] = {}


class Classes(dict):
    """Translation of characters: upper case to 1, other letters to 2, digits to 3, the rest stays."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else code
        return self[code]


CLASSES = Classes()


def shape(word: str) -> str:
    s = DIGITS.sub("0", word.translate(CLASSES))
    s = UPPER_RUN.sub("A", s)
    s = CAPITAL.sub(lambda m: "C" if len(m[0]) > 1 else "I", s)
    s = LOWER_RUN.sub("a", s)
    return re.sub(r"(.)\1+", r"\1+", s)


def pieces(word: str) -> list[str]:
    """The word, or if its shape is longer than SYMBOLS its consecutive pieces: each ends behind punctuation or at that length."""
    if len(word) <= SYMBOLS or len(shape(word)) <= SYMBOLS:
        return [word]
    out, start, length, closed = [], 0, 0, False
    for m in UNIT.finditer(word.translate(CLASSES)):
        mark = unicodedata.category(word[m.start()])[0] in "PS"
        size = 2 if m[1] and m.end() - m.start() > 1 else 1
        if length + size > SYMBOLS or closed and not mark:
            out.append(word[start : m.start()])
            start, length = m.start(), 0
        length += size
        closed = mark
    return [*out, word[start:]]


def shape_id(word: str) -> int:
    """A 31-bit hash of a word's shape, the same on every machine."""
    h = 2166136261
    for b in shape(word).encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h >> 1


def shapes_of(words: list[str]) -> np.ndarray:
    if len(_SHAPES) > CACHE_WORDS:
        _SHAPES.clear()
    for w in set(words).difference(_SHAPES):
        _SHAPES[w] = shape_id(w)
    return np.fromiter(map(_SHAPES.__getitem__, words), dtype=np.int64, count=len(words))


def terms(text: str, dims: int) -> np.ndarray:
    """Term frequencies of a text in the hashed dimensions, as shares of its words (long ones in pieces)."""
    words = [p for w in text.split() for p in (pieces(w) if len(w) > SYMBOLS else (w,))]
    out = np.zeros(dims, dtype=np.float32)
    n = len(words)
    if not n:
        return out
    s = shapes_of(words)
    pair = (s[1:] * 31 + s[:-1]) * 2654435761 % (1 << 31)
    ids = np.concatenate((s, pair)) % (dims - 32)
    out[: dims - 32] = np.bincount(ids, minlength=dims - 32)
    number: dict[str, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    again = int((code[1:] == code[:-1]).sum())
    two = len(np.unique(code[1:] * len(number) + code[:-1])) if n > 1 else 0
    for k, x in enumerate((again / n, 1 - len(number) / n, 1 - two / max(1, n - 1))):
        out[dims - 32 + 8 * k + min(7, int(x * 8))] = n * (0.25 + x)
    return out / n


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray  # dims x latent
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    weights: np.ndarray  # of the classes
    prior: float
    neighbours: int

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        x = np.sqrt(rows) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = self.weighted(rows) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        claim("quality", _SHAPES.clear)
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(texts), block):
            rows = np.stack([terms(t, len(self.idf)) for t in texts[a : a + block]])
            cosine = self.latent(rows) @ self.vectors.T
            top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(cosine, top, axis=1)
            vote = np.exp(20.0 * (near - near.max(axis=1, keepdims=True))) * self.weights[self.labels[top]]
            share = (vote * self.labels[top]).sum(axis=1) / vote.sum(axis=1)
            out[a : a + block] = np.where(rows.any(axis=1), share, self.prior)
        return np.clip(out, 0, 1)


def train(texts: list[str], labels: list[int], counts: tuple[int, int] | None = None, dims: int = 2048, latent: int = 48, neighbours: int = 25, seed: int = 5) -> QualityModel:
    y = np.array(labels, dtype=np.int64)
    if not len(y):
        return QualityModel(np.zeros(dims, np.float32), np.zeros((dims, 1), np.float32), np.zeros((0, 1), np.float32), y, np.ones(2), 1.0, neighbours)
    rows = np.stack([terms(t, dims) for t in texts])
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 1
    all_counts = np.array(counts or np.bincount(y, minlength=2), dtype=np.float64)
    weights = all_counts / np.maximum(np.bincount(y, minlength=2), 1)
    model = QualityModel(idf, np.zeros((dims, 1), np.float32), np.zeros((0, 1), np.float32), y, weights / weights.max(), float(all_counts[1] / all_counts.sum()), neighbours)
    x = model.weighted(rows)
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(dims, latent + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    model.basis = np.ascontiguousarray((q @ vt.T)[:, :latent])
    model.vectors = model.latent(rows)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500, train_chars: int = 40_000, **more) -> QualityModel:
    """Train on at most `per_class` labelled documents of each class, each of at most `train_chars` characters."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(F.lit(True) if usable is None else usable).groupBy("doc_id").agg(F.min("y").alias("y"))
    found = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    counts = (found.get(0, 0), found.get(1, 0))
    if not sum(counts):
        return train([], [])
    share = F.when(F.col("y") == 1, min(1.0, 1.2 * per_class / max(1, counts[1]))).otherwise(min(1.0, 1.2 * per_class / max(1, counts[0])))
    picked = known.where(uniform("doc_id", 202) < share).limit(4 * per_class)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") <= train_chars)
    sample = rows.join(F.broadcast(picked), "doc_id").limit(4 * per_class).collect()
    sample.sort(key=lambda r: (r["y"], r["doc_id"], r["text"]))
    taken = [r for y in (0, 1) for r in [s for s in sample if s["y"] == y][:per_class]]
    del sample
    model = train([r["text"] for r in taken], [r["y"] for r in taken], counts, **more)
    del taken
    trim()
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = shared.value.score(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = shared.value.score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(score >= threshold))
        trim()

    return spread(docs).mapInArrow(run, docs.schema)
