"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and cut into words of letters. A word's features are itself and the byte n-grams (2 to 4) of <word>,
hashed into a fixed number of buckets; the text's vector is the mean of the embeddings of all features of all its words.
Embeddings and the softmax layer are trained together by stochastic gradient descent in numpy, on a bounded sample of
labelled rows: at most `per_language` documents of each language and `max_chars` characters in all, each of at most
`train_chars` characters, drawn by a hash of the id. The model has a fixed size (buckets x dimensions), so it may be
broadcast; the corpus is read once, without a shuffle, and every whole text is scored.

Rejection is calibrated on every fifth sampled document, which training does not see. A temperature is fitted to them, with
targets smoothed so that texts which are told apart without a fault do not drive it to an end. Two measures reject a
document: its calibrated probability, and the share of its features that training met at all. Their thresholds are set for
each language from the calibration texts of that language and from negatives made of them (letters dealt anew among a
text's words; words in letters of other scripts): between the two, but so that no more than `lost` of the true texts fall.

As the layer after the mean is linear, a worker keeps each word's summed embedding (at most CACHE_WORDS words).

Defined cases: null texts and texts without a letter are `und`, with score 0 and rejected; other rejected texts keep their
likeliest language and score; null languages are not learnt from; ties go to the alphabetically first language; with no labelled row every text is `und`; an empty table gives no
rows; repeated rows stay repeated; further columns are kept by the filter and ignored by the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, held_out, slices, spread, trim, uniform

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 120_000
_WORDS: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all features, and the word each belongs to."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(raw)), size)
    last = np.repeat(np.cumsum(size), size)
    at = np.arange(len(data))
    ids, owners = [], []
    h = np.zeros(len(data), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            nxt = np.zeros(len(data), dtype=np.uint64)
            nxt[: len(data) - n + 1] = data[n - 1 :]
            h = h * np.uint64(1000003) + nxt
            if n > 1:
                ok = at + n <= last
                ids.append((mix(h[ok] + np.uint64(n << 56)) % np.uint64(buckets)).astype(np.int64))
                owners.append(owner[ok])
        power = np.uint64(1)
        starts = np.cumsum(size) - size
        pos = (at - starts[owner]).astype(np.uint64)
        weight = np.ones(len(data), dtype=np.uint64)
        for bit in range(16):
            step = pow(31, 1 << bit, 1 << 64)
            weight = np.where((pos >> np.uint64(bit)) & np.uint64(1), weight * np.uint64(step), weight)
        whole = np.add.reduceat(data * weight, starts) if len(starts) else np.zeros(0, dtype=np.uint64)
        ids.append((mix(whole + power) % np.uint64(buckets)).astype(np.int64))
        owners.append(np.arange(len(raw)))
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class LanguageModel:
    languages: list[str]
    embed: np.ndarray  # buckets x dims
    out: np.ndarray  # dims x languages
    bias: np.ndarray
    met: np.ndarray  # buckets that training met
    temperature: float = 1.0
    least_score: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each language
    least_met: np.ndarray = field(default_factory=lambda: np.zeros(0))
    name: str = field(default="")

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.out + self.bias) / self.temperature

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        z = self.logits(vectors)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def digest(self) -> str:
        """A name for what was learnt: workers keep embedded words by it."""
        h = hashlib.sha256(repr((self.languages, self.embed.shape)).encode())
        for a in (self.embed, self.out, self.bias, self.met):
            h.update(np.ascontiguousarray(a))
        return h.hexdigest()

    def _known(self) -> tuple[dict[str, int], list[np.ndarray]]:
        claim("language", _WORDS.clear)
        if self.name not in _WORDS:
            _WORDS.clear()
            _WORDS[self.name] = ({}, [np.zeros((0, self.embed.shape[1] + 2), dtype=np.float32)])
        return _WORDS[self.name]

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean feature embedding of each text; the share of its features that training met; whether it has a letter."""
        index, table = self._known()
        words = [WORD.findall(t.lower()) for t in texts]
        if len(index) > CACHE_WORDS:
            index.clear()
            table[0] = table[0][:0]
        fresh = list({w for ws in words for w in ws if w not in index})
        for a in range(0, len(fresh), 4_000):
            part = fresh[a : a + 4_000]
            ids, owner = word_features(part, len(self.embed))
            order = np.argsort(owner, kind="stable")
            counts = np.bincount(owner, minlength=len(part))
            sums = np.add.reduceat(self.embed[ids[order]], np.cumsum(counts) - counts, axis=0)
            met = np.bincount(owner, weights=self.met[ids], minlength=len(part))
            base = len(table[0])
            table[0] = np.concatenate((table[0], np.column_stack((sums, met, counts)).astype(np.float32)))
            index.update(zip(part, range(base, base + len(part))))
        dims = self.embed.shape[1]
        out, met, letters = np.zeros((len(texts), dims)), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for i, ws in enumerate(words):
            if ws:
                s = table[0][np.fromiter(map(index.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0, dtype=np.float64)
                out[i], met[i] = s[:-2] / s[-1], s[-2] / s[-1]
                letters[i] = ws[0].isalpha() or any(c.isalpha() for w in ws for c in w)
        return out, met, letters

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the likeliest language, its calibrated probability, the share of met features, and whether there is a letter."""
        v, met, letters = self.vectors([t or "" for t in texts])
        p = self.probabilities(v)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best], met, letters

    def calibrate(self, texts: list[str], labels: np.ndarray, rng: np.random.Generator, lost: float) -> None:
        """Set the thresholds of rejection from true texts and from negatives made of them. A language with few calibration texts
        takes the threshold of all."""
        best, p, met, _ = self.judge(texts)
        bad_best, bad_p, bad_met, _ = self.judge(negatives(texts, rng))
        right = best == labels
        for k in range(len(self.languages)):
            own, bad = right & (labels == k), bad_best == k
            if own.sum() < 30 or bad.sum() < 30:
                own, bad = right, np.ones(len(bad_p), dtype=bool)
            # A text of two languages has no clear winner either: only what is less likely than not goes for its score.
            self.least_score[k] = min(between(p[own], bad_p[bad], lost / 2, 0.0), 0.5)
            self.least_met[k] = between(met[own], bad_met[bad], lost / 2, 0.25)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability, rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        lang: list[str] = []
        score, reject = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        for a in range(0, len(texts), 256):
            best, p, met, letters = self.judge(texts[a : a + 256])
            lang += [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters)]
            score[a : a + 256] = np.where(letters, p, 0.0)
            reject[a : a + 256] = ~letters | (p < self.least_score[best]) | (met < self.least_met[best])
        return lang, np.clip(score, 0, 1), reject


#: Firsts of runs of letters in other scripts, for negatives.
SCRIPTS = (0x0391, 0x0410, 0x05D0, 0x0627, 0x0905, 0x0E01, 0x3042, 0x4E00, 0xAC00, 0x00E0)


def negatives(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Two texts of no language for each text: its letters dealt anew among its words, and words of like lengths in another script."""
    out = []
    for t in texts:
        ws = WORD.findall((t or "").lower())
        if not ws:
            continue
        letters = np.array(list("".join(ws)))
        ends = np.cumsum([len(w) for w in ws])
        dealt = rng.permutation(letters)
        far = np.array([chr(c) for c in rng.choice(SCRIPTS) + rng.integers(0, 24, len(letters))])
        out += [" ".join("".join(x[e - len(w) : e]) for w, e in zip(ws, ends)) for x in (dealt, far)]
    return out


def between(true: np.ndarray, false: np.ndarray, lost: float, part: float) -> float:
    """A threshold between the measures of false and of true texts (at `part` of the way), which at most a share of `lost` of
    the true ones miss."""
    if not len(true):
        return 0.0
    low = float(np.quantile(true, min(1.0, lost), method="lower"))
    high = float(np.quantile(false, 0.99)) if len(false) else 0.0
    return min(low, high + part * (low - high))


def train(texts: list[str], labels: list[str], buckets: int = 1 << 17, dims: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7, lost: float = 0.004, smooth: float = 0.01) -> LanguageModel:
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    if not languages:
        return LanguageModel([], np.zeros((1, dims), dtype=np.float32), np.zeros((dims, 0)), np.zeros(0), np.zeros(1))
    model = LanguageModel(
        languages, (rng.random((buckets, dims)) / dims - 0.5 / dims).astype(np.float32), rng.normal(0, 0.1, (dims, len(languages))), np.zeros(len(languages)),
        np.zeros(buckets), least_score=np.zeros(len(languages)), least_met=np.zeros(len(languages)),
    )
    feats, ys, known = [], [], []
    for t, y in zip(texts, labels):
        ws = WORD.findall((t or "").lower())
        if ws:
            uniq: dict[str, int] = {}
            for w in ws:
                uniq[w] = uniq.get(w, 0) + 1
            ids, owner = word_features(list(uniq), buckets)
            times = np.fromiter(uniq.values(), dtype=np.float64, count=len(uniq))[owner]
            u, inv = np.unique(ids, return_inverse=True)
            w8 = np.bincount(inv, weights=times)
            feats.append((u, (w8 / w8.sum()).astype(np.float32)))
            ys.append(languages.index(y))
            known.append(t)
    calib = [i for i in range(len(feats)) if i % 5 == 4]
    fit = [i for i in range(len(feats)) if i % 5 != 4] or calib
    steps, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, w8 = feats[i]
            lr = rate * (1 - steps / total)
            v = w8 @ model.embed[ids]
            z = v @ model.out + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[ys[i]] -= 1
            grad = model.out @ p
            model.out -= lr * np.outer(v, p)
            model.bias -= lr * p
            # Each feature takes a step of its own weight; the scale keeps steps alike for short and long texts.
            model.embed[ids] -= (lr * np.minimum(1.0, w8 * len(ids))[:, None] * grad[None, :]).astype(np.float32)
            steps += 1
    for i in fit:
        model.met[feats[i][0]] = 1
    model.name = model.digest()
    if calib:
        v = np.array([feats[i][1] @ model.embed[feats[i][0]] for i in calib], dtype=np.float64)
        target = np.full((len(calib), len(languages)), smooth / len(languages))
        target[np.arange(len(calib)), [ys[i] for i in calib]] += 1 - smooth
        grid = np.geomspace(0.01, 50, 120)
        losses = []
        for t in grid:
            model.temperature = float(t)
            losses.append(-(target * np.log(np.maximum(model.probabilities(v), 1e-300))).sum(axis=1).mean())
        model.temperature = float(grid[int(np.argmin(losses))])
        model.calibrate([known[i] for i in calib], np.array([ys[i] for i in calib]), rng, lost)
    return model


def fit(docs: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, train_chars: int = 20_000, max_languages: int = 400, max_chars: int = 64_000_000, **more) -> LanguageModel:
    """Train on a bounded sample: `per_language` rows of each language (at most `max_languages`), each of at most `train_chars`,
    and so few of each that the sample is expected to hold at most `max_chars` characters in all."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= train_chars) & (F.lit(True) if usable is None else usable))
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.avg(F.length("text")).alias("chars")).orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return train([], [])
    each = max(1, min(per_language, int(max_chars / max(1.0, sum(r["chars"] for r in counts)))))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["count"])))])
    sample = rows.where(uniform("doc_id", 101) < F.try_element_at(share, F.col("lang"))).limit(2 * each * len(counts)).collect()
    sample.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    texts, langs = [r["text"] for r in sample], [r["lang"] for r in sample]
    del sample
    model = train(texts, langs, **more)
    del texts, langs
    trim()
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, reject = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(reject)], schema=schema)
        trim()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, reject = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array(~reject))
        trim()

    return spread(docs).mapInArrow(run, docs.schema)
