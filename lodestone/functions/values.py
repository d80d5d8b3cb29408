"""Numbers, money, hashes, dates and geometry."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_MASK = (1 << 53) - 1
SMALLINT_MAX = 32767
THOUSAND_PRICE_MAX, THOUSAND_M2 = 1e8, (5.0, 2000.0)
K1, B = 1.2, 0.75


def positive(c: Column) -> Column:
    """Finite numbers above zero; all else is null."""
    return F.when((c > 0) & (c < float("inf")) & ~F.isnan(c), c)


def parse_price(c: Column) -> Column:
    """Text to a positive number. The pattern guards against suffixes that casts accept, like 5d."""
    plain = F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(c))
    return positive(plain.try_cast("double"))


def fix_thousand(price: Column, area: Column, deal: Column) -> tuple[Column, Column]:
    """(price, fixed): sale prices under 1e8 were entered in thousands if that gives a plausible price per m2; else they are null."""
    low = (deal == "sale") & (price < THOUSAND_PRICE_MAX)
    ok = F.coalesce(F.try_divide(price * 1000, area * F.lit(1e6)).between(*THOUSAND_M2), F.lit(False))
    low = F.coalesce(low, F.lit(False))
    return F.when(low & ok, price * 1000).when(low, None).otherwise(price), low & ok


def small_int(c: Column) -> Column:
    return F.when(c <= SMALLINT_MAX, F.bround(c)).cast("smallint")


@F.pandas_udf(T.LongType())
def listing_id(norm_name: pd.Series, norm_desc: pd.Series) -> pd.Series:
    """blake2b-8 of name and description, masked to 53 bits."""
    key = lambda n, d: int.from_bytes(hashlib.blake2b(f"{n}\x1f{d}".encode(), digest_size=8).digest(), "big") & ID_MASK
    return pd.Series([key(n, d) for n, d in zip(norm_name, norm_desc)], dtype="int64")


@F.pandas_udf(T.LongType())
def check_hash(norm_name: pd.Series, norm_desc: pd.Series) -> pd.Series:
    """A second, personalised hash, for finding collisions of the first."""
    key = lambda n, d: int.from_bytes(hashlib.blake2b(f"{n}\x1f{d}".encode(), digest_size=8, person=b"check").digest(), "big") >> 1
    return pd.Series([key(n, d) for n, d in zip(norm_name, norm_desc)], dtype="int64")


@F.pandas_udf(T.LongType())
def prefix_key(joined: pd.Series) -> pd.Series:
    """Hash of the first 300 characters of normalised name|description."""
    return joined.map(lambda t: int.from_bytes(hashlib.blake2b(t[:300].encode(), digest_size=8).digest(), "big") >> 1).astype("int64")


def sql_key(c: Column) -> Column:
    """A 60-bit key from built-in functions only, for plans that must stay in the JVM."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _finish(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Characters of whole texts that simhash() takes apart at once; a longer text is taken by itself.
AT_ONCE = 1 << 20


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64-bit SimHash over three-word shingles of normalised text (one shingle below three words); null without a word.

    A bit is set if more shingles have it than not; ties give 0. A batch is worked on in parts of bounded size.
    """
    sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // AT_ONCE
    ends = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)] if len(texts) else [0, 0]
    return pd.concat([simhash_of(texts.iloc[x:y]) for x, y in zip(ends, ends[1:])], ignore_index=True)


def simhash_of(texts: pd.Series) -> pd.Series:
    """The hashes of a part. Its distinct words are hashed once, and shingles and votes are made for the part as a whole."""
    found = [re.findall(r"\w+", t or "") for t in texts]
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in found for w in ws), dtype=np.int64)
    names = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in number), dtype=np.uint64, count=len(number))
    h, size = names[ids], np.array([len(ws) for ws in found], dtype=np.int64)
    last = np.repeat(np.cumsum(size), size)
    left = last - np.arange(len(h))  # words of the text from here on
    s = np.zeros(len(h), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(3):
            shifted = np.append(h[k:], np.zeros(min(k, len(h)), dtype=np.uint64))[: len(h)]
            s = np.where(left > k, _finish(s * np.uint64(0x9E3779B97F4A7C15) + shifted), s)
    owner = np.repeat(np.arange(len(found)), size)
    starts = (left >= 3) | (left == np.repeat(size, size))  # a shorter text is one shingle
    s, owner = s[starts], owner[starts]
    n = np.bincount(owner, minlength=len(found))
    ones = np.zeros((len(found), 64), dtype=np.int64)
    for a in range(0, len(s), 1 << 18):
        part, of = s[a : a + (1 << 18)], owner[a : a + (1 << 18)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    votes = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.int64).ravel() if len(found) else np.zeros(0, dtype=np.int64)
    return pd.Series(votes, dtype="Int64").where(n > 0, pd.NA)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bm25_weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def point_id(listing: Column, chunk: Column) -> Column:
    return listing * 64 + chunk


def unpack_point(c: Column) -> tuple[Column, Column]:
    return F.floor(c / 64), F.pmod(c, F.lit(64))


def verdict(asking: Column, low: Column, high: Column) -> Column:
    return F.when(asking.isNull() | low.isNull() | high.isNull(), None).when(asking < low, "below_market").when(asking > high, "above_market").otherwise("fair")


def chunk_count(length: Column, size: int, overlap: int) -> Column:
    return F.when(length > size, F.ceil((length - overlap) / (size - overlap))).otherwise(1).cast("bigint")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_index(m: Column, year0: int = 2025, month0: int = 6) -> Column:
    return (F.substring(m, 1, 4).cast("int") - year0) * 12 + F.substring(m, 6, 2).cast("int") - month0


#: How spoken amounts are written, a number and its unit; the rest may follow billions, with or without a unit.
NUMBER = r"(\d+(?:[.,]\d+)*)"
UNITS = {
    "billion": r"(?U)" + NUMBER + r"\s*(?:tỷ|tỉ|ty)(?!\w)(?:\s*(\d+)\s*(triệu|tr)?(?!\w))?",
    "million": r"(?U)" + NUMBER + r"\s*(?:triệu|tr)(?!\w)",
    "thousand": r"(?U)" + NUMBER + r"\s*(?:nghìn|ngàn|k)(?!\w)",
    "none": r"(?U)" + NUMBER,
}


def money_million(c: Column) -> Column:
    """Spoken amounts to millions: `5 tỷ` 5000, `1 tỷ 2` 1200, `2 tỷ 05` 2050, `1 tỷ 50 triệu` 1050, `500k` 0.5; no digit: null."""
    text = F.trim(F.lower(c))
    part = lambda unit, k: F.nullif(F.regexp_extract(text, UNITS[unit], k), F.lit(""))
    value = {unit: spoken_number(part(unit, 1)) for unit in UNITS}
    more = part("billion", 2)
    rest = F.when(part("billion", 3).isNotNull(), more.try_cast("double")).when(F.length(more) <= 3, F.rpad(more, 3, "0").try_cast("double")).otherwise(0.0)
    bare = F.when(value["none"] >= 1e6, value["none"] / 1e6).otherwise(value["none"])
    return F.coalesce(value["billion"] * 1000 + F.coalesce(rest, F.lit(0.0)), value["million"], value["thousand"] / 1000, bare)


def spoken_number(c: Column) -> Column:
    """8,5 is 8.5; two or more groups of three digits are thousands."""
    groups = c.rlike(r"^\d+([.,]\d{3}){2,}$")
    two = F.regexp_extract(c, r"^(\d+)(?:[.,](\d+))?", 2)
    head = F.regexp_extract(c, r"^(\d+)", 1)
    return F.when(groups, F.regexp_replace(c, "[.,]", "")).when(two != "", F.concat(head, F.lit("."), two)).otherwise(head).try_cast("double")


def answer_number(c: Column) -> Column:
    """Groups of three behind every mark are thousands; one mark with another number of digits is a decimal; else null."""
    return (
        F.when(c.rlike(r"^\d+$"), c)
        .when(c.rlike(r"^\d+([.,]\d{3})+$"), F.regexp_replace(c, "[.,]", ""))
        .when(c.rlike(r"^\d+[.,]\d+$"), F.regexp_replace(c, ",", "."))
        .try_cast("double")
    )


def answer_numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)*)"), 1)
    return F.filter(F.transform(found, answer_number), lambda x: x.isNotNull())


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of array<array<double>>."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.element_at(ring, i), 1) * F.element_at(F.element_at(ring, F.pmod(i, n) + 1), 2) - F.element_at(F.element_at(ring, F.pmod(i, n) + 1), 1) * F.element_at(F.element_at(ring, i), 2))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.element_at(ring, i), F.element_at(ring, F.pmod(i, n) + 1)
        ax, ay, bx, by = F.element_at(a, 1), F.element_at(a, 2), F.element_at(b, 1), F.element_at(b, 2)
        return ((ay > y) != (by > y)) & (x < F.try_divide((bx - ax) * (y - ay), by - ay) + ax)

    hits = F.filter(F.sequence(F.lit(1), n), lambda i: F.coalesce(crosses(i), F.lit(False)))
    return F.size(hits) % 2 == 1
