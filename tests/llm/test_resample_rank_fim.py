"""Importance resampling, encoding by ranks and fill-in-the-middle against brute force, round trips and the libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import fim, pieces, rank_bpe, resample
from lodestone.llm.queries import QUERIES, split_pattern, vocabulary
from test_corpus import ODD, odd, texts  # noqa: F401

SF = "/root/testdata/sf0.001"
RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode("utf-8")).hexdigest()


def hashed(seed, doc_id, group=0):
    return int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[8 * group : 8 * group + 8], 16)


# Resampling


def brute_features(text, order=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode("utf-8")) % 10000
    counts = lambda texts_: Counter(bucket(f) for t in texts_ for f in brute_features(t)[1])
    s, t = counts(x for _, x in rows), counts(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, x in rows:
        words, features = brute_features(x)
        weight = sum(gain[bucket(f)] for f in features)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((hashed(42, i) + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def test_resampling_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op11_importance"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_resample(list(texts(spark).items()), target)) and any(r[4] for r in got)
    assert {tuple(r) for r in resample.resample(docs.repartition(7), spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank").collect()} == set(got)


def test_resampling_odd_rows(spark, odd, monkeypatch):  # noqa: F811
    """Nulls, repeated rows, texts longer than a part, an empty table and an empty target."""
    monkeypatch.setattr(resample, "PART", 1000)
    target = spark.createDataFrame([(1, "the cat sat und weit"), (2, None)], "item_id long, text string")
    got = resample.resample(odd, target, percent=50, least_words=2).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute_resample(ODD, ["the cat sat und weit", None], 50, 2)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sorted(r["rank"] for r in got if r["rank"]) == sorted(r[4] for r in want if r[4])
    assert {(r["doc_id"], r["rank"]) for r in got if r["doc_id"] not in (8, None)} == {(r[0], r[4]) for r in want if r[0] not in (8, None)}
    assert resample.resample(odd.limit(0), target).count() == 0
    assert resample.resample(odd, target.limit(0)).where("rank IS NOT NULL").count() == 0


def test_long_texts_are_counted_like_short_ones():
    rng = random.Random(3)
    t = " ".join("".join(rng.choice("abcdé日") for _ in range(rng.randint(1, 9))) for _ in range(3000)) + " " + "z" * 5000
    whole = resample.csr([t], 10000, 3)
    before, resample.PART = resample.PART, 777
    try:
        cut = resample.csr(["a b", t, "", "c"], 10000, 3)
    finally:
        resample.PART = before
    a, b = cut[0][1], cut[0][2]
    assert cut[1][a:b].tolist() == whole[1].tolist() and cut[2][a:b].tolist() == whole[2].tolist()
    assert cut[3].tolist() == [2, whole[3][0], 0, 1] and cut[4].tolist() == [3, whole[4][0], 0, 1]


def test_crc_of_runs_comes_from_their_words():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcxyz019") for _ in range(rng.choice([1, 2, 3, 9, 40, 300]))) for _ in range(400)]
    table = resample.Words()
    runs = table.runs(table.numbers(words), np.zeros(len(words), dtype=np.int64), 4)
    for n, (crc, _) in enumerate(runs, 1):
        assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


def test_hot_ids_are_ranked_in_order(spark):
    """One id for a third of the rows: ranks stay whole and follow the scores."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "50L AS n_words", "if(id % 3 = 0, 5L, id % 40) AS score")
    got = resample.ranked(rows, 40, 20).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1201)) and [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got)


# Ranks


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=rank_bpe.read_ranks(RANKS), special_tokens={})


def test_rank_digests_equal_library(spark, odd, library):  # noqa: F811
    def want(i, t):
        ids = library.encode_ordinary(t or "")
        return i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode_bytes(ids))

    got = [tuple(r) for r in QUERIES["op12_rank_bpe"](spark, SF).collect()]
    assert sorted(got) == sorted(want(i, t) for i, t in texts(spark).items())
    assert all(d == sha(t or "") for (_, _, _, d), t in zip(sorted(got), [t for _, t in sorted(texts(spark).items())]))
    got = [tuple(r) for r in rank_bpe.digests(odd, RANKS, split_pattern()).collect()]
    assert sorted(got, key=repr) == sorted((want(i, t) for i, t in ODD), key=repr)
    assert rank_bpe.digests(odd.limit(0), RANKS, split_pattern()).count() == 0


def test_rank_round_trip(spark, odd):  # noqa: F811
    ids = rank_bpe.encode(odd, RANKS, split_pattern())
    got = [(r["doc_id"], bytes(r["data"])) for r in rank_bpe.decode(ids, RANKS, split_pattern()).collect()]
    assert sorted(got, key=repr) == sorted(((i, (t or "").encode()) for i, t in ODD), key=repr)
    half = spark.createDataFrame([(1, [int(library_id)]) for library_id in [0]] + [(2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["data"]) for r in rank_bpe.decode(half, RANKS, split_pattern()).collect()}[2] == b""


def test_parts_give_the_ids_of_the_whole(library, monkeypatch):
    enc, rng = rank_bpe.Ranks(RANKS, split_pattern()), random.Random(8)
    monkeypatch.setattr(rank_bpe, "LONG", 10)
    monkeypatch.setattr(rank_bpe, "RUN", re.compile(f"[{rank_bpe.BLANK}]{{6,}}"))
    parts = ["a", "B", " ", "  ", "\n", "\r\n", "\x1c", "\x85", " ", "​", "'s", "'", "’", "é", "é", "日", "本。", "カ", "1", "²", "!", ",", ".", "      ", "        ", "<|endoftext|>", "the", "😀", "'ll", "، ", "ß", "\xa0"]
    cut = 0
    for k in range(3000):
        some = parts if k % 2 else rng.sample(parts, 4)
        t = "".join(rng.choice(some) for _ in range(rng.randint(11, 120)))
        size = rng.choice([1, 3, 9])
        monkeypatch.setattr(rank_bpe.safe_parts, "__defaults__", (size,))
        cut += len(rank_bpe.safe_parts(t, 0, len(t))) > 1
        assert enc.encode(t).tolist() == library.encode_ordinary(t), repr(t)
    assert cut > 1500


def test_runs_of_blanks_that_overflow_the_library(library):
    enc = rank_bpe.Ranks(RANKS, split_pattern())
    for t in ("x" + " " * 3_000_000 + "y", "\n" * 2_000_000):
        assert (library.decode_bytes(enc.encode(t).tolist()).decode() == t) is True
    short = "x" + " " * 70_000 + "y z" + "\n" * 70_000
    assert enc.encode(short).tolist() == library.encode_ordinary(short)


# Fill in the middle


def brute_fim(i, t, marks=("<P>", "<S>", "<M>"), fim_percent=90, spm_percent=20, seed=1):
    t = t or ""
    h, n = [hashed(seed, i, k) for k in range(4)], len(t)
    if not t or any(m in t for m in marks) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = marks
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, s + t[b:] + p + t[:a] + m + t[a:b]
    return n, "psm", a, b - a, p + t[:a] + s + t[b:] + m + t[a:b]


MARKED = [(100, "has <P> in it"), (101, "<S>"), (102, "a<M"), (103, "<P"), (104, "><S<M<P"), (105, "é日😀" * 50)]


def test_fim_equals_brute_force(spark, odd):  # noqa: F811
    rows = ODD + MARKED + [(1000 + k, "日本 é😀ab"[: k % 9]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.transform(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *brute_fim(i, t)) for i, t in rows), key=repr)
    back = fim.restore(fim.transform(docs)).collect()
    assert sorted((tuple(r) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    want = [(i, *w[:4], sha(w[4]), sha(t or "")) for i, t in ODD for w in [brute_fim(i, t)]]
    assert sorted((tuple(r) for r in fim.digests(odd).collect()), key=repr) == sorted(want, key=repr)
    assert fim.transform(odd.limit(0)).count() == 0
    assert {w[1] for _, *w in [(i, *brute_fim(i, t)) for i, t in rows]} == {"plain", "psm", "spm"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("<>PSM \n")), max_size=30), min_size=1, max_size=8), st.integers(0, 2**32 - 1), st.sampled_from(["character", "word", "line"]))
def test_fim_parts_come_back(rows, seed, unit):
    rng, rule = np.random.default_rng(seed), fim.Rule(95, 50, unit)
    cut = fim.transformed(pa.array(rows), [rng.integers(0, 1 << 32, len(rows)) for _ in range(4)], rule)
    raw, ends = fim.restored(fim.strings(cut.raw, cut.ends), cut.form, rule)
    assert fim.strings(raw, ends).to_pylist() == rows
    size = {"character": len, "word": lambda t: len(re.findall("[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+", t)), "line": lambda t: len(re.findall("[^\n]*\n|[^\n]+", t))}[unit]
    assert cut.n.tolist() == [size(t) for t in rows]


def test_fim_long_parts_are_copied_as_slices(monkeypatch):
    rows = ["日é" * 30000, "", "a" * 100, "<P>" * 20000]
    draws = [np.array([5, 5, 5, 5]), np.array([40000, 3, 60, 9]), np.zeros(4, dtype=np.int64), np.array([0, 0, 50, 0])]
    cut = fim.transformed(pa.array(rows), draws, fim.Rule())
    assert fim.strings(*fim.restored(fim.strings(cut.raw, cut.ends), cut.form, fim.Rule())).to_pylist() == rows
    monkeypatch.setattr(fim, "LONG_SEGMENT", 1 << 40)
    same = fim.transformed(pa.array(rows), draws, fim.Rule())
    assert same.raw.tobytes() == cut.raw.tobytes() and same.ends.tolist() == cut.ends.tolist()


def test_marks_must_not_overlap():
    for marks in (("<P>", "<S>", ""), ("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("a", "ba", "z")):
        with pytest.raises(ValueError):
            fim.Rule(marks=marks)


# Pieces of the word vocabulary


def test_every_letter_of_the_alphabet_in_both_cases():
    from tokenizers import Tokenizer

    rng = random.Random(9)
    letters = [chr(c) for c in range(1, 0x250)] + [chr(c) for c in range(0x2010, 0x205F)] + ["€"]
    letters += sorted({x for c in letters for x in (c.upper(), c.lower(), c.title())} - set(letters))
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        path = vocabulary(name)
        enc, tok = pieces.PieceEncoder(path, kind), Tokenizer.from_file(path)
        cases = [f"a{c}b {c} {c}{c}x1" for c in letters] + ["ƏLI", "ƆKYEAME", "Ɓa Ɖe ƐFƆ"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(4000)]
        for t in cases:
            assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, (name, t)
