"""Learnt units against plain counts, and cuts against all ways to cut."""

import itertools
import math
import random
from collections import Counter

import pytest

from lodestone.operators import segment

TEXTS = ["Căn hộ cao cấp, trường học gần chợ.", "bán căn  hộ gần trường học", "trường học mới; căn hộ", "học sinh đến trường", None, "", "!!! ...", "gần căn hộ, gần trường học, gần chợ", "A_b 12 ² Ünï"]


def plain_runs(text):
    import regex

    return [regex.split(" +", r) for r in regex.findall(r"[\p{L}\p{N}_]+(?: +[\p{L}\p{N}_]+)*", (text or "").lower())]


def test_counts_equal_plain_ones(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    want = Counter(" ".join(r[i : i + n]) for t in TEXTS for r in plain_runs(t) for n in (1, 2, 3) for i in range(len(r) - n + 1))
    counts = segment.run_counts(df, "text")
    assert {r["unit"]: r["count"] for r in counts.collect()} == dict(want)
    assert all(r["n"] == r["unit"].count(" ") + 1 for r in counts.collect())
    total = sum(c for u, c in want.items() if " " not in u)
    units = {r["unit"]: r["score"] for r in segment.learnt_units(counts, 2, 1.0).collect()}
    for u, c in want.items():
        parts = u.split(" ")
        score = min((math.log(c * total / (want[" ".join(parts[:i])] * want[" ".join(parts[i:])])) for i in range(1, len(parts))), default=0.0)
        assert (u in units) == (c >= 2 and (len(parts) == 1 or score >= 1.0)), u
        if u in units:
            assert units[u] == pytest.approx(score)
    assert "căn hộ" in units and "trường học" in units
    assert segment.learnt_units(counts, 2, 1.0, most=3).count() == 3


def test_all_units_are_learnt_and_the_model_is_bounded(spark):
    counts = spark.range(segment.MAX_UNITS + 7).selectExpr("concat('s', id) AS unit", "1 AS n", "id + 5 AS count")
    assert segment.learnt_units(counts).count() == segment.MAX_UNITS + 7
    model = segment.load_model(segment.learnt_units(counts.limit(50)), most=3)
    assert len(model.share) == 3


def test_blocks_of_texts_add_up(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in TEXTS * 4], "text string").coalesce(1)
    whole = {tuple(r) for r in segment.run_counts(df, "text").collect()}
    monkeypatch.setattr(segment, "CHUNK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert {tuple(r) for r in segment.run_counts(df, "text").collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def every_cut(model, syllables):
    best = None
    for marks in itertools.product([0, 1], repeat=len(syllables) - 1):
        sizes, at = [], 0
        for i, m in enumerate((*marks, 1), 1):
            if m:
                sizes.append(i - at)
                at = i
        at, score = 0, 0.0
        for size in sizes:
            unit = " ".join(syllables[at : at + size])
            score += (model.share.get(unit, model.unknown if size == 1 else -math.inf)) if size <= model.longest else -math.inf
            at += size
        best = score if best is None or score > best else best
    return best


def test_cuts_are_the_likeliest():
    rng = random.Random(3)
    letters = "abcd"
    units = {" ".join(rng.choice(letters) for _ in range(n)): rng.uniform(-9, -1) for n in (1, 1, 2, 2, 2, 2, 3, 3, 3, 3) for _ in range(2)}
    model = segment.Model(units, -12.0, 3)
    for _ in range(200):
        s = [rng.choice(letters + "e") for _ in range(rng.randint(1, 9))]
        sizes, at, score = model.cut(s), 0, 0.0
        assert sum(sizes) == len(s)
        for size in sizes:
            score += model.share.get(" ".join(s[at : at + size]), model.unknown)
            at += size
        assert score == pytest.approx(every_cut(model, s))


def test_every_character_is_kept(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id long, text string")
    model = segment.load_model(segment.learnt_units(segment.run_counts(df, "text"), 3, 0.5))
    for r in segment.with_segments(df, model).collect():
        if r["text"] is None:
            assert r["segmented"] is None and r["units"] is None
            continue
        assert len(r["segmented"]) == len(r["text"]) and all(a == b or (a == "_" and b == " ") for a, b in zip(r["segmented"], r["text"]))
        assert "".join(r["units"]).replace("_", "") == "".join(segment.PY_SYLLABLE.findall(r["text"].lower())).replace("_", "")
    assert "Căn_hộ" in segment.segmented(model, "Căn hộ")[0] and segment.segmented(model, "căn, hộ")[1] == ["căn", "hộ"]
    empty = segment.load_model(segment.learnt_units(segment.run_counts(df.limit(0), "text")))
    assert segment.segmented(empty, "a b")[1] == ["a", "b"]
