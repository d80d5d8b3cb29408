"""The sharded text index against scores computed one by one."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, text_index
from lodestone.session import scratch

WORDS = ["the", "cat", "sat", "mat", "Über", "straße", "日本", "x1", "rare", "dog_s"]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    out = [(i, " ".join(rng.choices(WORDS, [30, 9, 8, 7, 5, 4, 3, 2, 1, 6], k=rng.randint(0, 40))), rng.choice(["en", "de", None])) for i in range(400)]
    return out + [(1000, None, "en"), (1001, "", "en"), (1002, "!!!", "de"), (1003, out[5][1], "en"), (1004, "cat " * 70000, "en")]


QUERIES = [(1, ["the", "cat"]), (2, ["rare"]), (3, ["über", "straße", "日本", "über"]), (4, ["missing"]), (5, []), (6, None), (7, ["x1", "missing", "dog_s", "mat"]), (None, ["cat"])]


def brute(docs, terms, k, allowed=None):
    toks = {i: re.findall(r"\w+", (t or "").lower()) for i, t, _ in docs}
    mean = sum(map(len, toks.values())) / len(toks)
    counts = {i: Counter(w) for i, w in toks.items()}
    df = Counter(t for c in counts.values() for t in c)
    scores = []
    for i, _, lang in docs:
        s = 0.0
        for t in sorted(set(terms or [])):
            if tf := min(counts[i][t], 65535):
                s += math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean))
        if s > 0 and (allowed is None or lang in allowed):
            scores.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(scores)[:k]]


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)


@pytest.mark.parametrize(("tokens", "most"), [(1 << 20, 1 << 14), (500, 1 << 14), (1 << 20, 7)])
def test_batches_equal_brute_force(spark, docs, frame, monkeypatch, tokens, most):
    monkeypatch.setattr(text_index, "MAX_TOKENS", tokens)
    monkeypatch.setattr(text_index, "MAX_DOCS", most)
    path = scratch(spark, "index")
    text_index.write_shards(frame, "doc_id", "text", path, ["lang"])
    index = text_index.read_shards(spark, path)
    assert index.documents == len(docs)
    if most == 7:
        assert index.shards.where(F.size("docs") > 7).isEmpty() and index.shards.count() >= len(docs) / 7
    queries = spark.createDataFrame(QUERIES, "q long, terms array<string>")
    for allowed, where, per_pass in ((None, None, 4096), ({"de"}, lambda d: d["lang"] == "de", 2)):
        found = text_index.search_shards(index, queries, 6, where, per_pass).collect()
        for q, terms in QUERIES[:-1]:
            mine = [(r["doc_id"], r["score"]) for r in sorted((r for r in found if r["q"] == q), key=lambda r: r["rank"])]
            want = brute(docs, terms, 6, allowed)
            assert [i for i, _ in mine] == [i for i, _ in want] and [s for _, s in mine] == pytest.approx([s for _, s in want], abs=1e-8)
        assert {r["q"] for r in found} <= {1, 2, 3, 7}


def test_postings_and_frequencies(spark, docs, frame):
    path = scratch(spark, "index")
    text_index.write_shards(frame, "doc_id", "text", path, cap=1000)
    index = text_index.read_shards(spark, path)
    want = {(i, t, min(n, 1000), len(w)) for i, text, _ in docs for w in [re.findall(r"\w+", (text or "").lower())] for t, n in Counter(w).items()}
    assert {tuple(r) for r in text_index.postings(index).collect()} == want
    df = Counter(t for _, t, *_ in want)
    asked = spark.createDataFrame([(t,) for t in [*df, "missing"]], "term string")
    assert {r["term"]: r["df"] for r in text_index.frequencies(index, asked).collect()} == dict(df)


def test_row_groups_of_shards_are_bounded(spark, docs, frame, tmp_path, monkeypatch):
    """A row group ends with the shard that fills it, not after 100 shards; weights are those of the postings."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(text_index, "MAX_DOCS", 7)
    monkeypatch.setattr(text_index, "ROW_GROUP", 1)
    path = str(tmp_path / "index")
    text_index.write_shards(frame.coalesce(1), "doc_id", "text", path)
    metas = [pq.read_metadata(str(f)) for f in (tmp_path / "index" / "shards").glob("*.parquet")]
    assert sum(m.num_rows for m in metas) > 50
    assert max(m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)) <= 2
    index = text_index.read_shards(spark, path)
    toks = {i: re.findall(r"\w+", (t or "").lower()) for i, t, _ in docs}
    mean = sum(map(len, toks.values())) / len(toks)
    want = {i: sum(min(n, 65535) * 2.2 / (min(n, 65535) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for n in Counter(w).values()) for i, w in toks.items() if w}
    assert {r["doc_id"]: r["weight"] for r in text_index.weights_of(index).collect()} == pytest.approx(want)


def test_queries_that_cannot_win_are_skipped(spark, monkeypatch):
    """The second shard's best possible score is below the first one's k-th."""
    docs = spark.createDataFrame([(i, "cat " * 5) for i in range(50)] + [(100 + i, "cat" + " dog" * 400) for i in range(50)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(text_index, "MAX_DOCS", 50)
    path = scratch(spark, "index")
    text_index.write_shards(docs, "doc_id", "text", path)
    found = text_index.search_shards(text_index.read_shards(spark, path), spark.createDataFrame([(1, ["cat"])], "q long, terms array<string>"), 3).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 1, 2]


def test_no_documents_is_an_error(spark):
    with pytest.raises(ValueError):
        text_index.write_shards(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", scratch(spark, "index"))


def test_hybrid_lists_name_a_document_once(spark):
    """Two rankings dealt by query with unlike numbers of partitions."""
    a = search.best_rows(spark.range(4000).selectExpr("id % 20 AS q", "id AS doc_id", "cast(id % 97 as double) AS score"), 20)
    b = search.best_rows(spark.range(400).selectExpr("id % 20 AS q", "id AS doc_id", "cast(id % 89 as double) AS score"), 20)
    got = search.hybrid([a, b], 10, by=("q",)).collect()
    assert len({(r["q"], r["doc_id"]) for r in got}) == len(got) == 200


def test_common_terms_are_only_looked_up(monkeypatch):
    """Later shards score in full the documents that may reach the best k so far, not all that hold a common term."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    lists = [["the"] * rng.randint(1, 9) + rng.choices(WORDS[1:], k=rng.randint(5, 30)) + (["rare2"] if i % 40 == 0 else []) for i in range(1200)]
    mean = sum(map(len, lists)) / len(lists)
    terms = sorted({"the", "rare2", "cat", "mat"})
    asked = [["the", "rare2"], ["cat", "the"], ["the"], ["mat", "rare2", "the"]]
    df = {t: sum(t in x for x in lists) for t in terms}
    idf = {t: math.log(1 + (1200 - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
    queries = [[q for q, x in enumerate(asked) if t in x] for t in terms]
    given = text_index.Asked(pa.array(terms), np.array([idf[t] for t in terms]), np.cumsum([0, *map(len, queries)]), np.concatenate(queries))
    seen, add = [], search.Best.add_some
    monkeypatch.setattr(search.Best, "add_some", lambda self, q, s, i: (seen.append(np.bincount(q, minlength=4)), add(self, q, s, i))[1])
    for cells in (1 << 20, 300):
        monkeypatch.setattr(text_index, "CELLS", cells)
        best, per_shard = search.Best(4, 5), []
        for a in range(0, 1200, 300):
            t, offsets, at, tf = text_index.shard(pa.array(lists[a : a + 300]))
            part = dict(terms=t, offsets=pa.array(offsets), at=pa.array(at), tf=pa.array(tf), id=pa.array(range(a, a + 300)), len=pa.array([len(x) for x in lists[a : a + 300]]), keep=pa.array([i % 3 > 0 for i in range(300)]))
            seen.clear()
            text_index.score_shard(best, part.__getitem__, given, mean)
            per_shard.append(sum(seen, np.zeros(4, dtype=int)))
        for q, own in enumerate(asked):
            want = []
            for i, x in enumerate(lists):
                s = sum(idf[t] * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in sorted(own))
                want += [(-round(s, 9), i)] * (s > 0 and i % 3 > 0)
            assert list(zip((-best.scores[q]).tolist(), best.ids[q].tolist())) == sorted(want)[:5]
        assert per_shard[0][0] == 200 and all(x[0] < 20 for x in per_shard[1:])
