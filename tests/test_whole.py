"""Queries that must take all rows, against brute force."""

import hashlib
import re

import numpy as np
import pytest

from compare import connection
from lodestone.plans import analytics, cells, checks, extras, relational  # noqa: F401
from lodestone.plans.registry import QUERIES


def test_bootstrap_takes_all_labels(spark, tmp_path):
    y = [0] * 1000 + [1] * 2000 + [None] * 5
    spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    r = QUERIES["c24_bootstrap_interval"](spark, str(tmp_path)).first()
    x = np.array(y[:3000], dtype=float)
    rng = np.random.default_rng(1)
    low, high = np.percentile([x[rng.integers(0, 3000, 3000)].mean() for _ in range(4000)], [2.5, 97.5])
    assert r["n"] == 3000 and abs(r["mean"] - 2 / 3) < 1e-9
    assert abs(r["low"] - low) < 0.002 and abs(r["high"] - high) < 0.002
    c = QUERIES["c24_bootstrap"](spark, str(tmp_path)).first()
    assert (c["n"], c["mean"], c["near_normal"]) == (3000, 0.666667, True)


def test_cleaning_takes_all_documents(spark, tmp_path):
    odd = ["Grüße\x00\x1f an é@müller.de, Tel. 0912 345 678", "", None, "\x07", "plain\x7f a.b@c.org +84-912-345-678\u2028x\x85y", " 1 0912345678 日本 "]
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(-1 - i, t) for i, t in enumerate(odd)] + [tuple(r) for r in sf]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    phone, email = re.compile(r"(?<![0-9])(?:\+?84|0)(?:[ \t-\r.\-]?[0-9]){8,10}(?![0-9])"), re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+")
    cleaned = lambda t: re.sub("[\x00-\x1f\x7f\x85\u2028\u2029]+", " ", t).strip(" ") or None
    masked = lambda t: email.sub("[email]", phone.sub("[phone_number]", t))
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    for name, f in (("x11_clean_controls", cleaned), ("x09_mask_pii", masked)):
        got = {r["doc_id"]: r["h"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {i: None if t is None else md5(f(t)) for i, t in rows}


@pytest.mark.parametrize("name, table", [("x12_listing_header", "lineitem"), ("x32_small_int", "lineitem"), ("f25_cards", "lineitem"), ("t10_required_union", "documents"), ("x17_hit_cards", "lineitem"), ("s13_declared_schema", "orders")])
def test_takes_all_rows(spark, name, table):
    con = connection("/root/testdata/sf0.001")
    n = con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == n


def test_chunks_take_whole_texts(spark, tmp_path):
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate((0, 1, 400, 401, 700, 701, 30_000))] + [((1 << 60) + 1, "a b"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, t in rows:
        w = (t or "").split()
        starts = [0] + list(range(300, max(0, len(w) - 100), 300))
        want |= {(i * 2**31 + k, k, hashlib.md5(" ".join(w[a : a + 400]).encode()).hexdigest(), len(w[a : a + 400])) for k, a in enumerate(starts)}
    got = [(int(r["point_id"]), r["chunk_index"], r["h"], r["n_tokens"]) for r in QUERIES["c01_chunks"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) > 100 and set(got) == want
