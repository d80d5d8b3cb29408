"""Bootstrap with counter-based weights against the same weights row by row, and resolving many names against one by one."""

from math import exp

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import names, resampling


def plain_weight(ident, boot, seed):
    mask = (1 << 64) - 1
    z = (ident * resampling.STEPS[0] + boot * resampling.STEPS[1] + seed * resampling.STEPS[2]) & mask
    z = ((z ^ (z >> 30)) * resampling.MIX[0]) & mask
    z = ((z ^ (z >> 27)) * resampling.MIX[1]) & mask
    return sum((z ^ (z >> 31)) >> 11 >= t for t in resampling.DRAWS)


def test_weights_are_poisson_draws_of_the_counter():
    ids = np.array([0, 1, -5, 1 << 62, 77])
    assert resampling.weights(ids, 30, 9).tolist() == [[plain_weight(int(i), b, 9) for b in range(30)] for i in ids]
    w = resampling.weights(np.arange(20000), 20, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - exp(-1)) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.03


@pytest.mark.parametrize("planted", [0.2, -0.3, 0.0])
def test_paired_test_equals_brute_force(spark, planted):
    rng = np.random.default_rng(3)
    a = rng.normal(size=300)
    b = a - planted + (rng.normal(size=300) * 0.5 if planted else 0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))] + [(900, None, 1.0), (901, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = resampling.paired_test(df.repartition(5), "id", "a", "b", 200, 4).first()
    w = np.array([[plain_weight(i, k, 4) for k in range(200)] for i in range(300)], dtype=float)
    means = (w.T @ (a - b)) / w.sum(axis=0)
    p = 1.0 if not planted else ((means <= 0) if planted > 0 else (means >= 0)).mean()
    assert got["n"] == 300 and got["diff"] == pytest.approx((a - b).mean(), abs=1e-9)
    assert [got["low"], got["high"]] == pytest.approx(np.quantile(means, [0.025, 0.975]).tolist(), abs=1e-9) and got["p_value"] == pytest.approx(p)
    if planted:
        assert got["low"] < planted < got["high"] and got["p_value"] < 0.01
    again = resampling.paired_differences(df, "id", "a", "b", 200, 4).join(resampling.paired_differences(df.repartition(3), "id", "a", "b", 200, 4).toDF("boot", "other"), "boot")
    assert again.where("abs(diff - other) > 1e-9").isEmpty() and again.count() == 200


def test_empty_and_infinite_values(spark):
    df = spark.createDataFrame([(1, float("inf"), 1.0)], "id long, a double, b double")
    assert tuple(resampling.paired_test(df.limit(0), "id", "a", "b", 10).first()) == (0, None, None, None, None)
    with pytest.raises(Exception, match="finite"):
        resampling.paired_test(df, "id", "a", "b", 10).collect()


VOCAB = [
    ("Vinhomes Grand Park", "Thủ Đức", "Hồ Chí Minh", 50), ("Vinhomes Ocean Park", "Gia Lâm", "Hà Nội", 40), ("Green Park", "Hoàng Mai", "Hà Nội", 9), ("City Garden", "Bình Thạnh", "Hồ Chí Minh", 3),
    ("Chung cư Sunrise City Quận 7", "Quận 7", "Hồ Chí Minh", 30), ("Sunrise City View", "Quận 7", "Hồ Chí Minh", 7), ("Masteri", "Thủ Đức", "Hồ Chí Minh", 12), ("Masteri", "Gia Lâm", "Hà Nội", 11), ("Park", "Gia Lâm", "Hà Nội", 2),
]
ASKED = [
    ("Vinhomes", None, None), ("Vinhomes Grand Park, Thủ Đức", None, None), ("park", None, "Hà Nội"), ("dự án Masteri Thảo Điền", None, None), ("Masteri", "Gia Lâm", None), ("Masteri", None, "Hà Nội"),
    ("Sunrise City Quận 7", "Quận 7", "Hồ Chí Minh"), ("chung cư Sunrise City", None, None), ("Green Park Hà Nội", None, None), ("nothing of it", None, None), ("", None, None), (None, None, None),
    ("Hà Nội", None, None), ("The City Garden Tower Hồ Chí Minh", None, None), ("Masteri Gia Lâm Hà Nội", "Gia Lâm", "Hà Nội"), ("Vinhomes", "Gia Lâm", "Hà Nội"),
]


@pytest.mark.parametrize("field", ["project", "street", "district"])
def test_many_names_equal_one_by_one(spark, field):
    rows = spark.createDataFrame([r for r in VOCAB for _ in range(r[3])], "name string, district string, province string, n int").drop("n")
    vocab = names.vocabulary(rows, "name", field=field).persist()
    queries = spark.createDataFrame([(i, *r) for i, r in enumerate(ASKED)], "id long, value string, district string, province string")
    got = names.resolve_all(vocab, queries, field, limit=4).collect()
    for i, (value, district, province) in enumerate(ASKED):
        want = [(r["name"], r["tier"]) for r in names.resolve(vocab, value, district, province, field, limit=4).collect()] if value is not None else []
        mine = sorted((r["rank"], r["name"], r["tier"]) for r in got if r["id"] == i)
        assert [(n, t) for _, n, t in mine] == want, value
    assert got


def test_equal_questions_are_resolved_once(spark, monkeypatch):
    rows = spark.createDataFrame([r for r in VOCAB for _ in range(r[3])], "name string, district string, province string, n int").drop("n")
    asked, made = [("Masteri", None, None), ("Masteri", None, "Hà Nội"), ("park", None, None), ("nothing of it", None, None), (None, None, None)], []
    forms = names.asked_forms
    monkeypatch.setattr(names, "asked_forms", lambda vocab, queries, field: (made.append(queries.count()), forms(vocab, queries, field))[1])
    queries = spark.createDataFrame([(i, *asked[i % 5]) for i in range(400)], "id long, value string, district string, province string")
    got = names.resolve_all(names.vocabulary(rows, "name", field="project"), queries).collect()
    assert made == [5]
    own = [sorted((r["rank"], r["name"], r["tier"]) for r in got if r["id"] == i) for i in range(400)]
    assert all(own[i] == own[i % 5] for i in range(400)) and own[0] and own[1] and own[2] and not own[3] and not own[4]


def test_hot_words_probe_the_rarest(spark):
    vocab = names.vocabulary(spark.range(3000).select(F.concat(F.lit("tower "), F.col("id").cast("string")).alias("name"), F.lit("d").alias("district"), F.lit("p").alias("province")), "name", field="project")
    queries = spark.range(500).select("id", F.concat(F.lit("the tower "), F.col("id").cast("string")).alias("value"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("province"))
    got = names.resolve_all(vocab, queries).collect()
    # Names 1, 2 and 3 are made of words that name no project by themselves.
    assert {(r["id"], r["name"]) for r in got} == {(i, f"tower {i}") for i in range(500) if i not in (1, 2, 3)}
