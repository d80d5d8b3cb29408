"""Operators against plain Python on small and odd inputs."""

import math
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import clean, dedup, evaluation, filters, graph, market, names, search, text_index, valuation
from lodestone.sources import io
from lodestone.streaming import events

SF = "/root/testdata/sf0.01"
ODD = ["Hà Nội Paragon (Paragon Tower)", "Đường  Số-5", "ĐÀ NẴNG", "Ngô Thì Nhậm", "cafe\u0301 ỆỂ", "**Giá** đất_7", "Quận 1 District", "", "ÅÑü ß İ", "phố"]


def bare(t):
    t = unicodedata.normalize("NFC", t).lower().replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")


def test_folds_equal_normal_forms(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", X.fold_name("t").alias("n"), X.fold_answer("t").alias("a"), X.fold_area("t").alias("r"))
    for r in df.collect():
        b = bare(r["t"])
        assert r["n"] == " ".join(re.sub(r"[^0-9a-z]+", " ", re.sub(r"\([^)]*\)", " ", b)).split())
        assert r["a"] == " ".join(re.sub(r"[*_#`]", "", b).split())
        assert r["r"] == re.sub(r"[^a-z0-9]", "", re.sub(r"\b(district|city|town)\b", "", b))


def test_simhash_of_a_batch_equals_that_of_single_texts():
    rng = random.Random(3)
    texts = ["", None, "one", "one two", "one two three", "a a a a a a"] + [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 90))) for _ in range(60)]
    whole = V.simhash.func(pd.Series(texts))
    assert whole[:2].isna().all() and whole.tolist()[2:] == [V.simhash.func(pd.Series([t]))[0] for t in texts[2:]]
    assert (V.simhash.func(pd.Series([None, ""])).isna()).all() and len(V.simhash.func(pd.Series([], dtype=object))) == 0


def groups_of(rows, near):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i], rows[j]):
                root[find(i)] = find(j)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return {rows[k][0]: least[find(k)] for k in range(len(rows))}


def test_hash_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for k in range(400):
        h = base[rng.randrange(12)]
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(64)
        rows.append((k, "ab"[k % 2], h - (1 << 64) if h >> 63 else h))
    want = groups_of(rows, lambda a, b: a[1] == b[1] and ((a[2] ^ b[2]) & (1 << 64) - 1).bit_count() <= 3)
    df = spark.createDataFrame(rows, "id long, g string, simhash long")
    for block in (1024, 5):
        assert {r["id"]: r["dup_cluster_id"] for r in dedup.simhash_clusters(df, "id", ["g"], block=block).collect()} == want
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", V.simhash(X.norm(F.col("text"))).alias("simhash"))
    found = [tuple(r) for r in docs.collect()]
    want = groups_of(found, lambda a, b: a[1] == b[1] and a[2] is not None and b[2] is not None and ((a[2] ^ b[2]) & (1 << 64) - 1).bit_count() <= 3)
    assert {r["doc_id"]: r["dup_cluster_id"] for r in dedup.simhash_clusters(docs, "doc_id", ["lang"]).collect()} == want


def test_market_cube_by_ranges_equals_that_by_sorting(spark):
    rng = random.Random(2)
    rows = [("p", "d", f"w{k % 3}", "x" if k % 5 else None, "sale" if k % 7 else "rent", ("A", "B", None)[k % 3], f"2025-0{1 + k % 2}", rng.choice([1.5, 2.0, 2.0, rng.random() * 50]), float(rng.randint(1, 9)), float(k % 4) - 1) for k in range(500)]
    v = spark.createDataFrame(rows, "province string, district string, ward string, project string, deal_type string, property_type string, month string, price_m2_mil double, price_vnd double, area_m2 double")
    a, b = (sorted(map(tuple, market.market_stats(v, split=s).collect()), key=repr) for s in (1 << 40, 0))
    assert len(a) == len(b) > 20
    for x, y in zip(a, b):
        assert x[:6] == y[:6] and x[6:] == pytest.approx(y[6:], abs=1e-9)
    one = [r for r in market.market_stats(v).collect() if r["scope"] == "province" and r["property_type"] == "ALL" and r["month"] == "ALL" and r["deal_type"] == "sale"][0]
    own = [r for r in rows if r[4] == "sale"]
    assert one["n"] == len(own) and one["p25_price_m2_mil"] == pytest.approx(np.quantile([r[7] for r in own], 0.25)) and one["median_area_m2"] == pytest.approx(np.median([r[9] for r in own]))
    assert market.market_stats(v.limit(0)).count() == 0


def test_median_of_all_values(spark):
    rng = random.Random(3)
    for values in ([rng.choice([1.5, -2.0, 0.0, rng.random() * 1e6]) for _ in range(301)], [3.0], [1.0, 2.0], [None], []):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        want = np.median([v for v in values if v is not None]) if any(v is not None for v in values) else None
        assert market.median_of_all(df, "x").first()["median"] == (None if want is None else pytest.approx(want))


def test_simhash_takes_a_batch_in_parts(monkeypatch):
    import pandas as pd
    from lodestone.functions import values

    texts = pd.Series(["one two three four five", None, "", "six", "seven eight nine ten " * 40, "one two three four five"])
    whole = values.simhash.func(texts).tolist()
    sizes, of = [], values.simhash_of
    monkeypatch.setattr(values, "AT_ONCE", 30)
    monkeypatch.setattr(values, "simhash_of", lambda t: sizes.append(len(t)) or of(t))
    assert values.simhash.func(texts).tolist() == whole and len(sizes) > 1 and sum(sizes) == len(texts)
    assert values.simhash.func(texts.iloc[:0]).tolist() == []


def test_rows_of_the_cube_travel_once_for_an_area_that_fits(spark):
    rows = spark.createDataFrame([(1, 5, 7, 1.0), (1, 6, 7, 2.0), (2, 5, 8, 3.0)], "k long, t long, m long, price_m2_mil double")
    assert sorted((r["k"], r["t"], r["c"], r["sets"]) for r in market.carried(rows, 15, None).collect()) == [(1, 5, 0, 15), (1, 6, 0, 15), (2, 5, 0, 15)]
    large = spark.createDataFrame([(1, market.ALL, market.ALL)], "k long, t long, m long")
    bits = sorted((r["k"], r["t"], r["sets"]) for r in market.carried(rows, 15, large).collect())
    assert bits == [(1, 5, 2), (1, 5, 5), (1, 6, 2), (1, 6, 5), (2, 5, 15)]


def test_wanted_groups_equal_those_of_the_whole_cube(spark):
    from lodestone.plans.bindings import view

    v = view(spark, "/root/testdata/sf0.001").persist()
    whole = [r.asDict() for r in market.market_stats(v).collect()]
    for split in (1 << 40, 60, 0):
        some = market.market_stats(v, deals=("sale",), split=split, of=("province", "district"), area=lambda k: k.startswith("A"), by=((False, True),))
        want = {(r["area_key"], r["month"]): r for r in whole if r["scope"] in ("province", "district") and r["area_key"].startswith("A") and r["deal_type"] == "sale" and r["property_type"] == "ALL" and r["month"] != "ALL"}
        got = {(r["area_key"], r["month"]): r.asDict() for r in some.collect()}
        assert got.keys() == want.keys() and len(got) > 5
        assert all(got[k]["n"] == want[k]["n"] and got[k]["median_price_m2_mil"] == pytest.approx(want[k]["median_price_m2_mil"]) for k in got)
        assert {(r["scope"], r["area_key"], r["property_type"], r["month"], r["deal_type"], r["n"]) for r in market.market_stats(v, split=split, measures={}).collect()} == {
            (r["scope"], r["area_key"], r["property_type"], r["month"], r["deal_type"], r["n"]) for r in whole}
    v.unpersist()


def test_names_lose_prefixes_and_places(spark):
    rows = [("Chung cư Sunrise City", "Quận 7", "Hồ Chí Minh", 5), ("Khu đô thị Ecopark Hưng Yên", "Văn Giang", "Hưng Yên", 9), ("The Park", "Quận 1", "Hồ Chí Minh", 2), ("Can ho", "Quận 1", "Hồ Chí Minh", 1)]
    df = spark.createDataFrame([r[:3] for r in rows for _ in range(r[3])], "project string, district string, province string")
    v = names.vocabulary(df, "project")
    assert {r["name"]: r["key"] for r in v.collect()} == {"Chung cư Sunrise City": "sunrise city", "Khu đô thị Ecopark Hưng Yên": "ecopark", "The Park": "the park", "Can ho": "can ho"}
    found = lambda *a, **k: [tuple(r) for r in names.resolve(v, *a, **k).collect()]
    assert found("dự án Ecopark, Văn Giang") == [("Khu đô thị Ecopark Hưng Yên", 0)]
    assert found("chung cư Sunrise City Quận 7", district="Quận 7") == [("Chung cư Sunrise City", 0)]
    assert found("can ho the park view") == []  # words that name no project
    assert found("căn hộ Sunrise City South Towers") == [("Chung cư Sunrise City", 2)]
    assert found("") == [] and len(names.GENERIC) == 30 and names.GENERIC[0] == "city"
    s = names.vocabulary(df.withColumn("street", F.lit("Đường Lê Lợi")), "street")
    assert [tuple(r) for r in names.resolve(s, "phố lê lợi nối dài", field="street").collect()] == []
    assert [tuple(r) for r in names.resolve(s, "lợi", field="street").collect()] == [("Đường Lê Lợi", 1)]
    p = names.vocabulary(df, "district")
    assert [r["name"] for r in names.resolve(p, "quan 1", field="district").collect()] == ["Quận 1"] and names.resolve(p, "quan", field="district").count() == 0


def test_counted_columns_are_the_clean_ones(spark):
    raw = spark.createDataFrame([("a", "b c", "Nhà", "Hà Nội", None, None, "5000000000", float("nan"), None, None, None, None, 2.0, None, None, None, None, None, "2025-06-01", 0, 0), (" a |", "b", "Nhà", "Hà Nội", None, None, "x", 0.0, None, None, None, None, None, None, None, None, None, None, "no", 0, 1)],
        "name string, description string, property_type_name string, province_name string, district_name string, ward_name string, price string, area double, street_name string, project_name string, house_direction string, balcony_direction string, floor_count double, frontage_width double, house_depth double, road_width double, bedroom_count double, bathroom_count double, published_at string, source_shard int, source_row int")
    out = clean.clean_frame(raw).orderBy("source_row").collect()
    # title, description, province, price, floors, date; the not-a-number area and the zero one count as missing.
    assert [r["n_nonnull"] for r in out] == [6, 3] and len(clean.COUNTED) == 18


def test_plan_gate(spark):
    spark.range(3).withColumn("a", F.lit(1)).createOrReplaceTempView("v_listings")
    spark.range(3).createOrReplaceTempView("other")
    assert filters.gated_sql(spark, "WITH x AS (SELECT a, count(*) AS n FROM v_listings GROUP BY a) SELECT * FROM x WHERE n > (SELECT min(id) FROM v_listings)").count() == 1
    for bad in ("SELECT * FROM v_listings JOIN other USING (id)", "SELECT reflect('java.lang.System', 'nanoTime') FROM v_listings", "SELECT * FROM v_listings, parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT id FROM v_listings UNION SELECT id FROM other", "SELECT * FROM v_listings WHERE id IN (SELECT id FROM other)"):
        with pytest.raises(ValueError):
            filters.gated_sql(spark, bad)


def test_batch_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[7], x[9] = x[6], x[6] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [1.0, 2.0]), (303, [float("nan")] * 8), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for others in (False, True):
        for per_pass in (4096, 3):
            got = search.dense_batch(df, df.where("id % 50 = 0"), "id", "v", 5, others=others, per_pass=per_pass)
            mine = {}
            for r in got.collect():
                mine.setdefault(r["q"], []).append((r["rank"], r["doc_id"], r["score"]))
            assert set(mine) == {0, 50, 100, 150, 200, 250}
            for q, found in mine.items():
                s = np.round(unit @ unit[q], 9)
                order = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if not others or i != q][:5]
                assert [f[1] for f in sorted(found)] == order
    assert [r["doc_id"] for r in search.dense_batch(df, df.where("id = 6"), "id", "v", 3).orderBy("rank").collect()] == [6, 7, 9]


def test_index_search_equals_that_of_one_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text_index.write_shards(docs, "doc_id", "text", str(tmp_path / "index"))
    q = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q"), F.slice(X.words(F.col("text")), 1, 6).alias("terms"))
    found = text_index.search_shards(text_index.read_shards(spark, str(tmp_path / "index")), q, 5).collect()
    terms = [r["terms"] for r in q.where("q = 20").collect()][0]
    alone = [(r["doc_id"], round(r["score"], 6)) for r in search.bm25(docs, "doc_id", "text", terms, 5).collect()]
    assert len(found) > 5 and [(r["doc_id"], round(r["score"], 6)) for r in sorted(found, key=lambda r: r["rank"]) if r["q"] == 20] == alone


def test_ranked_metrics_equal_those_of_lists(spark):
    lists = [(1, [9, 1, 5], [1, 5, 7]), (2, [3, 4], [8]), (3, [2], [2])]
    want = {r["q"]: r for r in evaluation.retrieval_metrics(spark.createDataFrame(lists, "q int, ranked array<int>, relevant array<int>")).collect()}
    hits = spark.createDataFrame([(q, k, x in rel) for q, ranked, rel in lists for k, x in enumerate(ranked, 1)], "q int, rank int, hit boolean")
    got = evaluation.ranked_metrics(hits, spark.createDataFrame([(q, len(rel)) for q, _, rel in lists] + [(4, 0)], "q int, n_rel int"), "q").collect()
    for r in got:
        for m in ("recall_5", "recall_10", "mrr", "ndcg_10"):
            assert r[m] is None if r["q"] == 4 else r[m] == pytest.approx(want[r["q"]][m])


def test_dealt_values_are_the_same_values(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    out = valuation.dealt(df, "x", ["id"], 7, 42).collect()
    assert sorted(r["x"] for r in out) == list(range(0, 2000, 2)) and sum(r["x"] == 2 * r["id"] for r in out) < 10


def test_filters_are_blamed_for_systems_that_use_them(spark):
    df = spark.createDataFrame([(s, 0, "x", None, "lookup", "r", "r", "ids", 0.0) for s in ("basic_rag", "hybrid", "graph")], "system string, points int, answer string, error string, category string, route string, route_gold string, gt_kind string, recall_5 double")
    df = df.withColumns({"cypher": F.lit(None).cast("string"), "unsupported": F.array().cast("array<bigint>"), "faithfulness": F.lit(None).cast("double")})
    got = {r["system"]: r["cause"] for r in df.select("system", evaluation.error_cause(F.lit(True)).alias("cause")).collect()}
    assert got == {"basic_rag": "filter_wrong", "hybrid": "filter_wrong", "graph": "retrieval_miss"}


def test_cache_is_built_again_when_its_source_changes(spark, tmp_path):
    source, built = str(tmp_path / "t"), []
    spark.range(3).write.parquet(source)
    build = lambda to: (built.append(to), spark.read.parquet(source).write.parquet(to))
    paths = [io.cached(spark, "c", [source], build) for _ in range(2)]
    spark.range(5).write.mode("overwrite").parquet(source)
    paths.append(io.cached(spark, "c", [source], build))
    assert len(built) == 2 and paths[0] == paths[1] != paths[2] and spark.read.parquet(paths[2]).count() == 5


def test_communities_settle(spark):
    edges = [(a, b) for c in range(3) for a in range(5 * c, 5 * c + 5) for b in range(a + 1, 5 * c + 5)] + [(4, 5), (9, 10)]
    got = {r["node"]: r["community"] for r in graph.label_propagation(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [len({got[k] for k in range(5 * c, 5 * c + 5)}) for c in range(3)] == [1, 1, 1] and len(set(got.values())) == 3
    swing = graph.label_propagation(spark.createDataFrame([(0, 1)], "a long, b long")).collect()
    assert len({r["community"] for r in swing}) == 1
    with pytest.raises(ValueError):
        graph.label_propagation(spark.createDataFrame(edges, "a long, b long"), rounds=1)


def test_principal_components_span_the_space(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 10)) + rng.normal(size=(400, 10)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    out = np.array([r["pca"] for r in valuation.apply_pca(valuation.fit_pca(df, "x", 3), df, "x").orderBy("id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    q, _ = np.linalg.qr(x @ vt[:3].T)
    p, _ = np.linalg.qr(out)
    assert np.linalg.svd(q.T @ p, compute_uv=False).min() > 0.9999


def test_price_model_beats_the_median(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(a), f"t{t}", "2025-06" if k % 5 else "2025-07", float(np.exp(1 + 0.02 * a + 0.4 * t + rng.normal() * 0.1))) for k, (a, t) in enumerate(zip(rng.uniform(10, 90, 1500), rng.integers(0, 3, 1500)))]
    df = spark.createDataFrame(rows, "id long, area double, kind string, month string, price double").withColumn("is_valid", F.col("id") % 10 == 1)
    train, test = df.where("id % 7 <> 0"), df.where("id % 7 = 0")
    model = valuation.fit_price_model(train, "price", ["area"], ["kind"], "is_valid", [dict(maxDepth=4, maxIter=10), dict(maxDepth=2, maxIter=2)])
    out = valuation.predict_price(model, test, ["area"]).select("price", "predicted").collect()
    err = np.mean([abs(r["predicted"] - r["price"]) for r in out])
    base = np.median([r[4] for r in rows])
    assert err < 0.3 * np.mean([abs(base - r["price"]) for r in out]) and not math.isnan(err)


def test_ids_equal_plain_hashes(spark):
    import hashlib

    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    norm = lambda t: " ".join(unicodedata.normalize("NFC", t or "").split()).lower()
    plain = [t for t in rows if t is not None and re.fullmatch(r"[\x20-\x7e\n\u00c0-\u024f]*", t)]
    df = spark.createDataFrame([(t,) for t in plain], "t string").select("t", V.listing_id(X.norm(F.col("t")), F.lit("d")).alias("i"), V.prefix_key(X.norm(F.col("t"))).alias("p"))
    for r in df.collect():
        key = hashlib.blake2b(f"{norm(r['t'])}\x1fd".encode(), digest_size=8).digest()
        assert r["i"] == int.from_bytes(key, "big") & V.ID_MASK
        assert r["p"] == int.from_bytes(hashlib.blake2b(norm(r["t"])[:300].encode(), digest_size=8).digest(), "big") >> 1


def test_slots_are_given_all_or_none(spark):
    rng = random.Random(6)
    rows = [(k, k % 3, float(rng.randint(0, 300)), float(rng.randint(1, 40)), rng.randint(1, 5)) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, u long, at double, takes double, slots int")
    got = {r["id"]: r["start"] for r in events.bounded_slots(df, "u", "at", "takes", "slots", "id", 4, 30.0).collect()}
    for u in range(3):
        own, ran, before = sorted((r for r in rows if r[1] == u), key=lambda r: (r[2], r[0])), [], 0.0
        for i, _, at, takes, slots in own:
            # The first moment from which so many slots are free, looked for at the arrival and at all ends.
            moments = sorted({max(at, before)} | {e for _, e, _ in ran if e > max(at, before)})
            start = next((t for t in moments if slots <= 4 - sum(n for s, e, n in ran if s <= t < e)), None)
            start = start if start is not None and start - at <= 30 else None
            assert got[i] == start
            if start is not None:
                ran.append((start, start + takes, slots))
                before = start


def test_protocol_faults(spark):
    rows = [(1, 0, "meta"), (1, 1, "x"), (1, 2, "done"), (2, 0, "x"), (2, 1, "done"), (3, 0, "meta"), (4, 0, "meta"), (4, 1, "done"), (4, 2, "done"), (5, 0, "meta"), (5, 1, "done"), (5, 2, "x"), (6, 0, None)]
    got = {r["s"]: r["fault"] for r in events.protocol(spark.createDataFrame(rows, "s int, k int, kind string"), "s", ["k"], "kind").collect()}
    assert got == {1: None, 2: "begins without meta", 3: "no done", 4: "more than one done", 5: "goes on after done", 6: "begins without meta"}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 5, size=(60, 2)).astype(float)
    df = spark.createDataFrame([(f"k{i:02d}", *map(float, v)) for i, v in enumerate(x)], "id string, a double, b double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = set()
    for i in range(60):
        d = np.round(((z - z[i]) ** 2).sum(axis=1), 9)
        for j in sorted((j for j in range(60) if j != i), key=lambda j: (d[j], j))[:3]:
            want.add((f"k{min(i, j):02d}", f"k{max(i, j):02d}"))
    assert {tuple(r) for r in graph.nearest_neighbours(df, "id", ["a", "b"], 3).collect()} == want


@pytest.mark.parametrize("at_once", [10, 100_000])
def test_quantiles_of_large_groups(spark, at_once):
    """Groups above a bound are looked into by ranges of values, with the same quantiles; null values count as rows only."""
    rng = np.random.default_rng(11)
    rows = [("hot", float(x)) for x in np.round(rng.lognormal(0, 2, 500), 2)] + [("same", 3.5)] * 60 + [(None, float(x)) for x in range(-20, 21)] + [("few", 1.0), ("few", 4.0), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    for keys in (["k"], []):
        got = {r["k"] if keys else "all": r for r in valuation.exact_quantiles(df, keys, "x", [0.1, 0.5, 0.9], at_once).collect()}
        assert set(got) == ({"hot", "same", None, "few", "none"} if keys else {"all"})
        for k, r in got.items():
            own = [x for g, x in rows if not keys or g == k]
            values = [x for x in own if x is not None]
            assert r["n"] == len(own) and (list(r["q"]) == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9]))) if values else r["q"] is None)
