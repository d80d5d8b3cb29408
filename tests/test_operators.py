"""Unit vectors, formulas, errors and properties of single operators."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import clean, dedup, evaluation, filters, graph, names, search, valuation
from lodestone.operators.components import connected_components
from lodestone.sources import io
from lodestone.streaming import limiter

PERIOD = ("2025-06", "2026-03")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_pii(spark):
    got = one(spark, X.mask_pii(F.lit("gọi 0901 234 567 hoặc a.b@x.vn, giá 7.450.000.000")))
    assert got == "gọi [phone_number] hoặc [email], giá 7.450.000.000"


def test_amenities_in_dictionary_order(spark):
    assert one(spark, X.match_amenities(F.lit("Nhà MẶT TIỀN, có thang máy, sổ hồng"))) == ["thang_may", "so_hong", "mat_tien"]
    assert one(spark, X.match_amenities(F.lit(None).cast("string"))) == []


def test_deal_types(spark):
    d = lambda t, s, p: one(spark, X.deal_type(F.lit(t), F.lit(s), F.lit(p)))
    assert [d("Cho thuê nhà", "", 1e9), d("cần cho thuê", "", 1e9), d("Nhà đẹp", "nhà cho thuê", 1e7), d("Nhà đẹp", "đang cho thuê", 5e9)] == ["rent", "rent", "rent", "sale"]


def test_null_price_is_sale(spark):
    assert one(spark, X.deal_type(F.lit("nhà"), F.lit("cho thuê"), F.lit(None).cast("double"))) == "sale"


RAW = [
    ("Nhà đẹp", "mô tả dài", "Nhà", "TP. Hồ Chí Minh", "Q.7", "P.5", None, None, "7450000000", 100.0, "2025-07-01"),
    ("Nhà đẹp", "mô tả dài", "Nhà", "TP. Hồ Chí Minh", "Q.7", "P.5", None, None, "7450000000", 100.0, "2025-08-01"),
    ("Đất nền", "khác hẳn", "Đất", "tỉnh Long An", "Huyện Bến Lức", None, None, None, "5000000", 100.0, "bad"),
    (None, None, "Nhà", "Hà Nội", None, None, None, None, "1", 1.0, None),
    ("x", "y", "Tàu vũ trụ", "Hà Nội", None, None, None, None, "abc", -1.0, None),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    cols = ["name", "description", "property_type_name", "province_name", "district_name", "ward_name", "street_name", "project_name", "price", "area", "published_at"]
    rows = [dict(zip(cols, r)) for r in RAW]
    full = [tuple(r.get(f.name) for f in schemas.RAW) + (0, i) for i, r in enumerate(rows)]
    t = schemas.T.StructType([*schemas.RAW.fields, *schemas.struct("source_shard int, source_row int").fields])
    return clean.clean_frame(spark.createDataFrame(full, t))


def test_clean_frame(cleaned):
    r = {x["source_row"]: x for x in cleaned.collect()}
    assert (r[0]["province"], r[0]["district"], r[0]["ward"]) == ("Hồ Chí Minh", "Quận 7", "Phường 5")
    assert r[0]["listing_id"] == r[1]["listing_id"] != r[2]["listing_id"] and 0 <= r[0]["listing_id"] < 1 << 53
    assert (r[2]["price_vnd"], r[2]["price_fixed_thousand"], r[2]["published_at"]) == (5e9, True, None)
    assert [r[i]["drop_reason"] for i in range(5)] == [None, None, None, "dropped_no_text", "dropped_bad_type"]
    assert r[4]["price_vnd"] is None and r[4]["area_m2"] is None


def test_dedup_of_cleaned_rows(cleaned):
    m = {r["source_row"]: r["reason"] for r in dedup.exact_and_prefix(cleaned).collect()}
    assert m == {0: "exact_dup", 1: "kept", 2: "kept", 3: "dropped_no_text", 4: "dropped_bad_type"}
    assert {r["source_row"]: r["n_raw_rows"] for r in dedup.kept_rows(dedup.exact_and_prefix(cleaned)).collect()} == {1: 2, 2: 1}


def test_ingest_report(cleaned):
    r = clean.ingest_report(cleaned).first()
    assert (r["n_rows"], r["dropped_no_text"], r["dropped_bad_type"], r["price_fixed"]) == (5, 1, 1, 1)


def test_collisions(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 7)], "listing_id long, key_hash2 long")
    assert [r["listing_id"] for r in dedup.collisions(df).collect()] == [2]


def test_simhash_ties_and_distance(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b c d e",), ("",), ("một hai",)], "t string").select(V.simhash("t").alias("h"))
    h = [r["h"] for r in df.collect()]
    assert h[0] == h[1] and h[2] is None and h[3] is not None


def clusters(spark, rows, **more):
    df = spark.createDataFrame(rows, "listing_id long, g string, simhash long")
    return {r["listing_id"]: r["dup_cluster_id"] for r in dedup.simhash_clusters(df, groups=["g"], **more).collect()}


def test_simhash_clusters_are_transitive(spark):
    assert clusters(spark, [(1, "a", 0), (2, "a", 0b111), (3, "a", 0b111111)]) == {1: 1, 2: 1, 3: 1}
    assert clusters(spark, [(1, "a", 0), (3, "a", 0b1111)]) == {1: 1, 3: 3}
    assert clusters(spark, [(1, "a", 5), (2, "b", 5), (3, None, 5), (4, None, 5), (9, "a", None)]) == {1: 1, 2: 2, 3: 3, 4: 3, 9: 9}


def test_simhash_skipped_buckets_are_told(spark):
    df = spark.createDataFrame([(i, "a", i << 20) for i in range(1, 9)], "listing_id long, g string, simhash long")
    _, skipped = dedup.simhash_pairs(df, "listing_id", ["g"], max_bucket=4)
    assert skipped.count() > 0


def test_short_simhashes_fill_all_bands(spark):
    hashes = [(i * 40503) % 65536 for i in range(400)]
    df = spark.createDataFrame([(i, "ab"[i % 2], h) for i, h in enumerate(hashes)] + [(900, "a", hashes[0])], "listing_id long, g string, simhash long")
    bits = {i: (i % 2, hashes[i]) for i in range(400)}
    want = {(a, b, (bits[a][1] ^ bits[b][1]).bit_count()) for a in bits for b in bits if a < b and bits[a][0] == bits[b][0] and (bits[a][1] ^ bits[b][1]).bit_count() <= 3}
    pairs, skipped = dedup.simhash_pairs(df, "listing_id", ["g"], max_bucket=None)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want | {(0, 900, 0)}) and skipped.isEmpty()
    # Hashes of 16 bits are in buckets of a sixteenth of their group, not in one of all of it.
    capped, skipped = dedup.simhash_pairs(df, "listing_id", ["g"], max_bucket=60)
    assert skipped.isEmpty() and sorted(tuple(r) for r in capped.collect()) == sorted(want | {(0, 900, 0)})


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 30)] + [(50, 50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 5 for k in range(5, 30)}, 50: 50}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_filters_equal_sql(spark):
    rows = [(i, None if i % 5 == 0 else f"p{i % 3}", float(i * 1e8), float(i % 40), f"2025-{6 + i % 7:02d}", i % 4 if i % 6 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "listing_id long, province string, price_vnd double, area_m2 double, month string, bedrooms int")
    df.createOrReplaceTempView("filter_rows")
    for given in ({}, dict(province="p1"), dict(price_min=500.0, price_max=9000.0), dict(area_min=3.0, bedrooms=2), dict(month_from="2025-08", month_to="2025-10"), dict(month_from="2030-01")):
        conds = filters.conditions(filters.validate(given), PERIOD)
        where, args = filters.compile_where(conds)
        a = df.where(filters.compile_filter(conds)).agg(F.sum("listing_id")).first()[0]
        assert a == spark.sql(f"SELECT sum(listing_id) AS s FROM filter_rows WHERE {where}", args=args).first()[0]


def test_filter_validation():
    with pytest.raises(ValueError):
        filters.validate({"nope": 1})
    with pytest.raises(ValueError):
        filters.validate({"price_min": 5.0, "price_max": 1.0})
    assert filters.validate({"price_min": 5.0, "price_max": 1.0, "province": "x"}, strict=False) == filters.QueryFilters(province="x")
    assert filters.merge(filters.QueryFilters(province="a"), filters.QueryFilters(province="b"))[1] == "merged"


def test_relaxation_labels():
    f = filters.QueryFilters(project="x", province="p", bedrooms=2, price_min=5.0, price_max=5.0)
    assert [g for _, g in filters.relaxations(f)] == [[], ["project"], ["project", "bedrooms", "price"], ["*"]]


def test_sql_gate():
    filters.check_sql("WITH x AS (SELECT * FROM v_listings) SELECT count(*) FROM x WHERE a = 'drop table'")
    for bad in ("DROP TABLE v_listings", "SELECT 1", "SELECT * FROM v_listings; SELECT 1", "WITH x AS (DELETE FROM v_listings) SELECT 1"):
        with pytest.raises(ValueError):
            filters.check_sql(bad)


def test_chunks_with_header(spark):
    rows = [(1, "a b c d e f", " ".join(f"w{i}" for i in range(50))), (2, "h", ""), (3, "h", None)]
    c = search.chunks(spark.createDataFrame(rows, "id long, head string, t string"), "id", F.col("head"), "t", size=20, overlap=5, header_max=6, cap=3)
    got = [(r["listing_id"], r["chunk_index"], r["n_tokens"], r["truncated"]) for r in c.orderBy("point_id").collect()]
    assert got == [(1, 0, 20, True), (1, 1, 20, True), (1, 2, 20, True), (2, 0, 1, False), (3, 0, 1, False)]


def test_bm25_without_terms(spark):
    df = spark.createDataFrame([(1, "a b")], "i long, t string")
    assert search.bm25(df, "i", "t", [], 5).count() == 0
    with pytest.raises(ValueError):
        search.corpus_stats(df.limit(0), "t")


def test_row_aligned_join_needs_same_ids(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,), (3,)], "k long")
    with pytest.raises(ValueError):
        search.keyed_join(a, b, "k")


def test_names_tiers(spark):
    v = names.vocabulary(spark.createDataFrame([("Vinhomes Central Park", "Q1", "HCM"), ("Central", "Q1", "HCM"), ("Vinhomes", "Q2", "HN")], "name string, district string, province string"), "name")
    got = [(r["name"], r["tier"]) for r in names.resolve(v, "vinhomes central park").collect()]
    assert got == [("Vinhomes Central Park", 0), ("Vinhomes", 2)]
    assert [r["name"] for r in names.resolve(v, "vinhomes").collect()] == ["Vinhomes", "Vinhomes Central Park"]


def test_metrics(spark):
    df = spark.createDataFrame([([9, 1], [1]), ([1], []), ([3, 2, 1], [1, 2])], "ranked array<int>, relevant array<int>")
    got = evaluation.retrieval_metrics(df).collect()
    assert got[0]["ndcg_10"] == pytest.approx(1 / math.log2(3)) and got[0]["mrr"] == 0.5
    assert got[1]["recall_5"] is None and got[1]["ndcg_10"] is None
    assert got[2]["recall_5"] == 1.0


def test_bootstrap():
    lo, hi = evaluation.bootstrap_mean([0, 1] * 50)
    assert 0.38 < lo < 0.5 < hi < 0.62
    rng = np.random.default_rng(0)
    a = (rng.random(400) < 0.6).astype(float)
    b = np.where(rng.random(400) < 0.4, 0.0, a)
    p = evaluation.bootstrap_paired(list(a), list(b))
    assert p["diff"] > 0 and p["p_value"] < 0.01
    assert evaluation.bootstrap_paired([1.0], [1.0])["p_value"] == 1.0 and evaluation.bootstrap_mean([]) is None
    with pytest.raises(ValueError):
        evaluation.bootstrap_mean([float("nan")])


def test_folds_do_not_leak(spark):
    df = spark.createDataFrame([("a", 0, 100.0), ("a", 1, 1.0), ("b", 1, 3.0)], "k string, f int, y double")
    got = {(r["k"], r["f"]): r["encoded"] for r in valuation.target_encode_oof(df, "k", "y", "f").collect()}
    assert got[("a", 0)] == pytest.approx((1.0 + 20 * 2.0) / 21)
    assert got[("b", 1)] == pytest.approx(100.0)


def test_error_measures_without_variance(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert valuation.error_measures(df, "y", "p").first()["r2"] is None
    assert valuation.error_measures(df.limit(0), "y", "p").first()["mae"] is None


def test_valuation_input():
    valuation.check_input({"area_m2": 5, "province": "x"}, {"area_m2", "province"}, {"area_m2"})
    for bad in ({"area_m2": 0}, {"area_m2": 5, "zz": 1}, {}):
        with pytest.raises(ValueError):
            valuation.check_input(bad, {"area_m2"}, {"area_m2"})


def test_limiter_counts_accepted_hits_only():
    assert decide_all([0, 1, 2, 61, 62], 2) == [None, None, 58, None, None]


def decide_all(times, n):
    return limiter.decide([float(t) for t in times], deque(), n, 60.0)


def test_limiter_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(i, "u", f"2025-01-01 00:00:{i:02d}") for i in range(5)]
    spark.createDataFrame(rows, "i long, u string, t string").select("i", "u", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("i long, u string, t timestamp").parquet(str(src))
    q = limiter.limit_stream(stream, "u", "t", "i", 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["i"]: r["retry_after"] for r in spark.sql("SELECT * FROM limited").collect()}
    assert [got[i] is None for i in range(5)] == [True, True, False, False, False]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    back = io.read_shards(spark, str(tmp_path / "p"), schemas.struct("id bigint, t string"), ["id"])
    assert back.columns == ["id", "source_shard", "source_row"] and sorted(r["source_row"] for r in back.collect()) == [0, 1]
    with pytest.raises(IndexError):
        io.read_range(df, "id", 5, 5)
    io.append_jsonl(df.union(df), str(tmp_path / "q"))
    with pytest.raises(ValueError):
        io.read_questions(spark, str(tmp_path / "q"), schemas.struct("id bigint, t string"))
    (tmp_path / "bad.json").write_text('{"id": 1}\nnot json\n')
    assert io.read_jsonl(spark, str(tmp_path / "bad.json"), schemas.struct("id bigint")).count() == 1
    with pytest.raises(ValueError):
        io.check_unique(df.union(df), "id")
    io.write_json(spark, str(tmp_path / "r.json"), {"n": 1})
    assert '"schema_version": 1' in (tmp_path / "r.json").read_text()
    text = "a\n<!-- t:start -->old<!-- t:end -->\nb"
    assert "| n |" in io.markdown_block(text, "t", [{"n": 1}])
    with pytest.raises(ValueError):
        io.markdown_block("x", "t", [])


def test_dangling_ends_come_once_with_their_edges(spark):
    rows = [("Listing", str(i), "OF_TYPE", "PropertyType", "flat" if i % 2 else "gone") for i in range(200)] + [("Listing", "7", "IN_WARD", "Ward", "w"), ("Listing", None, "IN_WARD", "Ward", "w")]
    edge = spark.createDataFrame(rows, "src_label string, src string, type string, dst_label string, dst string")
    keys = [("Listing", str(i)) for i in range(199)] + [("Ward", "w"), ("Ward", "w"), ("PropertyType", "flat"), ("Province", "gone"), ("Listing", None)]
    found = graph.dangling(edge, spark.createDataFrame(keys, "label string, key string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([("Listing", "199", 1), ("PropertyType", "gone", 100), ("Listing", None, 1)], key=str)


def test_modularity_and_propagation(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], "a long, b long")
    lab = graph.label_propagation(pairs)
    got = {r["node"]: r["community"] for r in lab.collect()}
    assert got[1] == got[2] == got[3]
    assert graph.modularity(pairs, lab).first()["modularity"] <= 5 / 14 + 1e-9


def test_dangling_edges_are_found(spark):
    e = spark.createDataFrame([("A", "1", "T", "B", "2"), ("A", "1", "T", "B", "9")], schemas.EDGE)
    n = spark.createDataFrame([("A", "1"), ("B", "2")], "label string, key string")
    assert [r["key"] for r in graph.dangling(e, n).collect()] == ["9"]


def test_plain_cells_and_row_cap(spark):
    from lodestone.operators import reports

    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")]), (2, 2.0, [])], "a long, b double, c array<double>").orderBy("a")
    assert reports.collect_within(df, 1, 60) == [{"a": 1, "b": None, "c": [1.0, None]}]
    with pytest.raises(Exception):
        reports.collect_within(spark.range(1 << 40).select(F.sum(F.sha2(F.col("id").cast("string"), 256).cast("binary").substr(1, 1).cast("string").try_cast("int")).alias("s")), 1, 2)


def test_gold_checks(spark):
    from lodestone.operators import reports

    spark.createDataFrame([(1, 7, 2.0), (2, 7, None)], "listing_id long, dup_cluster_id long, x double").createOrReplaceTempView("v_listings")
    assert reports.gold_ids(spark, "SELECT listing_id, dup_cluster_id FROM v_listings") == [7]
    for bad in ("SELECT count(*) AS n FROM v_listings", "SELECT max(x) AS x FROM v_listings WHERE listing_id = 2", "SELECT x FROM v_listings"):
        with pytest.raises(ValueError):
            reports.gold_value(spark, bad)
