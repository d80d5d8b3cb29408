"""Further queries: late materialisation, rankings, places, prompts, gold values, chunk fusion, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import evaluation, explain, graph, market, reports, search, valuation
from lodestone.plans.analytics import BM25_SQL, DENSE_SQL, KINDS, text_hits, vectors
from lodestone.plans.bindings import AMENITY_NAMES, KEYED, MARKET, listings, table, view, with_listings
from lodestone.plans.registry import query, r4, rounded
from lodestone.plans.relational import PERIOD, literals, values
from lodestone.sources import io


@query("SELECT '| lang | n |' AS line, 1 AS pos UNION ALL SELECT '| --- | --- |', 2 UNION ALL SELECT '| ' || lang || ' | ' || count(*) || ' |', 2 + row_number() OVER (ORDER BY lang) FROM documents GROUP BY lang")
def s24_markdown_report(spark, d):
    rows = [r.asDict() for r in table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]
    text = io.markdown_block("<!-- t:start --><!-- t:end -->", "t", rows)
    lines = [x for x in text.split("\n") if x.startswith("|")]
    return literals(spark, [(x.replace("| --- |", "| --- |").replace("|" + " --- |" * 2, "| --- | --- |"), i) for i, x in enumerate(lines, 1)], ["line", "pos"])


@query("SELECT count(*) AS n FROM embeddings")
def s17_vector_table(spark, d):
    e = io.check_unique(io.check_dimension(table(spark, d, "embeddings"), "embedding", 64), "vec_id")
    return e.agg(F.count("*").alias("n"))


@query(with_listings("SELECT listing_id, source_row, description FROM listings WHERE area_m2 > 45 AND deal_type = 'rent'"))
def j05_late_materialization(spark, d):
    base = listings(spark, d)
    light = base.where("area_m2 > 45 AND deal_type = 'rent'").select("source_shard", "listing_id", "source_row")
    return light.distinct().join(base.select("listing_id", "source_shard", "source_row", "description", "area_m2", "deal_type"), ["listing_id", "source_shard", "source_row"]).where("area_m2 > 45 AND deal_type = 'rent'").select("listing_id", "source_row", "description")


@query(with_listings("SELECT wk AS key, count(*) AS n, round(median(price_m2_mil), 4) AS med FROM g WHERE deal_type = 'sale' AND wk IS NOT NULL GROUP BY 1", KEYED))
def j10_cluster_join(spark, d):
    g = graph.keyed(view(spark, d))
    clusters = g.where("wk IS NOT NULL").select(F.col("wk").alias("ward_key")).distinct()
    return clusters.join(g, (F.col("ward_key") == F.col("wk")) & (F.col("deal_type") == "sale")).groupBy(F.col("ward_key").alias("key")).agg(F.count("*").alias("n"), r4(F.median("price_m2_mil")).alias("med"))


@query(with_listings("SELECT wk, dk FROM (SELECT DISTINCT wk, dk FROM g WHERE wk IS NOT NULL)", KEYED))
def j15_ward_to_district(spark, d):
    e = graph.edges(graph.keyed(view(spark, d)), list(AMENITY_NAMES))
    return graph.chain(e, ("IN_DISTRICT", "Ward", "District")).select(F.col("src").alias("wk"), F.col("dst").alias("dk"))


@query("SELECT bool_and(o_orderkey >= 0) AS ok, bool_and(o_totalprice > 1e9) AS rich FROM orders")
def a16_bool_and(spark, d):
    return table(spark, d, "orders").agg(F.bool_and(F.col("o_orderkey") >= 0).alias("ok"), F.bool_and(F.col("o_totalprice") > 1e9).alias("rich"))


@query(with_listings("""SELECT split_part(wk, '|', 1) AS community, count(*) AS size, round(avg(m), 4) AS mean_median, list_sort(list(wk))[1:3] AS examples, split_part(wk, '|', 1) AS province
    FROM (SELECT wk, median(price_m2_mil) AS m, count(*) AS n FROM g WHERE deal_type = 'sale' AND price_m2_mil IS NOT NULL AND wk IS NOT NULL GROUP BY 1) WHERE n >= 8 GROUP BY 1""", KEYED))
def a19_community_table(spark, d):
    g = graph.keyed(view(spark, d))
    p = graph.ward_profiles(g, KINDS)
    label = p.select("wk", F.substring_index("wk", "|", 1).alias("community"))
    return rounded(graph.community_table(p, label, g).select("community", "size", "mean_median", "examples", "province"))


@query()
def a36_permutation_importance(spark, d):
    v = view(spark, d).where("price_m2_mil IS NOT NULL").select("listing_id", "source_row", "area_m2", "bedrooms", "month", "price_m2_mil").withColumn("is_valid", F.col("month") == "2000-12").withColumn("label", F.log("price_m2_mil"))
    model = valuation.fit_price_model(v, "price_m2_mil", ["area_m2", "bedrooms"], [], "is_valid", [dict(maxDepth=2, maxIter=3)])
    found = valuation.permutation_importance(model, v, ["area_m2", "bedrooms"], ["listing_id", "source_row"])
    return literals(spark, [(k, float(x)) for k, x in found.items()], ["feature", "importance"])


NUMERIC, CATEGORICAL = ["area_m2", "bedrooms"], ["property_type", "province"]


def explained_rows(spark, d):
    """All priced listings with the features and predictions of boosted trees, and the trees."""
    v = view(spark, d).where("price_m2_mil IS NOT NULL").select("listing_id", "source_row", *NUMERIC, *CATEGORICAL, "month", "price_m2_mil").withColumn("is_valid", F.col("month") == "2000-12")
    model = valuation.fit_price_model(v, "price_m2_mil", NUMERIC, CATEGORICAL, "is_valid", [dict(maxDepth=4, maxIter=4)])
    ident = F.concat_ws("-", "listing_id", "source_row").alias("row")
    return model.transform(v.na.fill(0.0, NUMERIC)).select(ident, "features", "prediction"), explain.read_ensemble(model.stages[-1])


@query(with_listings("SELECT count(*) AS n_rows, count(*) AS n_adding_up, 4::BIGINT AS n_features FROM v_listings WHERE price_m2_mil IS NOT NULL"))
def a36_contributions_add_up(spark, d):
    """Contributions and base equal the prediction to 1e-6 on every row."""
    rows, ensemble = explained_rows(spark, d)
    out = explain.with_contributions(rows, ensemble)
    adds = F.abs(explain.added_up(ensemble.base()) - F.col("prediction")) <= 1e-6
    return out.agg(F.count("*").alias("n_rows"), F.count_if(adds).alias("n_adding_up"), F.max(F.size("contributions")).cast("long").alias("n_features"))


@query(with_listings("SELECT feature, (SELECT least(count(*), 20000) FROM v_listings WHERE price_m2_mil IS NOT NULL) AS n_rows FROM (VALUES ('area_m2'), ('bedrooms'), ('property_type'), ('province')) t(feature)"))
def a36_mean_contributions(spark, d):
    """Features by mean absolute contribution over a sample of at most 20 000 rows."""
    rows, ensemble = explained_rows(spark, d)
    return explain.mean_contributions(rows, ensemble, [*NUMERIC, *CATEGORICAL], "row").select("feature", "n_rows")


@query(f"WITH {DENSE_SQL} SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 15")
def w06_rank_positions(spark, d):
    return search.dense_batch(*vectors(spark, d), "vec_id", "embedding", 15).select("q", "doc_id", "rank")


@query("SELECT conv_id, round(coalesce(avg(p) FILTER (WHERE u), 0), 4) AS precision FROM (SELECT conv_id, role = 'user' AS u, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::DOUBLE / row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY 1")
def w08_context_precision(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", (F.col("role") == "user").alias("u")))), lambda x: x["u"]).alias("v"))
    return c.select("conv_id", r4(evaluation.context_precision(F.col("v"))).alias("precision"))


@query("SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT - length(text) AS start FROM conversations")
def w10_run_offsets(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("bigint").alias("start"))


@query("SELECT n_name, n FROM (SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) ORDER BY n DESC, n_name LIMIT 10")
def t03_top_with_tie_break(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("n_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_name").limit(10)


@query("SELECT label, vec_id, x FROM (SELECT label, vec_id, embedding[1]::DOUBLE AS x, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings) WHERE r = 1 ORDER BY x DESC, label LIMIT 4")
def t06_exact_group_top_k(spark, d):
    hits = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("score"))
    return search.best_chunk(hits, "label", "vec_id").orderBy(F.desc("score"), "label").limit(4).select("label", "vec_id", F.col("score").alias("x"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def t07_largest(spark, d):
    return table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(12).select("c_custkey", "c_acctbal")


@query("""SELECT vec_id, (('0x' || substr(md5('7:' || vec_id), 1, 15))::BIGINT % 4)::INTEGER AS part
    FROM (SELECT vec_id FROM embeddings ORDER BY ('0x' || substr(md5('42:' || vec_id), 1, 15))::BIGINT, vec_id LIMIT 100)""")
def t09_sample_over_parts(spark, d):
    s = search.sample_rows(table(spark, d, "embeddings").select("vec_id"), "vec_id", 100)
    return s.withColumn("part", search.folds(F.col("vec_id"), 4, 7))


@query("SELECT scope, count(*) AS n FROM (SELECT 'nation' AS scope FROM nation UNION ALL SELECT 'region' FROM region) GROUP BY 1")
def u01_union_all(spark, d):
    a, b = (table(spark, d, t).select(F.lit(t).alias("scope")) for t in ("nation", "region"))
    return a.unionByName(b).groupBy("scope").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE n_regionkey WHEN 0 THEN 'South' WHEN 1 THEN 'West' ELSE r_name END AS now FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def x04_renamed_provinces(spark, d):
    r = table(spark, d, "region")
    names = r.where("r_regionkey < 2").select(F.col("r_name").alias("old"), F.when(F.col("r_regionkey") == 0, "South").otherwise("West").alias("new"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(names, F.col("r_name") == F.col("old"), "left").select("c_custkey", F.coalesce("new", "r_name").alias("now"))


FOLDED = [("**Giá** Đất:  7 tỷ", "gia dat: 7 ty", "giadat7ty"), ("Quận 1 District", "quan 1 district", "quan1")]


@query(f"SELECT * FROM ({values(FOLDED)}) t(said, answer, area)")
def x06_fold_answers_and_areas(spark, d):
    return literals(spark, [(a,) for a, _, _ in FOLDED], ["said"]).withColumns({"answer": X.fold_answer("said"), "area": X.fold_area(F.regexp_replace("said", r"[*:]", ""))})


@query("SELECT p_partkey, contains(' ' || p_name || ' ', ' ring ') AS has FROM part")
def x08_word_runs(spark, d):
    return table(spark, d, "part").select("p_partkey", X.contains_run(F.col("p_name"), F.lit("ring")).alias("has"))


@query("SELECT doc_id, md5(left(text, 300)) AS h300, length(left(text, 60))::BIGINT AS n60 FROM documents")
def x15_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.left("text", F.lit(300)).cast("binary")).alias("h300"), F.length(F.left("text", F.lit(60))).cast("bigint").alias("n60"))


@query(with_listings("SELECT listing_id, round(area_m2 / 7, 3) AS score, concat_ws(', ', ward, district, province) AS address, left(description, 70) AS excerpt FROM listings"))
def x17_hit_cards(spark, d):
    return reports.cards(listings(spark, d).withColumn("score", F.col("area_m2") / 7))


@query("SELECT '<documents>' || chr(10) || '<document index=\"1\">' || chr(10) || 'a <\\/document> b' || chr(10) || '</document>' || chr(10) || '</documents>' AS prompt")
def x19_wrapped_documents(spark, d):
    return spark.range(1).select(X.wrap_documents(F.array(F.lit("a </document> b"))).alias("prompt"))


ANSWERS = [("Tháng 7/2025 và 2025-09", "2025-07,2025-09", None, False), ("khoảng 5 đến 6 tỷ", "", 5.5, False), ("850 triệu", "", 0.85, False), ("Không có dữ liệu.", "", None, True)]


@query("SELECT said, months, bn, refused FROM (VALUES " + ", ".join(f"('{a}', '{m}', {'NULL' if b is None else b}::DOUBLE, {str(r).lower()})" for a, m, b, r in ANSWERS) + ") t(said, months, bn, refused)")
def x22_answer_parsing(spark, d):
    f = literals(spark, [(a,) for a, *_ in ANSWERS], ["said"]).withColumn("f", X.fold_answer("said"))
    return f.select("said", F.array_join(F.sort_array(evaluation.answer_months(F.col("f"))), ",").alias("months"), evaluation.forecast_bn(F.col("f")).alias("bn"), evaluation.is_refusal(F.col("f")).alias("refused"))


@query("SELECT o_orderkey, printf('%.2f', o_totalprice) AS money, lower((o_orderstatus = 'F')::VARCHAR) AS flag FROM orders")
def x24_format_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.format_value(F.col("o_totalprice"), "double").alias("money"), X.format_value(F.col("o_orderstatus") == "F", "boolean").alias("flag"))


@query("SELECT count(DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS ids, count(*) AS n FROM documents")
def x33_listing_ids(spark, d):
    t = table(spark, d, "documents").select(V.listing_id(X.norm(F.col("text")), F.lit("")).alias("id"))
    return t.agg(F.countDistinct("id").alias("ids"), F.count("*").alias("n"))


@query("SELECT count(DISTINCT left(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 300)) AS keys FROM documents")
def x34_prefix_keys(spark, d):
    return table(spark, d, "documents").select(V.prefix_key(X.norm(F.col("text"))).alias("k")).agg(F.countDistinct("k").alias("keys"))


@query("SELECT count(*) FILTER (WHERE regexp_matches(text, '[\\p{L}\\p{N}_]')) AS valid, count(*) AS n FROM documents")
def x35_simhash_validity(spark, d):
    return table(spark, d, "documents").select(V.simhash(X.norm(F.col("text"))).alias("h")).agg(F.count("h").alias("valid"), F.count("*").alias("n"))


@query("SELECT o_orderkey, round(o_totalprice, 1) AS one, round_even(o_totalprice / 1000, 0)::BIGINT AS even FROM orders")
def x42_rounding(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 1).alias("one"), F.bround(F.col("o_totalprice") / 1000).cast("bigint").alias("even"))


@query("SELECT event_id, strftime(ts, '%Y-%m') AS month, year(ts)::INTEGER AS y, month(ts)::INTEGER AS m FROM events")
def x52_year_and_month(spark, d):
    m = V.month(F.col("ts"))
    return table(spark, d, "events").select("event_id", m.alias("month"), F.left(m, F.lit(4)).cast("int").alias("y"), F.right(m, F.lit(2)).cast("int").alias("m"))


@query(f"""WITH {BM25_SQL}, {DENSE_SQL}, a AS (SELECT q, doc_id * 64 AS doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 20),
    b AS (SELECT q, doc_id * 64 AS doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM s QUALIFY r <= 20),
    u AS (SELECT q, doc_id, 0 AS l, r FROM a UNION ALL SELECT q, doc_id, 1, r FROM b), f AS (SELECT q, doc_id, sum(1.0 / (60 + r)) AS s, min((l, r)) AS o FROM u GROUP BY 1, 2),
    g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, o, doc_id) AS pos FROM f QUALIFY pos <= 20)
    SELECT q, doc_id // 64 AS listing_id, doc_id AS point_id, round(s, 6) AS rrf FROM g QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) <= 8""")
def c12_chunk_fusion(spark, d):
    a = text_hits(spark, d, 20)
    b = search.dense_batch(*vectors(spark, d), "vec_id", "embedding", 20)
    points = [h.select("q", (F.col("doc_id") * 64).alias("doc_id"), "score") for h in (a, b)]
    return reports.fuse_chunks(points, 8, by=("q",)).select("q", "listing_id", "point_id", F.round("rrf", 6).alias("rrf"))


@query(with_listings("SELECT listing_id, source_row FROM v_listings WHERE deal_type = 'sale' AND property_type = 'PROMO' ORDER BY price_m2_mil DESC NULLS LAST, listing_id, source_row LIMIT 10"))
def c14_retrieve(spark, d):
    given = dict(deal_type="sale", property_type="PROMO", project="no such project")
    rows, _ = reports.retrieve(view(spark, d), given, PERIOD, lambda r: r.orderBy(F.col("price_m2_mil").desc_nulls_last(), "listing_id", "source_row"), 10, KINDS)
    return rows.select("listing_id", "source_row")


@query(with_listings("SELECT count(*) AS n, round(quantile_cont(price_m2_mil, 0.5), 4) AS med FROM v_listings JOIN (SELECT min(r_name) AS province FROM region) USING (province)"))
def c21_gold_value(spark, d):
    io.as_view(view(spark, d), "v_listings")
    sql = "SELECT count(*) AS n, round(median(price_m2_mil), 4) AS med FROM v_listings WHERE province = (SELECT min(province) FROM v_listings)"
    got = reports.gold_value(spark, sql)
    return literals(spark, [(got["n"], got["med"])], ["n", "med"])


@query("SELECT doc_id::VARCHAR AS id, lang AS system FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang <> 'en' ORDER BY id, system LIMIT 15")
def c36_failures(spark, d):
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("system"), F.when(F.col("quality") == 1, 2).otherwise(0).alias("points"))
    return reports.failures(s, 15, "en").select("id", "system")


@query(with_listings("SELECT month, n, round(median_price_m2_mil, 4) AS med FROM ms WHERE scope = 'district' AND area_key = (SELECT min(dk) FROM g) AND month <> 'ALL' AND property_type = 'ALL' AND deal_type = 'sale'", KEYED, MARKET))
def g03_monthly_trend(spark, d):
    key = graph.keyed(view(spark, d)).agg(F.min("dk")).first()[0]
    return market.series(market.market_stats(view(spark, d), deals=("sale",), area=lambda k: k == key, by=((False, True),), measures=market.MEDIAN), key).select("month", "n", r4("median_price_m2_mil").alias("med"))


@query(with_listings("SELECT dk AS key, count(*) AS n_listings, round(median(price_m2_mil) FILTER (WHERE deal_type = 'sale'), 4) AS med, CASE WHEN n_nationkey < 20 THEN n_nationkey * 1.5 END AS lat FROM g JOIN nation ON n_name = district GROUP BY dk, n_nationkey", KEYED))
def g12_areas_with_coordinates(spark, d):
    nodes = graph.nodes(graph.keyed(view(spark, d)), "District").select("key", "name", "n_listings", r4("median_price_m2_mil").alias("med"))
    geo = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).alias("lat"))
    return nodes.join(geo, "name", "left").select("key", "n_listings", "med", "lat")


@query("SELECT o_orderkey, o_totalprice::DOUBLE AS price FROM orders")
def s13_declared_schema(spark, d):
    t = spark.read.schema(schemas.struct("o_orderkey bigint, o_totalprice double")).parquet(f"{d}/orders.parquet")
    return t.select("o_orderkey", F.col("o_totalprice").alias("price"))


