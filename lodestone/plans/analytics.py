"""Queries for aggregates, composite dataflows, retrieval, graph templates, features and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import clean, communities, dedup, evaluation, graph, market, names, search, text_index, valuation
from lodestone.operators.components import connected_components
from lodestone.plans.bindings import AMENITY_NAMES, KEYED, MARKET, listings, table, view, with_listings
from lodestone.plans.registry import query, r4, rounded
from lodestone.plans.relational import literals
from lodestone.session import materialize, scratch, spread
from lodestone.sources import io

G_MS = (KEYED, MARKET)
ROUND_MS = "scope, area_key, property_type, month, deal_type, n, round(median_price_m2_mil, 4) AS median_price_m2_mil, round(p25_price_m2_mil, 4) AS p25_price_m2_mil, round(p75_price_m2_mil, 4) AS p75_price_m2_mil, round(median_price_vnd, 0) AS median_price_vnd, round(median_area_m2, 4) AS median_area_m2"


# Aggregates


@query(with_listings("SELECT property_type, deal_type, count(*) AS n FROM v_listings GROUP BY 1, 2"))
def a01_group_count(spark, d):
    return view(spark, d).groupBy("property_type", "deal_type").agg(F.count("*").alias("n"))


@query(with_listings("SELECT listing_id FROM listings GROUP BY 1 HAVING count(DISTINCT source_row) > 1"))
def a02_collision_detector(spark, d):
    return dedup.collisions(listings(spark, d), "listing_id", "source_row")


@query(with_listings("SELECT province, count(*) FILTER (WHERE deal_type = 'sale') AS n_sale, round(median(price_m2_mil) FILTER (WHERE deal_type = 'sale'), 4) AS med_sale FROM v_listings GROUP BY 1"))
def a03_filtered_aggregates(spark, d):
    sale = F.col("deal_type") == "sale"
    return view(spark, d).groupBy("province").agg(F.count_if(sale).alias("n_sale"), r4(F.median(F.when(sale, F.col("price_m2_mil")))).alias("med_sale"))


@query(with_listings("SELECT property_type, round(quantile_cont(price_m2_mil, 0.01), 4) AS p01, round(quantile_cont(price_m2_mil, 0.25), 4) AS p25, round(quantile_cont(price_m2_mil, 0.5), 4) AS p50, round(quantile_cont(price_m2_mil, 0.75), 4) AS p75, round(quantile_cont(price_m2_mil, 0.99), 4) AS p99 FROM v_listings GROUP BY 1"))
def a05_exact_quantiles(spark, d):
    ps = [0.01, 0.25, 0.5, 0.75, 0.99]
    q = view(spark, d).groupBy("property_type").agg(F.percentile("price_m2_mil", F.array(*[F.lit(p) for p in ps])).alias("q"))
    return q.select("property_type", *[r4(F.col("q")[i]).alias(n) for i, n in enumerate(("p01", "p25", "p50", "p75", "p99"))])


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def a06_mode_with_ties(spark, d):
    return graph.top_value(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT n_regionkey, min(n_name) AS any_name, count(*) AS n FROM nation GROUP BY 1")
def a07_any_value(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("any_name"), F.count("*").alias("n"))


@query(with_listings("SELECT prk, dk FROM (SELECT prk, dk, row_number() OVER (PARTITION BY prk ORDER BY count(*) DESC, dk) AS r FROM g WHERE prk IS NOT NULL AND dk IS NOT NULL GROUP BY 1, 2) WHERE r = 1", KEYED))
def a08_arg_max(spark, d):
    return graph.top_value(graph.keyed(view(spark, d)), "prk", "dk")


@query(with_listings(f"SELECT {ROUND_MS} FROM ms", *G_MS))
def a09_market_cube(spark, d):
    m = market.market_stats(view(spark, d))
    return rounded(m.withColumn("median_price_vnd", F.round("median_price_vnd", 0)))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def a10_group_by_all(spark, d):
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {l} GROUP BY ALL", l=table(spark, d, "lineitem"))


@query("SELECT l_linestatus, sum(l_extendedprice::DECIMAL(38, 4))::DOUBLE AS total FROM lineitem GROUP BY 1")
def a11_exact_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.sum(F.col("l_extendedprice").cast("decimal(38,4)")).cast("double").alias("total"))


@query(with_listings("SELECT 'ward' AS \"column\", round(100 * avg((ward IS NULL)::INT), 4) AS missing_pct FROM listings UNION ALL SELECT 'street', round(100 * avg((street IS NULL)::INT), 4) FROM listings UNION ALL SELECT 'project', round(100 * avg((project IS NULL)::INT), 4) FROM listings UNION ALL SELECT 'price_vnd', round(100 * avg((price_vnd IS NULL)::INT), 4) FROM listings"))
def a12_missing_rates(spark, d):
    return rounded(market.missing_rates(listings(spark, d), ["ward", "street", "project", "price_vnd"]))


@query(with_listings("SELECT count(*) AS n_listings, count(*) FILTER (WHERE deal_type = 'sale') AS n_sale, min(published_at) AS first_at, max(published_at) AS last_at, round(median(price_m2_mil) FILTER (WHERE deal_type = 'sale'), 4) AS median_sale_m2, round(avg(is_price_outlier::INT), 4) AS price_outlier_share, round(sum(price_vnd) / 1e9, 3) AS sum_price_bn FROM v_listings"))
def a13_overview(spark, d):
    o = market.overview(view(spark, d))
    return rounded(o.withColumn("sum_price_bn", F.round(F.col("sum_price") / 1e9, 3)).drop("sum_price"))


@query("WITH c AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), b AS (SELECT CASE WHEN k <= 3 THEN k::VARCHAR WHEN k <= 5 THEN '4-5' WHEN k <= 10 THEN '6-10' ELSE '>10' END AS bucket, count(*) AS n FROM c GROUP BY 1) SELECT pos::INTEGER AS pos, t.bucket, coalesce(n, 0)::BIGINT AS n FROM (VALUES (0, '1'), (1, '2'), (2, '3'), (3, '4-5'), (4, '6-10'), (5, '>10')) t(pos, bucket) LEFT JOIN b ON b.bucket = t.bucket")
def a14_histogram(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return market.histogram(counts, "k")


@query("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM orders")
def a15_global(spark, d):
    return table(spark, d, "orders").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query(with_listings("SELECT DISTINCT wk, dk FROM g WHERE wk IS NOT NULL", KEYED))
def a17_distinct_edges(spark, d):
    return graph.keyed(view(spark, d)).where("wk IS NOT NULL").select("wk", "dk").distinct()


KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(with_listings("SELECT wk, count(*) AS n, round(median(price_m2_mil), 4) AS median_m2, " + ", ".join(f"round(avg((property_type = '{k}')::INT), 4) AS share_{k.lower()}" for k in KINDS) + ", round(ln(1 + count(*)), 4) AS log_n FROM g WHERE deal_type = 'sale' AND price_m2_mil IS NOT NULL AND wk IS NOT NULL GROUP BY 1 HAVING count(*) >= 8", KEYED))
def a18_ward_profiles(spark, d):
    return rounded(graph.ward_profiles(graph.keyed(view(spark, d)), KINDS))


@query("SELECT label, i::INTEGER - 1 AS pos, round(avg(embedding[i]::DOUBLE), 5) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2")
def a20_mean_vectors(spark, d):
    m = search.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("x"))


@query(r"SELECT count(*) AS n, round(avg(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))), 4) AS avgdl FROM documents")
def a21_average_length(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), r4(F.avg(F.size(X.words(F.col("text"))))).alias("avgdl"))


@query(r"WITH t AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::INTEGER AS doc_len FROM benchmark) SELECT doc_id, term, doc_len, least(count(*), 65535)::INTEGER AS tf FROM t GROUP BY ALL")
def a22_postings(spark, d):
    return search.postings(table(spark, d, "benchmark"), "item_id", "text")


@query("WITH p AS (SELECT avg(o_totalprice) AS prior FROM orders) SELECT o_custkey, round((sum(o_totalprice) + 20 * min(prior)) / (count(*) + 20), 4) AS encoded FROM orders, p GROUP BY 1")
def a23_smoothed_means(spark, d):
    return rounded(valuation.smoothed_means(table(spark, d, "orders"), "o_custkey", "o_totalprice"))


@query(with_listings("""SELECT s.listing_id, s.source_row, round(coalesce(w.m, dd.m, p.m, (SELECT median(price_m2_mil) FROM tr)), 4) AS base, coalesce(w.n, dd.n, p.n, 0)::BIGINT AS base_n FROM te s
    LEFT JOIN (SELECT province, district, ward, median(price_m2_mil) AS m, count(*) AS n FROM tr WHERE ward IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) w USING (province, district, ward)
    LEFT JOIN (SELECT province, district, median(price_m2_mil) AS m, count(*) AS n FROM tr GROUP BY ALL HAVING count(*) >= 5) dd USING (province, district)
    LEFT JOIN (SELECT province, median(price_m2_mil) AS m, count(*) AS n FROM tr GROUP BY ALL HAVING count(*) >= 5) p USING (province)""",
    "tr AS (SELECT * FROM v_listings WHERE price_m2_mil IS NOT NULL AND month < '2000-01')", "te AS (SELECT * FROM v_listings WHERE price_m2_mil IS NOT NULL AND month >= '2001-06')"))
def a24_baseline_fallback(spark, d):
    v = view(spark, d).where("price_m2_mil IS NOT NULL")
    out = valuation.baseline(v.where("month < '2000-01'"), v.where("month >= '2001-06'"), [["province", "district", "ward"], ["province", "district"], ["province"]], "price_m2_mil")
    return out.select("listing_id", "source_row", r4("base").alias("base"), F.col("base_n").cast("bigint").alias("base_n"))


ERR = "count(*) AS n, round(avg(abs(o_totalprice - p)), 4) AS mae, round(avg(abs(o_totalprice - p) / o_totalprice), 4) AS mape, round(1 - sum((o_totalprice - p) ** 2) / (sum(o_totalprice * o_totalprice) - sum(o_totalprice) * sum(o_totalprice) / count(*)), 4) AS r2"


@query(f"SELECT o_orderpriority, {ERR} FROM (SELECT *, 200000 + o_orderkey % 1000 AS p FROM orders) GROUP BY 1")
def a25_error_measures(spark, d):
    o = table(spark, d, "orders").withColumn("p", (200000 + F.col("o_orderkey") % 1000).cast("double"))
    return rounded(valuation.error_measures(o, "o_totalprice", "p", "o_orderpriority"))


@query("SELECT coalesce(k, 'ALL') AS kind, round(quantile_cont(r, 0.1), 4) AS p10, round(quantile_cont(r, 0.9), 4) AS p90 FROM (SELECT o_orderpriority AS k, o_totalprice / (200000 + o_orderkey % 1000) AS r FROM orders) GROUP BY GROUPING SETS ((k), ())")
def a26_ratio_interval(spark, d):
    o = table(spark, d, "orders").withColumn("p", (200000 + F.col("o_orderkey") % 1000).cast("double"))
    return rounded(valuation.ratio_interval(o, "o_totalprice", "p", "o_orderpriority"))


@query("""WITH s AS (SELECT lang AS system, CASE WHEN quality = 1 THEN 2 ELSE 0 END AS points, 'c' || (doc_id % 3) AS category FROM documents JOIN labels USING (doc_id))
    SELECT g.system, g.category, coalesce(count(points), 0) AS n, round(avg((points = 2)::INT), 4) AS accuracy, round(avg(points), 4) AS mean_points, coalesce(count(*) FILTER (WHERE s.system IS NOT NULL AND points IS NULL), 0) AS unscored
    FROM (SELECT * FROM (VALUES ('en'), ('de'), ('xx')) a(system), (VALUES ('c0'), ('c1'), ('c9')) b(category)) g LEFT JOIN s ON s.system = g.system AND s.category = g.category GROUP BY 1, 2""")
def a27_accuracy_grid(spark, d):
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("system"), F.when(F.col("quality") == 1, 2).otherwise(0).alias("points"), F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("category"))
    return rounded(evaluation.accuracy_grid(s, ["en", "de", "xx"], ["c0", "c1", "c9"]))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def a28_latency_percentiles(spark, d):
    clean_ = F.when(~F.isnan("value"), F.col("value"))
    q = table(spark, d, "events").groupBy("event_type").agg(F.percentile(clean_, F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select("event_type", r4(F.col("q")[0]).alias("p50"), r4(F.col("q")[1]).alias("p95"))


@query("SELECT quality AS gold, count(*) FILTER (WHERE toxic = 0) AS \"0\", count(*) FILTER (WHERE toxic = 1) AS \"1\", count(*) FILTER (WHERE toxic IS NULL) AS none FROM labels GROUP BY 1")
def a29_confusion(spark, d):
    return evaluation.confusion(table(spark, d, "labels").withColumn("t", F.col("toxic").cast("string")), "quality", "t", ["0", "1"])


@query("SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def a30_cause_counts(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS key, round(median(o_totalprice), 4) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 20 ORDER BY value DESC, key LIMIT 5")
def a31_rule_query(spark, d):
    return rounded(evaluation.rule_query(table(spark, d, "orders"), {"filter": "o_orderstatus = 'F'", "measure": "o_totalprice", "op": "median", "group": "o_orderpriority", "min_count": 20, "pick": "top5"}))


@query("SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1")
def a32_pivot(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 2))
    return p


@query("SELECT event_type, round(avg(value), 4) AS mean_value, round(avg((value > 50)::INT), 4) AS over_rate, round(sum(value) * 0.001, 4) AS cost FROM events GROUP BY 1")
def a33_cost_table(spark, d):
    return rounded(table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean_value"), F.avg((F.col("value") > 50).cast("int")).alias("over_rate"), (F.sum("value") * 0.001).alias("cost")))


@query(with_listings("SELECT a AS key, count(*) AS degree FROM (SELECT DISTINCT listing_id, unnest(amenities) AS a FROM v_listings) GROUP BY 1"))
def a34_degrees(spark, d):
    return graph.degrees(graph.edges(graph.keyed(view(spark, d)), list(AMENITY_NAMES)), "HAS_AMENITY")


@query(with_listings("SELECT count(DISTINCT listing_id) AS n FROM v_listings WHERE list_contains(amenities, 'ho_boi')"))
def a35_count_distinct(spark, d):
    return view(spark, d).where(F.array_contains("amenities", "ho_boi")).agg(F.countDistinct("listing_id").alias("n"))


@query(r"WITH t AS (SELECT len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n FROM documents) SELECT round(quantile_cont(n, 0.5), 1) AS p50, round(quantile_cont(n, 0.9), 1) AS p90, round(quantile_cont(n, 0.99), 1) AS p99 FROM t")
def a37_token_percentiles(spark, d):
    q = table(spark, d, "documents").agg(F.percentile(F.size(X.words(F.col("text"))), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("q"))
    return q.select(*[F.round(F.col("q")[i], 1).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@query("SELECT count(*) AS n FROM documents WHERE doc_id BETWEEN 100 AND 199")
def a38_count_in_range(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").between(100, 199)).agg(F.count("*").alias("n"))


@query(r"""SELECT count(*) FILTER (WHERE n > 50 AND ceil((n - 10) / 40.0) >= 64) AS capped FROM (
    SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n FROM documents)""")
def a39_capped(spark, d):
    """Documents whose last permitted chunk is taken, by chunking them."""
    c = search.chunks(table(spark, d, "documents"), "doc_id", F.lit(""), "text", size=50, overlap=10, cap=64)
    return c.agg(F.count_if(F.col("chunk_index") == 63).alias("capped"))


@query("SELECT conv_id, round(avg((role = 'user')::INT), 4) AS share FROM conversations GROUP BY 1")
def a40_mean_verdict(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("role") == "user").alias("v"))
    return c.select("conv_id", r4(evaluation.faithfulness(F.col("v"), F.size("v"))).alias("share"))


# Composite dataflows


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) > 400 THEN ceil((len(w) - 100) / 300.0)::BIGINT ELSE 1 END)) AS i FROM t)
    SELECT (doc_id::DECIMAL(20, 0) * 2147483648 + i)::DECIMAL(31, 0) AS point_id, i::INTEGER AS chunk_index, md5(array_to_string(w[i * 300 + 1 : i * 300 + 400], ' ')) AS h, len(w[i * 300 + 1 : i * 300 + 400])::INTEGER AS n_tokens FROM c""")
def c01_chunks(spark, d):
    c = search.whole_chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select("point_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("h"), "n_tokens")


def keyed_documents(spark, d):
    """Documents as raw rows: the id is a hash of the text, the prefix key of its first 60 characters."""
    t = table(spark, d, "documents")
    norm = X.norm(F.col("text"))
    return t.select(
        F.col("doc_id").alias("source_row"), F.lit(0).alias("source_shard"), V.sql_key(norm).alias("listing_id"), V.sql_key(F.left(norm, F.lit(60))).alias("prefix_key"),
        F.col("n_chars").alias("n_nonnull"), F.lit("2025-01-01").cast("timestamp_ntz").alias("published_at"), F.when(F.col("source") == "src3", "dropped_bad_type").alias("drop_reason"),
    )


DOC_KEYS = r"""k AS (SELECT doc_id, n_chars, CASE WHEN source = 'src3' THEN 'dropped_bad_type' END AS drop_reason, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents),
    h AS (SELECT *, ('0x' || substr(md5(t), 1, 15))::BIGINT AS id, ('0x' || substr(md5(left(t, 60)), 1, 15))::BIGINT AS pk FROM k),
    one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n_chars DESC, doc_id) AS r1 FROM h WHERE drop_reason IS NULL),
    two AS (SELECT *, first_value(id) OVER (PARTITION BY pk ORDER BY n_chars DESC, doc_id) AS kept_id FROM one WHERE r1 = 1),
    m AS (SELECT one.doc_id, one.id, two.kept_id, CASE WHEN one.r1 > 1 THEN 'exact_dup' WHEN one.id <> two.kept_id THEN 'prefix_dup' ELSE 'kept' END AS reason FROM one JOIN two USING (id)
          UNION ALL SELECT doc_id, id, NULL, drop_reason FROM h WHERE drop_reason IS NOT NULL)"""


@query(f"WITH {DOC_KEYS} SELECT doc_id AS source_row, kept_id, reason FROM m")
def c02_dedup_map(spark, d):
    return dedup.exact_and_prefix(keyed_documents(spark, d)).select("source_row", "kept_id", "reason")


@query(f"WITH {DOC_KEYS} SELECT m.doc_id AS source_row, c.n AS n_raw_rows FROM m JOIN (SELECT kept_id, count(*) AS n FROM m WHERE kept_id IS NOT NULL GROUP BY 1) c ON m.id = c.kept_id WHERE reason = 'kept'")
def c02_kept_rows(spark, d):
    return dedup.kept_rows(dedup.exact_and_prefix(keyed_documents(spark, d))).select("source_row", "n_raw_rows")


@query()
def c03_simhash_clusters(spark, d):
    t = spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select(F.col("doc_id").alias("listing_id"), "lang", V.simhash(X.norm(F.col("text"))).alias("simhash"))
    return dedup.simhash_clusters(t, groups=["lang"])


EDGES = "SELECT doc_id AS a, doc_id - doc_id % 7 AS b FROM documents"


@query(f"""WITH RECURSIVE e AS ({EDGES}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
    SELECT a AS node, min(b) AS component FROM r GROUP BY 1""")
def c03_components(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") - F.col("doc_id") % 7).alias("b"))
    return connected_components(e, "a", "b")


@query(with_listings("""SELECT l.listing_id, l.source_row, coalesce(CASE WHEN price_vnd / area_m2 / 1e6 < coalesce(p.lo, 0.05) THEN true WHEN price_vnd / area_m2 / 1e6 > coalesce(p.hi, 2000) THEN true ELSE false END, false) AS is_price_outlier,
           coalesce(area_m2 < 10 OR area_m2 > 10000, false) OR coalesce(area_m2 < a.lo OR area_m2 > a.hi, false) AS is_area_outlier
    FROM listings l
    LEFT JOIN (SELECT deal_type, property_type, province, quantile_cont(price_vnd / area_m2 / 1e6, 0.01) AS lo, quantile_cont(price_vnd / area_m2 / 1e6, 0.99) AS hi FROM listings WHERE price_vnd / area_m2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 200) p
      ON l.deal_type IS NOT DISTINCT FROM p.deal_type AND l.property_type IS NOT DISTINCT FROM p.property_type AND l.province IS NOT DISTINCT FROM p.province
    LEFT JOIN (SELECT property_type, province, quantile_cont(area_m2, 0.005) AS lo, quantile_cont(area_m2, 0.995) AS hi FROM listings WHERE area_m2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 200) a
      ON l.property_type IS NOT DISTINCT FROM a.property_type AND l.province IS NOT DISTINCT FROM a.province"""))
def c04_outlier_flags(spark, d):
    rows = listings(spark, d).drop("is_price_outlier", "is_area_outlier")
    return dedup.outlier_flags(rows, "deal_type", "property_type", "province", "price_vnd", "area_m2").select("listing_id", "source_row", "is_price_outlier", "is_area_outlier")


@query(with_listings("SELECT count(*) AS n_rows, count(*) FILTER (WHERE title LIKE 'small%') AS dropped_no_text, count(*) FILTER (WHERE title NOT LIKE 'small%' AND property_type = 'PROMO') AS dropped_bad_type, count(*) FILTER (WHERE price_vnd IS NULL) AS price_null, 0::BIGINT AS price_fixed, round(100.0 * count(*) FILTER (WHERE area_m2 IS NULL) / greatest(count(*), 1), 2) AS area_missing_pct, count(*) FILTER (WHERE deal_type = 'rent') AS n_rent FROM listings"))
def c05_ingest_report(spark, d):
    rows = listings(spark, d).withColumns({"drop_reason": F.when(F.col("title").startswith("small"), "dropped_no_text").when(F.col("property_type") == "PROMO", "dropped_bad_type"), "price_fixed_thousand": F.lit(False)})
    return clean.ingest_report(rows)


@query(with_listings("SELECT month, deal_type, count(*) AS n, round(median(price_m2_mil), 4) AS med FROM v_listings GROUP BY 1, 2"))
def c06_eda_by_month(spark, d):
    return view(spark, d).groupBy("month", "deal_type").agg(F.count("*").alias("n"), r4(F.median("price_m2_mil")).alias("med"))


@query(with_listings("""SELECT 'Province' AS label, province AS key, count(*) AS n_listings, round(median(price_m2_mil) FILTER (WHERE deal_type = 'sale'), 4) AS med FROM g GROUP BY 2
    UNION ALL SELECT 'District', dk, count(*), round(median(price_m2_mil) FILTER (WHERE deal_type = 'sale'), 4) FROM g GROUP BY 2
    UNION ALL SELECT 'Ward', wk, count(*), round(median(price_m2_mil) FILTER (WHERE deal_type = 'sale'), 4) FROM g WHERE wk IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'Project', prk, count(*), round(median(price_m2_mil) FILTER (WHERE deal_type = 'sale'), 4) FROM g WHERE prk IS NOT NULL GROUP BY 2""", KEYED))
def c07_area_nodes(spark, d):
    g = graph.keyed(view(spark, d))
    out = None
    for label in ("Province", "District", "Ward", "Project"):
        n = graph.nodes(g, label).select(F.lit(label).alias("label"), "key", "n_listings", r4("median_price_m2_mil").alias("med"))
        out = n if out is None else out.unionByName(n)
    return out


@query(with_listings("SELECT DISTINCT month AS key, left(month, 4)::INTEGER AS year, right(month, 2)::INTEGER AS mon FROM g", KEYED))
def c07_month_nodes(spark, d):
    return graph.nodes(graph.keyed(view(spark, d)), "Month")


CLUSTERS_SQL = "cl AS (SELECT DISTINCT wk AS ward_key, s_nationkey % 4 AS cluster_id FROM g JOIN supplier ON s_name = ward)"


def ward_clusters(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("ward"), (F.col("s_nationkey") % 4).alias("cluster_id"))
    return graph.keyed(view(spark, d)).where("wk IS NOT NULL").join(s, "ward").select(F.col("wk").alias("ward_key"), "cluster_id").distinct()


@query(with_listings("""SELECT cluster_id::VARCHAR AS key, n_wards, round(m, 4) AS med, top || ' · ' || round_even(q1, 0)::BIGINT || '–' || round_even(q3, 0)::BIGINT || ' tr/m²' AS label FROM (
        SELECT cluster_id, count(DISTINCT ward_key) AS n_wards, median(price_m2_mil) AS m, quantile_cont(price_m2_mil, 0.25) AS q1, quantile_cont(price_m2_mil, 0.75) AS q3 FROM cl JOIN g ON wk = ward_key AND deal_type = 'sale' GROUP BY 1)
    JOIN (SELECT cluster_id, province AS top FROM cl JOIN g ON wk = ward_key AND deal_type = 'sale' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, province) = 1) USING (cluster_id)""", KEYED, CLUSTERS_SQL))
def c07_cluster_nodes(spark, d):
    n = graph.cluster_nodes(graph.keyed(view(spark, d)), ward_clusters(spark, d))
    return n.select("key", "n_wards", r4("median_price_m2_mil").alias("med"), "label")


@query(with_listings("SELECT 'Ward' AS src_label, ward_key AS src, 'IN_CLUSTER' AS type, 'Cluster' AS dst_label, cluster_id::VARCHAR AS dst FROM cl", KEYED, CLUSTERS_SQL))
def c07_cluster_edges(spark, d):
    return graph.cluster_edges(ward_clusters(spark, d))


#: The stated query set of searches: rows whose id is divisible by 50, against all rows.
DENSE_SQL = """qv AS (SELECT vec_id AS q, label AS ql, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT q, ql, vec_id AS doc_id, label AS dl, embedding[1] AS x, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score FROM embeddings, qv)"""


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 50 = 0")


@query(f"WITH {DENSE_SQL} SELECT q, doc_id, round(score, 5) AS score FROM s WHERE dl < 5 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s.score DESC, doc_id) <= 20")
def c08_dense_search(spark, d):
    return search.dense_batch(*vectors(spark, d), "vec_id", "embedding", 20, F.col("label") < 5).select("q", "doc_id", F.round("score", 5).alias("score"))


BM25_SQL = r"""toks AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
    st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks), qt AS (SELECT DISTINCT doc_id AS q, unnest(w[1:8]) AS term FROM toks WHERE doc_id % 50 = 0),
    tf AS (SELECT doc_id, lang, term, count(*) AS tf, dl FROM (SELECT doc_id, lang, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    bm AS (SELECT q, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st WHERE lang IN ('en', 'de') GROUP BY 1, 2)"""


def documents_index(spark, d):
    """The index of all documents with their language as payload, written once for a table."""
    docs = table(spark, d, "documents")
    return text_index.read_shards(spark, io.cached(spark, "text-shards", [f"{d}/documents.parquet"], lambda to: text_index.write_shards(docs, "doc_id", "text", to, ["lang"])))


def text_hits(spark, d, k):
    """The first eight words of every fiftieth document (a query is a few words long) against all documents of two languages."""
    queries = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("q"), F.slice(X.words(F.col("text")), 1, 8).alias("terms"))
    return text_index.search_shards(documents_index(spark, d), queries, k, lambda doc: doc["lang"].isin("en", "de"))


@query(f"WITH {BM25_SQL} SELECT q, doc_id, round(score, 5) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY q ORDER BY bm.score DESC, doc_id) <= 10")
def c09_bm25_search(spark, d):
    return text_hits(spark, d, 10).select("q", "doc_id", F.round("score", 5).alias("score"))


@query(f"WITH {BM25_SQL} SELECT doc_id, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 5) AS weight FROM tf, st GROUP BY 1")
def r05_weights_behind_a_barrier(spark, d):
    """Weights need the mean length of the whole corpus, so postings are written before any of them is made."""
    return text_index.weights_of(documents_index(spark, d)).select("doc_id", F.round("weight", 5).alias("weight"))


@query("SELECT * FROM (VALUES ('Y', 0.03252::DOUBLE), ('X', 0.03227), ('Z', 0.032)) t(doc_id, rrf)")
def c10_rrf(spark, d):
    rows = [(x, i, r) for i, l in enumerate((["X", "Y", "Z"], ["Y", "Z", "X"])) for r, x in enumerate(l, 1)]
    return search.rrf(literals(spark, rows, ["doc_id", "list_no", "rank"]), 3).select("doc_id", F.round("rrf", 5).alias("rrf"))


@query(f"""WITH {BM25_SQL}, {DENSE_SQL}, a AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 20),
    b AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM s QUALIFY r <= 20),
    u AS (SELECT q, doc_id, 0 AS l, r FROM a UNION ALL SELECT q, doc_id, 1, r FROM b)
    SELECT q, doc_id, round(sum(1.0 / (60 + r)), 6) AS rrf, min(r)::INTEGER AS best_rank FROM u GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY q ORDER BY sum(1.0 / (60 + r)) DESC, min((l, r)), doc_id) <= 10""")
def c11_hybrid_search(spark, d):
    lists = [text_hits(spark, d, 20), search.dense_batch(*vectors(spark, d), "vec_id", "embedding", 20)]
    return search.hybrid(lists, 10, by=("q",)).select("q", "doc_id", F.round("rrf", 6).alias("rrf"), "best_rank")


@query(f"""WITH {DENSE_SQL}, h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 20)
    SELECT q, doc_id FROM h QUALIFY row_number() OVER (PARTITION BY q ORDER BY x DESC, doc_id) <= 5""")
def c13_rerank(spark, d):
    e, q = vectors(spark, d)
    hits = search.dense_batch(e, q, "vec_id", "embedding", 20).drop("rank").join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding")[0].alias("x")), "doc_id")
    return search.best_rows(hits, 5, score="x").select("q", "doc_id")


@query("""WITH r AS (SELECT *, o_orderkey % 5 AS fold FROM orders), f AS (SELECT o_custkey, fold, sum(o_totalprice) AS s, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT o_custkey, sum(s) AS ts, sum(n) AS tn FROM f GROUP BY 1),
    p AS (SELECT fold, ((SELECT sum(o_totalprice) FROM r) - sum(o_totalprice)) / ((SELECT count(*) FROM r) - count(*)) AS prior FROM r GROUP BY 1)
    SELECT o_orderkey, round((ts - s + 20 * prior) / (tn - n + 20), 3) AS encoded FROM r JOIN f USING (o_custkey, fold) JOIN t USING (o_custkey) JOIN p USING (fold)""")
def c15_target_encoding(spark, d):
    o = table(spark, d, "orders").withColumn("fold", F.col("o_orderkey") % 5)
    return valuation.target_encode_oof(o, "o_custkey", "o_totalprice", "fold").select("o_orderkey", F.round("encoded", 3).alias("encoded"))


@query()
def c16_pca(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return valuation.apply_pca(valuation.fit_pca(e.where("label < 8"), "x", 8), e, "x").select("vec_id", "pca")


@query()
def c17_price_model(spark, d):
    v = view(spark, d).where("price_m2_mil IS NOT NULL").select("listing_id", "source_row", "property_type", "province", "area_m2", "bedrooms", "month", "price_m2_mil")
    rows = v.withColumns(valuation.time_split(F.col("month"), "2000-12", "2000-12", "2001-01"))
    model = valuation.fit_price_model(rows.where("is_train"), "price_m2_mil", ["area_m2", "bedrooms"], ["property_type", "province"], "is_valid", [dict(maxDepth=3, maxIter=5)])
    return valuation.predict_price(model, rows.where("is_test"), ["area_m2", "bedrooms"]).select("listing_id", "source_row", "price_m2_mil", "predicted")


BASE_SQL = """SELECT s.*, coalesce(w.m, dd.m, p.m, (SELECT median(price_m2_mil) FROM tr)) AS base FROM {0} s
    LEFT JOIN (SELECT province, district, ward, median(price_m2_mil) AS m FROM tr WHERE ward IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) w USING (province, district, ward)
    LEFT JOIN (SELECT province, district, median(price_m2_mil) AS m FROM tr GROUP BY ALL HAVING count(*) >= 5) dd USING (province, district)
    LEFT JOIN (SELECT province, median(price_m2_mil) AS m FROM tr GROUP BY ALL HAVING count(*) >= 5) p USING (province)"""


@query(with_listings("""SELECT listing_id, source_row, round(base * 1e6 * area_m2, 0) AS predicted_vnd, round(base * coalesce(own.lo, al.lo), 4) AS low, round(base * coalesce(own.hi, al.hi), 4) AS high,
        CASE WHEN price_m2_mil < base * coalesce(own.lo, al.lo) THEN 'below_market' WHEN price_m2_mil > base * coalesce(own.hi, al.hi) THEN 'above_market' ELSE 'fair' END AS verdict
    FROM rows_ LEFT JOIN own USING (property_type), al""",
    "tr AS (SELECT * FROM v_listings WHERE price_m2_mil IS NOT NULL AND month < '2000-01')", "va AS (SELECT * FROM v_listings WHERE price_m2_mil IS NOT NULL AND month >= '2000-01' AND month < '2001-06')",
    "te AS (SELECT * FROM v_listings WHERE price_m2_mil IS NOT NULL AND month >= '2001-06')", f"past AS ({BASE_SQL.format('va')})", f"rows_ AS ({BASE_SQL.format('te')})",
    "own AS (SELECT property_type, quantile_cont(price_m2_mil / base, 0.1) AS lo, quantile_cont(price_m2_mil / base, 0.9) AS hi FROM past GROUP BY 1)",
    "al AS (SELECT quantile_cont(price_m2_mil / base, 0.1) AS lo, quantile_cont(price_m2_mil / base, 0.9) AS hi FROM past)"))
def c18_valuation(spark, d):
    """Baseline of the place, interval of the ratios of a later period, verdict on the asking price of the last one."""
    v = view(spark, d).where("price_m2_mil IS NOT NULL").select("listing_id", "source_row", "province", "district", "ward", "property_type", "area_m2", "month", "price_m2_mil")
    v = materialize(v, "valued")
    levels = [["province", "district", "ward"], ["province", "district"], ["province"]]
    train, past, rows = v.where("month < '2000-01'"), v.where("month >= '2000-01' AND month < '2001-06'"), v.where("month >= '2001-06'")
    medians = valuation.level_medians(train, levels, "price_m2_mil")
    ratios = materialize(valuation.baseline(train, past, levels, "price_m2_mil", medians=medians).select("property_type", "price_m2_mil", "base"), "ratios")
    interval = valuation.ratio_interval(ratios, "price_m2_mil", "base", "property_type")
    found = valuation.valuate(valuation.baseline(train, rows, levels, "price_m2_mil", medians=medians).withColumnRenamed("base", "predicted"), interval, "property_type", "price_m2_mil")
    return found.select("listing_id", "source_row", F.round(F.col("predicted") * 1e6 * F.col("area_m2"), 0).alias("predicted_vnd"), r4("low").alias("low"), r4("high").alias("high"), "verdict")


@query()
def c19_communities(spark, d):
    p = graph.ward_profiles(graph.keyed(view(spark, d)), KINDS)
    pairs = graph.nearest_neighbours(p, "wk", ["median_m2", "log_n"], 5)
    return graph.label_propagation(pairs)


WARDS_SQL = "SELECT wk FROM g WHERE deal_type = 'sale' AND price_m2_mil IS NOT NULL AND wk IS NOT NULL GROUP BY 1 HAVING count(*) >= 8"


def ward_graph(spark, d):
    """Neighbours of the ward profiles: the log of the price, the log of the size and the share of every type."""
    p = graph.ward_profiles(graph.keyed(view(spark, d)), KINDS).withColumn("log_m2", F.log("median_m2"))
    return materialize(graph.nearest_neighbours(p, "wk", ["log_m2", "log_n", *[f"share_{k.lower()}" for k in KINDS]], 5), "ward-graph")


@query(with_listings(f"SELECT count(*) AS wards, true AS connected, true AS above_propagation, true AS grouped FROM ({WARDS_SQL})", KEYED))
def c19_modularity_communities(spark, d):
    """The communities of the ward graph: each is connected, and their modularity is not below that of label propagation."""
    pairs = ward_graph(spark, d)
    found = communities.modular_communities(pairs)
    own, other = (graph.modularity(pairs, x).first()["modularity"] for x in (found, graph.label_propagation(pairs)))
    counts = found.agg(F.count("*").alias("wards"), (F.countDistinct("community") < F.count("*")).alias("grouped"))
    return counts.select("wards", F.lit(communities.unconnected(pairs, found).isEmpty()).alias("connected"), F.lit(own >= other - 1e-12).alias("above_propagation"), "grouped")


@query(with_listings(f"SELECT wk AS node, true AS named FROM ({WARDS_SQL})", KEYED))
def c19_ward_communities(spark, d):
    """Every ward once, with a community that is named by one of the wards."""
    found = communities.modular_communities(ward_graph(spark, d))
    names = found.select(F.col("node").alias("community"))
    return found.join(names.withColumn("named", F.lit(True)), "community", "left").select("node", F.coalesce("named", F.lit(False)).alias("named"))


@query("SELECT round(5.0 / 14, 6) AS modularity")
def c20_modularity(spark, d):
    pairs = literals(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)], ["a", "b"])
    label = literals(spark, [(i, 0 if i < 4 else 1) for i in range(1, 7)], ["node", "community"])
    return graph.modularity(pairs, label).select(F.round("modularity", 6).alias("modularity"))


METRICS_SQL = """SELECT {0} q, ql AS label, round(count(*) FILTER (WHERE hit AND r <= 5) / least(min(n), 5)::DOUBLE, 4) AS recall_5, round(count(*) FILTER (WHERE hit AND r <= 10) / least(min(n), 10)::DOUBLE, 4) AS recall_10,
        round(coalesce(1.0 / min(r) FILTER (WHERE hit), 0), 4) AS mrr, round(coalesce(sum(1 / log2(r + 1)) FILTER (WHERE hit AND r <= 10), 0) / min(ideal), 4) AS ndcg_10
    FROM {1} JOIN rel USING (q) GROUP BY ALL"""
RELEVANT_SQL = """rel AS (SELECT q, n, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n) AS ideal FROM (SELECT q, count(*) FILTER (WHERE dl = ql AND doc_id <> q) AS n FROM s GROUP BY 1) WHERE n > 0)"""


def relevant(e, q):
    """q, label, n_rel: the number of other vectors of the query's label."""
    n = e.groupBy("label").agg(F.count("*").alias("all"))
    return q.select(F.col("vec_id").alias("q"), "label").join(n, "label").where("all > 1").select("q", "label", (F.col("all") - 1).alias("n_rel"))


def judged(hits, e, rel):
    return hits.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id").join(rel, "q").withColumn("hit", F.col("dl") == F.col("label"))


@query(f"WITH {DENSE_SQL}, {RELEVANT_SQL}, h AS (SELECT q, ql, dl = ql AS hit, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM s WHERE doc_id <> q QUALIFY r <= 50) {METRICS_SQL.format('', 'h')}")
def c22_retrieval_metrics(spark, d):
    """Every fiftieth vector against all others; rows of its label are relevant."""
    e, q = vectors(spark, d)
    rel = relevant(e, q)
    hits = judged(search.dense_batch(e, q, "vec_id", "embedding", 50, others=True), e, rel)
    return rounded(evaluation.ranked_metrics(hits, rel, "q", "label"))


CASES = [
    ("107,14 triệu", "giá?", "lookup", "value", "107.14", None, None, 2), ("120", "giá?", "lookup", "value", "107.14", None, None, 1), ("200", "giá?", "lookup", "value", "107.14", None, None, 0),
    ("Không có dữ liệu", "?", "unanswerable", "refusal", None, None, None, 2), ("Không tìm thấy gì", "?", "lookup", "value", "5", None, None, 0), ("khoảng 5 đến 6 tỷ", "?", "valuation", "value", "5.5", 0.15, None, 2),
    ("Tháng 7/2025", "?", "trend", "value", "2025-07", None, None, 2), ("Quận 1 cao hơn Quận 3", "Quận 1 hay Quận 3?", "comparison", "value", "Quận 1", None, None, 2),
    ("Quận 3 cao hơn Quận 1", "Quận 1 hay Quận 3?", "comparison", "value", "Quận 1", None, None, 0), ("", "?", "lookup", "ids", None, None, 0.85, 2), ("", "?", "lookup", "ids", None, None, 0.2, 1), ("giảm 13,46%", "?", "trend", "value", "-13.46", None, None, 2),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {c[-1]})" for i, c in enumerate(CASES)) + ") t(id, points)")
def c23_rule_scoring(spark, d):
    rows = [(i, *c[:-1]) for i, c in enumerate(CASES)]
    typed = literals(spark, [(i, a, q, c, k, g, float(t) if t is not None else -1.0, float(r) if r is not None else -1.0) for i, a, q, c, k, g, t, r in rows], ["id", "answer", "question", "category", "gt_kind", "gt_value", "value_tolerance", "recall_5"])
    typed = typed.withColumns({k: F.when(F.col(k) >= 0, F.col(k)) for k in ("value_tolerance", "recall_5")})
    return evaluation.score_answers(typed).select("id", "points")


@query("SELECT count(quality) AS n, round(avg(quality), 6) AS mean, true AS near_normal FROM labels")
def c24_bootstrap(spark, d):
    """Resamples of all labels; the interval must be that of the normal distribution, to a tenth of its width."""
    b = evaluation.bootstrap_counts(table(spark, d, "labels"), "quality", 10_000).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    y = table(spark, d, "labels").agg(F.count("quality").alias("n"), F.avg("quality").alias("mean"), F.stddev_pop("quality").alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    near = lambda c, to: F.abs(F.col(c) - to) <= 0.2 * half
    return y.join(F.broadcast(b)).select("n", F.round("mean", 6).alias("mean"), (near("low", F.col("mean") - half) & near("high", F.col("mean") + half)).alias("near_normal"))


@query()
def c24_bootstrap_interval(spark, d):
    labels = table(spark, d, "labels")
    b = evaluation.bootstrap_counts(labels, "quality", 10_000).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return labels.agg(F.count("quality").alias("n"), F.avg("quality").alias("mean")).join(F.broadcast(b))


@query("SELECT * FROM (VALUES (0, 'runtime_error'), (1, 'refusal_missing'), (2, 'router_wrong'), (3, 'retrieval_miss'), (4, NULL), (5, 'insufficient_context')) t(id, cause)")
def c25_error_causes(spark, d):
    rows = [(0, 0, "rag", "", "boom", "lookup", "r", "r", "value"), (1, 0, "rag", "x", "", "unanswerable", "r", "r", "refusal"), (2, 0, "hybrid", "x", "", "lookup", "a", "b", "value"), (3, 0, "rag", "x", "", "lookup", "r", "r", "ids"), (4, 2, "rag", "x", "", "lookup", "r", "r", "value"), (5, 1, "rag", "không có dữ liệu", "", "lookup", "r", "r", "value")]
    t = literals(spark, rows, ["id", "points", "system", "answer", "error", "category", "route", "route_gold", "gt_kind"])
    t = t.withColumns({"error": F.when(F.col("error") != "", F.col("error")), "cypher": F.lit(None).cast("string"), "recall_5": F.lit(0.0), "unsupported": F.array().cast("array<bigint>"), "faithfulness": F.lit(None).cast("double")})
    return t.select("id", evaluation.error_cause().alias("cause"))


#: The grid: whole vectors or their first 16 components, with or without a filter before the search, with or without a
#: second scoring of the best 20 by whole vectors.
GRID = [(r, f, again) for r in ("whole", "short") for f in (False, True) for again in (False, True)]
SHORT_SQL = DENSE_SQL.replace("AS score FROM", "AS whole, round(list_cosine_similarity(embedding[1:16]::DOUBLE[], v[1:16]), 9) AS short FROM")


def _run_sql(r, f, again):
    first = f"SELECT * FROM s WHERE doc_id <> q AND ({'dl < 5' if f else 'true'}) QUALIFY row_number() OVER (PARTITION BY q ORDER BY {r} DESC, doc_id) <= 20"
    order = "whole" if again else r
    return f"SELECT '{r}' AS retriever, {f} AS prefilter, {again} AS rerank, q, ql, dl = ql AS hit, row_number() OVER (PARTITION BY q ORDER BY {order} DESC, doc_id) AS r FROM ({first})"


@query(f"""WITH {SHORT_SQL}, {RELEVANT_SQL}, h AS ({' UNION ALL '.join(_run_sql(*g) for g in GRID)}), m AS ({METRICS_SQL.format('retriever, prefilter, rerank,', 'h')}),
    allq AS (SELECT DISTINCT h.retriever, h.prefilter, h.rerank, rel.q FROM h, rel)
    SELECT retriever, prefilter, rerank, round(avg(coalesce(recall_5, 0)), 3) AS recall_5, round(avg(coalesce(mrr, 0)), 3) AS mrr, round(avg(coalesce(ndcg_10, 0)), 3) AS ndcg_10, count(*) AS n FROM allq LEFT JOIN m USING (retriever, prefilter, rerank, q) GROUP BY ALL""")
def c26_ablation_grid(spark, d):
    e, q = vectors(spark, d)
    both = [x.withColumn("short", F.slice("embedding", 1, 16)) for x in (e, q)]
    rel, out = relevant(e, q), None
    for r, f, again in GRID:
        hits = search.dense_batch(*both, "vec_id", {"whole": "embedding", "short": "short"}[r], 20, F.col("label") < 5 if f else None, others=True)
        if again:
            pair = hits.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x")), "doc_id").join(q.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), "q")
            hits = search.best_rows(pair.select("q", "doc_id", F.round(V.cosine(F.col("x"), F.col("v")), 9).alias("score")), 20)
        m = evaluation.ranked_metrics(judged(hits, e, rel), rel, "q", "label")
        m = rounded(m).agg(*[F.round(F.avg(c), 3).alias(c) for c in ("recall_5", "mrr", "ndcg_10")], F.count("*").alias("n"))
        m = m.select(F.lit(r).alias("retriever"), F.lit(f).alias("prefilter"), F.lit(again).alias("rerank"), "*")
        out = m if out is None else out.unionByName(m)
    return out


@query(with_listings("""SELECT name, tier FROM (SELECT name, min(tier) AS tier, min((tier, outside, -n)) AS r FROM (
        SELECT street AS name, count(*) AS n, CASE WHEN lower(street) = 'street 1' THEN 0 ELSE 1 END AS tier, (province <> (SELECT min(r_name) FROM region))::INT AS outside
        FROM listings WHERE street IS NOT NULL AND contains(' ' || lower(street) || ' ', ' street 1 ') GROUP BY street, district, province) GROUP BY 1) ORDER BY r, name LIMIT 20"""))
def c27_resolve_names(spark, d):
    """A street with its prefix and its province behind it."""
    top = table(spark, d, "region").agg(F.min("r_name")).first()[0]
    v = names.vocabulary(listings(spark, d), "street")
    return names.resolve(v, f"Đường Street 1, {top}", province=top, field="street").select("name", "tier")


@query(with_listings("""SELECT name, tier FROM (SELECT project AS name, 2 AS tier, min(((district <> 'x')::INT, -n)) AS r FROM (
        SELECT project, district, province, count(*) AS n FROM listings WHERE project = 'Brand#12' GROUP BY ALL) GROUP BY 1) ORDER BY r LIMIT 20"""))
def c27_names_within(spark, d):
    """A project that stands within the asked text, behind a prefix."""
    return names.resolve(names.vocabulary(listings(spark, d), "project"), "Chung cư Brand 12 Tower").select("name", "tier")


@query(with_listings("SELECT month, n, round(median_price_m2_mil, 4) AS median_price_m2_mil FROM ms WHERE area_key = (SELECT min(r_name) FROM region WHERE r_regionkey = 2) AND month <> 'ALL' AND property_type = 'ALL' AND deal_type = 'sale'", *G_MS))
def c28_market_series(spark, d):
    top = table(spark, d, "region").where("r_regionkey = 2").first()["r_name"]
    return rounded(market.series(market.market_stats(view(spark, d), deals=("sale",), area=lambda k: k == top, by=((False, True),), measures=market.MEDIAN), top))


@query(with_listings("SELECT area_key, n, round(median_price_m2_mil, 4) AS median_price_m2_mil FROM ms WHERE scope = 'district' AND starts_with(area_key, (SELECT min(r_name) FROM region WHERE r_regionkey = 2) || '|') AND month = 'ALL' AND property_type = 'ALL' AND deal_type = 'sale' AND n >= 20 ORDER BY ms.median_price_m2_mil DESC, area_key LIMIT 10", *G_MS))
def c28_child_areas(spark, d):
    top = table(spark, d, "region").where("r_regionkey = 2").first()["r_name"]
    return rounded(market.children(market.market_stats(view(spark, d), deals=("sale",), of=("district",), area=lambda k: k.startswith(top + "|"), by=((False, False),), measures=market.MEDIAN), top, "district"))


@query(with_listings("SELECT listing_id, source_row, (count(*) OVER (PARTITION BY dup_cluster_id) - 1)::BIGINT AS others FROM v_listings"))
def c29_cluster_size(spark, d):
    v = view(spark, d).select("listing_id", "source_row", "dup_cluster_id")
    n = v.groupBy("dup_cluster_id").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("others"))
    return v.join(n, "dup_cluster_id").select("listing_id", "source_row", "others")


@query(with_listings("SELECT province, list_sort(list(DISTINCT district)) AS districts, list_sort(list(DISTINCT month)) AS months FROM v_listings GROUP BY 1"))
def c30_filter_options(spark, d):
    return market.filter_options(view(spark, d))


@query("SELECT step, ran, n FROM (VALUES ('first', true, 0), ('again', false, 0), ('changed', true, 100000)) t(step, ran, least), LATERAL (SELECT count(*) AS n FROM orders WHERE o_totalprice > least)")
def c32_incremental_run(spark, d):
    """A stage that writes its output: the second run finds it up to date, a third with another threshold does not."""
    m, path, ran = io.Manifest(spark, scratch(spark, "manifest")), scratch(spark, "stage"), []
    for step, least in (("first", 0), ("again", 0), ("changed", 100_000)):
        state = f"{io.fingerprint(spark, f'{d}/orders.parquet')}-{least}"
        done = m.run("orders", state, lambda least=least: table(spark, d, "orders").where(F.col("o_totalprice") > least).write.mode("overwrite").parquet(path))
        ran.append((step, done, spark.read.parquet(path).count()))
    return literals(spark, ran, ["step", "ran", "n"])


@query("SELECT s_suppkey, CASE WHEN abs(s_acctbal - 4000) / 4000 <= 0.1 THEN 2 WHEN abs(s_acctbal - 4000) / 4000 <= 0.2 THEN 1 ELSE 0 END AS points FROM supplier")
def c33_point_bands(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", evaluation.error_points(F.col("s_acctbal"), F.lit(4000.0), 0.1).alias("points"))


@query(f"""WITH {DENSE_SQL}, {RELEVANT_SQL}, h AS (SELECT q, ql, dl = ql AS hit, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM s WHERE doc_id <> q QUALIFY r <= 50), m AS ({METRICS_SQL.format('', 'h')})
    SELECT label, round(avg(recall_5), 3) AS recall_5, round(avg(recall_10), 3) AS recall_10, round(avg(mrr), 3) AS mrr, round(avg(ndcg_10), 3) AS ndcg_10, count(*) AS n FROM m GROUP BY 1""")
def c34_run_summary(spark, d):
    return rounded(evaluation.run_summary(c22_retrieval_metrics(spark, d), "label"), 3)


@query("SELECT conv_id::VARCHAR AS id, role AS system FROM conversations WHERE turn = 0 AND conv_id % 4 <> 0")
def c35_rescore(spark, d):
    a = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("system"), F.col("text").alias("answer"), F.lit("rag").alias("route"))
    old = a.where("cast(id as bigint) % 4 IN (0, 1)").select("id", "system", F.sha2(F.to_json(F.struct("answer", "route")), 256).alias("digest"), F.when(F.col("id").cast("bigint") % 4 == 1, "v0").otherwise("v1").alias("rules_version"), F.lit(None).cast("string").alias("judge_error"))
    return evaluation.rescore(a, old, "v1").select("id", "system")


# Graph templates


@query(with_listings("SELECT area_key, property_type, n, round(median_price_m2_mil, 4) AS med FROM ms WHERE scope = 'district' AND month = 'ALL' AND deal_type = 'sale' AND property_type = 'PROMO' AND n >= 20 ORDER BY median_price_m2_mil DESC, area_key LIMIT 1", *G_MS))
def g01_dearest_district(spark, d):
    m = market.market_stats(view(spark, d).where("property_type = 'PROMO'"), deals=("sale",), of=("district",), by=((True, False),), measures=market.MEDIAN).where("scope = 'district' AND month = 'ALL' AND deal_type = 'sale' AND property_type = 'PROMO' AND n >= 20")
    return m.orderBy(F.desc("median_price_m2_mil"), "area_key").limit(1).select("area_key", "property_type", "n", r4("median_price_m2_mil").alias("med"))


@query(with_listings("SELECT area_key, deal_type, n, round(median_price_m2_mil, 4) AS med FROM ms WHERE scope = 'province' AND month = 'ALL' AND property_type = 'ALL'", *G_MS))
def g02_compare_areas(spark, d):
    m = market.market_stats(view(spark, d), of=("province",), by=((False, False),), measures=market.MEDIAN).where("scope = 'province' AND month = 'ALL' AND property_type = 'ALL'")
    return m.select("area_key", "deal_type", "n", r4("median_price_m2_mil").alias("med"))


@query(with_listings("SELECT province, count(*) AS n FROM v_listings WHERE month = '1998-05' GROUP BY 1 ORDER BY n DESC, province LIMIT 5"))
def g04_busiest_provinces(spark, d):
    return view(spark, d).where("month = '1998-05'").groupBy("province").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "province").limit(5)


@query(with_listings("""SELECT c.area_key AS src, p.area_key AS dst, round(c.median_price_m2_mil, 4) AS own, round(p.median_price_m2_mil, 4) AS above, round((c.median_price_m2_mil - p.median_price_m2_mil) / p.median_price_m2_mil, 4) + 0.0 AS diff
    FROM (SELECT prk, dk FROM (SELECT prk, dk, row_number() OVER (PARTITION BY prk ORDER BY count(*) DESC, dk) AS r FROM g WHERE prk IS NOT NULL AND dk IS NOT NULL GROUP BY 1, 2) WHERE r = 1) l
    JOIN ms c ON c.area_key = l.prk AND c.scope = 'project' JOIN ms p ON p.area_key = l.dk AND p.scope = 'district'
    WHERE c.month = 'ALL' AND c.property_type = 'ALL' AND c.deal_type = 'sale' AND p.month = 'ALL' AND p.property_type = 'ALL' AND p.deal_type = 'sale'""", *G_MS))
def g05_project_against_district(spark, d):
    g = graph.keyed(view(spark, d))
    e = graph.edges(g, list(AMENITY_NAMES))
    return rounded(graph.relative_to_parent(market.market_stats(view(spark, d), deals=("sale",), of=("project", "district"), by=((False, False),), measures=market.MEDIAN), "project", "district", graph.hop(e, "IN_DISTRICT", "Project", "District")))


@query(with_listings("""SELECT c.area_key AS src, p.area_key AS dst, round((c.median_price_m2_mil - p.median_price_m2_mil) / p.median_price_m2_mil, 4) + 0.0 AS diff FROM ms c JOIN ms p ON p.scope = 'province' AND p.area_key = split_part(c.area_key, '|', 1)
    WHERE c.scope = 'district' AND c.month = 'ALL' AND c.property_type = 'ALL' AND c.deal_type = 'sale' AND p.month = 'ALL' AND p.property_type = 'ALL' AND p.deal_type = 'sale'""", *G_MS))
def g06_district_against_province(spark, d):
    e = graph.edges(graph.keyed(view(spark, d)), list(AMENITY_NAMES))
    return rounded(graph.relative_to_parent(market.market_stats(view(spark, d), deals=("sale",), of=("district", "province"), by=((False, False),), measures=market.MEDIAN), "district", "province", graph.hop(e, "IN_PROVINCE", "District", "Province"))).select("src", "dst", "diff")


@query(with_listings("SELECT dk AS dst, count(DISTINCT listing_id) AS n FROM g WHERE dk IS NOT NULL GROUP BY 1", KEYED))
def g07_listings_of_district(spark, d):
    """Paths of one or two edges: listings without a ward hang on the district itself."""
    e = graph.edges(graph.keyed(view(spark, d)), list(AMENITY_NAMES))
    return graph.one_or_two(e, ("IN_WARD", "IN_DISTRICT"), "Listing", "District").groupBy("dst").agg(F.count("*").alias("n"))


@query(with_listings("SELECT sk AS key, count(*) AS n_listings FROM g WHERE sk IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", KEYED))
def g08_busiest_streets(spark, d):
    return graph.nodes(graph.keyed(view(spark, d)), "Street").select("key", "n_listings").orderBy(F.desc("n_listings"), "key").limit(10)


@query(with_listings("SELECT dk AS dst, count(DISTINCT listing_id) AS n FROM g WHERE list_contains(amenities, 'gara') GROUP BY 1", KEYED))
def g09_amenity_in_district(spark, d):
    # An id may have several rows here, so the path starts from rows with the amenity.
    g = graph.keyed(view(spark, d)).where(F.array_contains("amenities", "gara"))
    e = graph.edges(g, list(AMENITY_NAMES))
    paths = graph.one_or_two(e, ("IN_WARD", "IN_DISTRICT"), "Listing", "District")
    has = graph.hop(e, "HAS_AMENITY", "Listing", "Amenity").where("dst = 'gara'").select("src")
    return paths.join(has, "src", "left_semi").groupBy("dst").agg(F.countDistinct("src").alias("n"))


@query("SELECT s_suppkey::VARCHAR AS key, s_nationkey AS cluster_id FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 3) AND s_suppkey <> 3")
def g10_similar_wards(spark, d):
    m = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_nationkey").alias("cluster_id"))
    return graph.co_members(m, "3")


@query(with_listings("SELECT DISTINCT 'IN_WARD' AS type, 'Listing' AS label, listing_id::VARCHAR AS key FROM g WHERE wk = (SELECT min(wk) FROM g) ORDER BY type, label, key LIMIT 41", KEYED))
def g11_subgraph(spark, d):
    g = graph.keyed(view(spark, d)).where("wk IS NOT NULL")
    key = g.agg(F.min("wk")).first()[0]
    return graph.neighbourhood(graph.edges(g, list(AMENITY_NAMES)).where("type = 'IN_WARD'").distinct(), "Ward", key, 40)


@query("SELECT c_custkey::VARCHAR AS src, r_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def g13_fixed_path(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    edge = lambda df, sl, s, k, dl, t: df.select(F.lit(sl).alias("src_label"), F.col(s).cast("string").alias("src"), F.lit(k).alias("type"), F.lit(dl).alias("dst_label"), F.col(t).cast("string").alias("dst"))
    e = edge(c, "Listing", "c_custkey", "IN_WARD", "Ward", "c_nationkey").unionByName(edge(n, "Ward", "n_nationkey", "IN_DISTRICT", "District", "n_regionkey")).unionByName(edge(r, "District", "r_regionkey", "IN_PROVINCE", "Province", "r_name"))
    return graph.chain(e, ("IN_WARD", "Listing", "Ward"), ("IN_DISTRICT", "Ward", "District"), ("IN_PROVINCE", "District", "Province"))


@query(with_listings("""SELECT 'Listing' AS src_label, 'OF_TYPE' AS type, 'PropertyType' AS dst_label, count(*) AS n FROM g UNION ALL SELECT 'Listing', 'IN_WARD', 'Ward', count(*) FROM g WHERE wk IS NOT NULL
    UNION ALL SELECT 'Listing', 'IN_DISTRICT', 'District', count(*) FROM g WHERE wk IS NULL AND dk IS NOT NULL UNION ALL SELECT 'Listing', 'ON_STREET', 'Street', count(*) FROM g WHERE sk IS NOT NULL
    UNION ALL SELECT 'Listing', 'IN_PROJECT', 'Project', count(*) FROM g WHERE prk IS NOT NULL UNION ALL SELECT 'Listing', 'POSTED_IN', 'Month', count(*) FROM g
    UNION ALL SELECT 'Listing', 'HAS_AMENITY', 'Amenity', count(*) FROM (SELECT DISTINCT listing_id, unnest(amenities) FROM g)
    UNION ALL SELECT 'Ward', 'IN_DISTRICT', 'District', count(*) FROM (SELECT DISTINCT wk, dk FROM g WHERE wk IS NOT NULL) UNION ALL SELECT 'Street', 'IN_DISTRICT', 'District', count(*) FROM (SELECT DISTINCT sk, dk FROM g WHERE sk IS NOT NULL)
    UNION ALL SELECT 'Project', 'IN_DISTRICT', 'District', count(DISTINCT prk) FROM g WHERE prk IS NOT NULL UNION ALL SELECT 'District', 'IN_PROVINCE', 'Province', count(DISTINCT dk) FROM g""", KEYED))
def g14_invariants(spark, d):
    return graph.invariants(graph.edges(graph.keyed(view(spark, d)), list(AMENITY_NAMES)))


@query(with_listings("SELECT dst_label, count(*) AS n FROM (SELECT upper(left(scope, 1)) || substr(scope, 2) AS dst_label FROM ms) GROUP BY 1", *G_MS))
def g14_stat_edges(spark, d):
    return graph.stat_edges(market.market_stats(view(spark, d), measures={})).groupBy("dst_label").agg(F.count("*").alias("n"))
