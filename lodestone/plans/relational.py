"""Queries for scans, filters, joins, aggregates, windows, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import clean, dedup, filters, graph, market, search
from lodestone.plans.bindings import AMENITY_NAMES, KEYED, MARKET, listings, table, view, with_listings
from lodestone.plans.registry import query, r4, rounded
from lodestone.session import materialize, scratch
from lodestone.sources import io
from lodestone.streaming import limiter

PERIOD = ("1995-01", "2001-12")


# Scans, sources, sinks


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def s01_pruned_scan(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT count(*) AS n FROM orders")
def s02_glob_scan(spark, d):
    return spark.read.parquet(f"{d}/orders.parq*").agg(F.count("*").alias("n"))


@query(with_listings("SELECT province, count(*) AS n, round(avg(price_m2_mil), 4) AS mean_m2 FROM v_listings WHERE deal_type = 'sale' GROUP BY province"))
def s03_published_view(spark, d):
    io.as_view(view(spark, d), "v_listings")
    return filters.gated_sql(spark, "SELECT province, count(*) AS n, round(avg(price_m2_mil), 4) AS mean_m2 FROM v_listings WHERE deal_type = 'sale' GROUP BY province")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def s04_range_scan(spark, d):
    return io.read_range(table(spark, d, "orders"), "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def s05_point_lookup(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 42").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def s06_csv_dimension(spark, d):
    path = scratch(spark, "nation-csv")
    io.write_csv(table(spark, d, "nation").select("n_name", "n_regionkey"), path)
    dim = io.read_csv(spark, path, schemas.struct("n_name string, n_regionkey int"))
    return dim.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT key, name FROM (VALUES ('gara', 'Gara'), ('ho_boi', 'Hồ bơi'), ('an_ninh', 'An ninh 24/7')) t(key, name)")
def s07_dictionary(spark, d):
    return graph.nodes(spark.range(1), "Amenity", AMENITY_NAMES)


@query("SELECT conv_id AS id, role AS system, max(turn) AS seq FROM conversations GROUP BY 1, 2")
def s08_jsonl_last_wins(spark, d):
    path = scratch(spark, "answers-jsonl")
    io.append_jsonl(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("system"), F.col("turn").alias("seq"), "text"), path)
    from lodestone.operators.evaluation import latest

    rows = io.read_jsonl(spark, path, schemas.struct("id bigint, system string, seq bigint, text string"))
    return latest(rows, ["id", "system"], "seq").select("id", "system", "seq")


@query("SELECT item_id AS id, length(text) AS n_chars FROM benchmark")
def s09_question_read(spark, d):
    path = scratch(spark, "questions-jsonl")
    io.append_jsonl(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), path)
    return io.read_questions(spark, path, schemas.struct("id bigint, text string")).select("id", F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT count(*) AS n FROM nation")
def s10_frame_as_relation(spark, d):
    io.as_view(table(spark, d, "nation"), "own_nation")
    return spark.sql("SELECT count(*) AS n FROM own_nation")


@query("SELECT c_custkey, c_acctbal FROM customer")
def s11_sorted_sink(spark, d):
    path = scratch(spark, "customer-sorted")
    io.write_sorted(table(spark, d, "customer"), path, "c_custkey")
    return spark.read.parquet(path).select("c_custkey", "c_acctbal")


@query("SELECT s_suppkey, s_name FROM supplier")
def s12_csv_sink(spark, d):
    path = scratch(spark, "supplier-csv")
    io.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    return io.read_csv(spark, path, schemas.struct("s_suppkey bigint, s_name string"))


@query("SELECT count(*) * 2 AS n FROM region")
def s14_jsonl_append(spark, d):
    path = scratch(spark, "region-jsonl")
    for _ in range(2):
        io.append_jsonl(table(spark, d, "region"), path)
    return io.read_jsonl(spark, path, schemas.struct("r_regionkey int, r_name string")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, len(embedding)::BIGINT AS dims FROM embeddings")
def s15_vectors_as_arrays(spark, d):
    return io.check_dimension(table(spark, d, "embeddings"), "embedding", 64).select("vec_id", F.size("embedding").cast("bigint").alias("dims"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END::INTEGER AS label FROM embeddings")
def s16_upsert(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 3 = 0").withColumn("label", F.lit(-1))
    once = io.upsert(e, new, "vec_id")
    return io.upsert(once, new, "vec_id")


@query("SELECT r_name FROM region WHERE r_regionkey >= 2")
def s18_alias_swap(spark, d):
    r = table(spark, d, "region")
    io.swap_view(spark, "live_regions", r.where("r_regionkey < 2"))
    io.swap_view(spark, "live_regions", r.where("r_regionkey >= 2"))
    return spark.table("live_regions").select("r_name")


@query("SELECT 0::BIGINT AS bad")
def s19_graph_integrity(spark, d):
    whole = graph.keyed(view(spark, d))
    columns = ["listing_id", "property_type", "deal_type", "price_m2_mil", "province", "district", "ward", "street", "project", "month", "amenities", "dk", "wk", "sk", "prk"]
    g = materialize(whole.select(*columns), "keyed")  # read by twelve passes
    labels = ["Listing", "PropertyType", "Province", "District", "Ward", "Street", "Project", "Month"]
    keys = [graph.nodes(whole if x == "Listing" else g, x).select(F.lit(x).alias("label"), "key") for x in labels] + [graph.nodes(g, "Amenity", AMENITY_NAMES).select(F.lit("Amenity").alias("label"), "key")]
    n = keys[0]
    for k in keys[1:]:
        n = n.unionByName(k)
    return graph.dangling(graph.edges(g, list(AMENITY_NAMES)), n).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("bad"))


@query("SELECT count(*) AS n FROM customer")
def s20_unique_keys(spark, d):
    return io.check_unique(table(spark, d, "customer"), "c_custkey").agg(F.count("*").alias("n"))


@query(with_listings("SELECT count(*) AS n, sum(price_vnd::DECIMAL(38, 6))::DOUBLE AS checksum FROM listings"))
def s21_fingerprint(spark, d):
    return market.fingerprint(listings(spark, d))


@query(with_listings("SELECT project AS name, district, province, count(*) AS n FROM listings WHERE project IS NOT NULL GROUP BY ALL"))
def s23_name_vocabulary(spark, d):
    """Kept in the shared folder for as long as the source files are the same."""
    from lodestone.operators.names import vocabulary

    sources = [f"{d}/{t}.parquet" for t in ("lineitem", "part", "supplier", "nation", "region")]
    path = io.cached(spark, "vocabulary-project", sources, lambda to: vocabulary(listings(spark, d), "project").write.parquet(to))
    return spark.read.parquet(path).select("name", "district", "province", "n")


# Projections and filters


@query(with_listings("SELECT listing_id, source_row, price_bn, price_m2_mil, month FROM v_listings"))
def f01_guarded_projection(spark, d):
    return view(spark, d).select("listing_id", "source_row", "price_bn", "price_m2_mil", "month")


@query("SELECT * EXCLUDE (c_acctbal) FROM customer")
def f02_all_except(spark, d):
    return spark.sql("SELECT * EXCEPT (c_acctbal) FROM {c}", c=table(spark, d, "customer"))


@query("SELECT l_orderkey::BIGINT AS k, l_linenumber::SMALLINT AS line, l_quantity::INTEGER AS qty FROM lineitem")
def f03_typed_projection(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("k"), F.col("l_linenumber").cast("smallint").alias("line"), F.col("l_quantity").cast("int").alias("qty"))


@query(with_listings("SELECT wk, sk, prk, count(*) AS n FROM g GROUP BY ALL", KEYED))
def f04_keys_with_nulls(spark, d):
    return graph.keyed(view(spark, d)).groupBy("wk", "sk", "prk").agg(F.count("*").alias("n"))


CASE = dict(province="REGION_1", deal_type="sale", price_min=1000.0, price_max=5000.0, area_min=10.0, bedrooms=3, month_from="1996-01", month_to="1997-06")
CASE_SQL = """province = (SELECT min(r_name) FROM region WHERE r_regionkey = 1) AND deal_type = 'sale' AND bedrooms = 3 AND price_vnd >= 1000e6 AND price_vnd <= 5000e6
    AND area_m2 >= 10 AND month BETWEEN '1996-01' AND '1997-06'"""


def the_case(spark, d, **more):
    name = table(spark, d, "region").where("r_regionkey = 1").first()["r_name"]
    return filters.validate(CASE | {"province": name} | more)


@query(with_listings(f"SELECT listing_id, source_row FROM v_listings WHERE {CASE_SQL}"))
def f05_filter_conditions(spark, d):
    return view(spark, d).where(filters.compile_filter(filters.conditions(the_case(spark, d), PERIOD))).select("listing_id", "source_row")


@query(with_listings(f"SELECT listing_id, source_row FROM v_listings WHERE {CASE_SQL}"))
def f06_filter_as_sql(spark, d):
    where, args = filters.compile_where(filters.conditions(the_case(spark, d), PERIOD))
    io.as_view(view(spark, d), "v_listings")
    return spark.sql(f"SELECT listing_id, source_row FROM v_listings WHERE {where}", args=args)


@query(with_listings("SELECT count(*) AS n FROM v_listings WHERE bedrooms >= 3 AND bedrooms <= 3"))
def f07_equality_as_range(spark, d):
    return view(spark, d).where(filters.compile_filter([filters.Condition("bedrooms", "gte", 3), filters.Condition("bedrooms", "lte", 3)])).agg(F.count("*").alias("n"))


@query(with_listings("SELECT count(*) AS n FROM v_listings WHERE ward = 'Supplier#000000001'"))
def f08_nulls_never_match(spark, d):
    return view(spark, d).where(filters.compile_filter([filters.Condition("ward", "eq", "Supplier#000000001")])).agg(F.count("*").alias("n"))


@query(with_listings("SELECT month, count(*) AS n FROM v_listings WHERE month IN ('2001-09', '2001-10', '2001-11', '2001-12') GROUP BY 1"))
def f10_month_range_clipped(spark, d):
    f = filters.QueryFilters(month_from="2001-09", month_to="2003-01")
    return view(spark, d).where(filters.compile_filter(filters.conditions(f, PERIOD))).groupBy("month").agg(F.count("*").alias("n"))


@query(with_listings("SELECT project, count(*) AS n FROM v_listings WHERE project IN ('Brand#1', 'Brand#11') GROUP BY 1"))
def f11_resolved_names(spark, d):
    f = filters.QueryFilters(project="brand", street="nowhere")
    names = lambda k, v: ["Brand#1", "Brand#11"] if k == "project" else []
    return view(spark, d).where(filters.compile_filter(filters.conditions(f, PERIOD, names))).groupBy("project").agg(F.count("*").alias("n"))


@query(with_listings("SELECT count(*) AS n, 'filter_relaxed:project' AS note FROM v_listings WHERE province = (SELECT min(r_name) FROM region WHERE r_regionkey = 1) AND bedrooms = 3 AND deal_type = 'sale' AND area_m2 >= 10 AND price_vnd >= 1000e6 AND price_vnd <= 5000e6 AND month BETWEEN '1996-01' AND '1997-06'"))
def f14_staged_relaxation(spark, d):
    rows, note = filters.relax(view(spark, d), the_case(spark, d, project="no such project"), PERIOD)
    return rows.agg(F.count("*").alias("n")).withColumn("note", F.lit(note))


@query("""SELECT CASE WHEN p_name LIKE 'small%' THEN 'dropped_no_text' WHEN p_type NOT IN ('ECONOMY', 'LARGE') THEN 'dropped_bad_type' END AS reason, count(*) AS n
    FROM part GROUP BY 1""")
def f15_drop_reason(spark, d):
    name = F.when(~F.col("p_name").startswith("small"), F.col("p_name"))
    return table(spark, d, "part").groupBy(clean.drop_reason(name, F.lit(None).cast("string"), F.col("p_type"), ("ECONOMY", "LARGE")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 7, 100000)")
def f16_membership(spark, d):
    ids = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (1, 5, 7, 100000)])).alias("c_custkey"))
    return table(spark, d, "customer").join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(with_listings("SELECT listing_id FROM v_listings ORDER BY listing_id, source_row LIMIT 7"))
def f18_row_cap(spark, d):
    io.as_view(view(spark, d), "v_listings")
    return filters.gated_sql(spark, "SELECT listing_id FROM v_listings ORDER BY listing_id, source_row", limit=7)


@query(with_listings("SELECT area_key, n::BIGINT AS n FROM ms WHERE starts_with(area_key, (SELECT min(r_name) FROM region WHERE r_regionkey = 1) || '|') AND scope = 'district' AND month = 'ALL' AND property_type = 'ALL' AND deal_type = 'sale' AND n >= 20", KEYED, MARKET))
def f19_prefix_and_exclusion(spark, d):
    top = table(spark, d, "region").where("r_regionkey = 1").first()["r_name"]
    m = market.market_stats(view(spark, d), deals=("sale",), of=("district",), area=lambda k: k.startswith(top + "|"), by=((False, False),), measures={})
    return m.where(F.col("area_key").startswith(top + "|") & (F.col("scope") == "district") & (F.col("month") == "ALL") & (F.col("property_type") == "ALL") & (F.col("deal_type") == "sale") & (F.col("n") >= 20)).select("area_key", "n")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring')")
def f20_substring(spark, d):
    return table(spark, d, "part").where(F.lower("p_name").contains("ring")).select("p_partkey")


@query(with_listings("SELECT count(*) AS n FROM v_listings WHERE list_contains(amenities, 'gara')"))
def f22_list_membership(spark, d):
    return view(spark, d).where(F.array_contains("amenities", "gara")).agg(F.count("*").alias("n"))


@query(with_listings("SELECT month <= '2000-06' AS is_train, month = '2000-06' AS is_valid, month >= '2000-07' AS is_test, month <= '2000-06' AND month <> '2000-06' AS is_fit, count(*) AS n FROM v_listings GROUP BY 1, 2, 3, 4"))
def f23_time_split(spark, d):
    from lodestone.operators.valuation import time_split

    c = time_split(F.col("month"), "2000-06", "2000-06", "2000-07")
    return view(spark, d).withColumns(c).groupBy(*c).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def f24_first_per_category(spark, d):
    from lodestone.operators.evaluation import stratified

    return stratified(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) ORDER BY r, source LIMIT 25")
def f24_round_robin(spark, d):
    from lodestone.operators.evaluation import round_robin

    return round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 25)


@query(with_listings("SELECT listing_id, source_row, ward, district, province, left(description, 400) AS excerpt, coalesce(dup_cluster_id, listing_id) AS cluster FROM v_listings"))
def f25_cards(spark, d):
    return view(spark, d).select("listing_id", "source_row", F.struct("ward", "district", "province").alias("address"), F.left("description", F.lit(400)).alias("excerpt"), F.coalesce("dup_cluster_id", "listing_id").alias("cluster")).select("listing_id", "source_row", "address.*", "excerpt", "cluster")


@query("SELECT event_id, props FROM events ORDER BY event_id LIMIT 50")
def f26_result_envelope(spark, d):
    return table(spark, d, "events").orderBy("event_id").limit(50).select("event_id", "props")


# Joins


@query(with_listings("""SELECT listing_id, source_row, first_value(source_row) OVER (PARTITION BY listing_id ORDER BY published_at DESC, source_shard, source_row) AS kept_row FROM listings"""))
def j01_winner_by_window(spark, d):
    w = Window.partitionBy("listing_id").orderBy(F.desc("published_at"), "source_shard", "source_row")
    return listings(spark, d).select("listing_id", "source_row", F.first("source_row").over(w).alias("kept_row"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j02_left_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("""SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def j03_inner_joins(spark, d):
    t = lambda n: table(spark, d, n)
    return (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    )


@query(with_listings("SELECT l.ward, min(c) AS c, count(*) AS n FROM listings l JOIN p ON l.ward IS NOT DISTINCT FROM p.ward GROUP BY 1", "p AS (SELECT ward, count(*) AS c FROM listings GROUP BY 1)"))
def j04_null_safe_join(spark, d):
    a = listings(spark, d).select("ward")
    p = a.groupBy(F.col("ward").alias("w")).agg(F.count("*").alias("c"))
    return a.join(p, a["ward"].eqNullSafe(p["w"])).groupBy("ward").agg(F.min("c").alias("c"), F.count("*").alias("n"))


@query(with_listings("SELECT province, count(*) AS n FROM v_listings WHERE district IN (SELECT district FROM v_listings GROUP BY 1 ORDER BY count(*) DESC, district LIMIT 5) GROUP BY 1"))
def j06_semi_join_top(spark, d):
    return market.within_top(view(spark, d), "district", 5).groupBy("province").agg(F.count("*").alias("n"))


@query(with_listings("SELECT wk, property_type, count(*) AS n, round(min(m), 4) AS ward_median FROM (SELECT *, median(price_m2_mil) OVER (PARTITION BY wk) AS m FROM g WHERE wk IS NOT NULL AND deal_type = 'sale' AND price_m2_mil IS NOT NULL) GROUP BY 1, 2", KEYED))
def j07_aggregate_joined_back(spark, d):
    s = graph.keyed(view(spark, d)).where("wk IS NOT NULL AND deal_type = 'sale' AND price_m2_mil IS NOT NULL")
    med = s.groupBy("wk").agg(F.median("price_m2_mil").alias("m"))
    return s.groupBy("wk", "property_type").agg(F.count("*").alias("n")).join(med, "wk").select("wk", "property_type", "n", r4("m").alias("ward_median"))


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def j08_unique_right_side(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(io.check_unique(table(spark, d, "labels"), "doc_id").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def j09_anti_join(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(n_name, 'none') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON c_nationkey = n_nationkey")
def j11_dictionary_lookup(spark, d):
    dim = table(spark, d, "nation").where("n_nationkey < 10")
    return table(spark, d, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


HASHED = "(('0x' || substr(md5(c_name), 1, 15))::BIGINT % 65536)"


@query(f"""WITH h AS (SELECT min(c_custkey) AS id, c_nationkey AS g, {HASHED} AS simhash FROM customer GROUP BY 2, 3)
    SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.g = b.g AND a.id < b.id AND bit_count(xor(a.simhash, b.simhash)) <= 3 WHERE a.simhash <> b.simhash""")
def j12_hamming_pairs(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), (V.sql_key(F.col("c_name")) % 65536).alias("simhash"))
    pairs, _ = dedup.simhash_pairs(rows, "id", ["g"], max_bucket=None)
    return pairs.where("distance > 0").select("a", "b")


@query("""WITH z AS (SELECT s_suppkey AS id, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS x, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS y FROM supplier),
    n AS (SELECT a.id, b.id AS o, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS r FROM z a JOIN z b ON a.id <> b.id)
    SELECT DISTINCT least(id, o) AS a, greatest(id, o) AS b FROM n WHERE r <= 5""")
def j13_nearest_neighbours(spark, d):
    return graph.nearest_neighbours(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"], 5)


@query("""WITH z AS (SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer),
    n AS (SELECT a.id, b.id AS o, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS r FROM z a JOIN z b ON a.id <> b.id)
    SELECT DISTINCT least(id, o) AS a, greatest(id, o) AS b FROM n WHERE r <= 5""")
def j13_customer_neighbours(spark, d):
    return graph.nearest_neighbours(table(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], 5)


@query("SELECT vec_id, label, len(embedding)::BIGINT AS dims FROM embeddings")
def j14_row_aligned_join(spark, d):
    e = table(spark, d, "embeddings")
    return search.keyed_join(e.select("vec_id", "label"), e.select("vec_id", F.size("embedding").cast("bigint").alias("dims")), "vec_id")


@query("SELECT o_custkey, event_type, count(*) AS n FROM orders JOIN events ON o_custkey = user_id AND value BETWEEN o_totalprice / 1e4 * 0.8 AND o_totalprice / 1e4 * 1.2 GROUP BY 1, 2")
def j20_band_join(spark, d):
    o, e = table(spark, d, "orders"), table(spark, d, "events")
    x = F.col("o_totalprice") / 1e4
    return o.join(e, (F.col("o_custkey") == F.col("user_id")) & F.col("value").between(x * 0.8, x * 1.2)).groupBy("o_custkey", "event_type").agg(F.count("*").alias("n"))


@query(with_listings("SELECT count(*) AS n, round(median(price_m2_mil), 4) AS med FROM v_listings WHERE province = 'REGION_X' OR (property_type = 'ECONOMY' AND deal_type = 'sale' AND area_m2 BETWEEN 24 AND 36)"))
def j20_comparables(spark, d):
    return market.comparables(view(spark, d), 30.0, property_type="ECONOMY", deal_type="sale").agg(F.count("*").alias("n"), r4(F.median("price_m2_mil")).alias("med"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def j21_keyed_triple(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "quality", "toxic")


@query("""WITH p AS (SELECT s_suppkey AS id, (s_suppkey % 10)::DOUBLE + 0.5 AS x, (s_suppkey // 10 % 10)::DOUBLE + 0.5 AS y FROM supplier)
    SELECT id, CASE WHEN x < 5 AND y < 5 THEN 'west' WHEN x > 5 AND y < 5 THEN 'east' ELSE NULL END AS area FROM p""")
def j22_spatial_containment(spark, d):
    areas = {"west": [[0, 0], [5, 0], [5, 5], [0, 5]], "east": [[5, 0], [10, 0], [10, 5], [5, 5]]}
    ring = lambda r: F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in r])
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 10) + 0.5).cast("double").alias("x"), (F.floor(F.col("s_suppkey") / 10) % 10 + 0.5).cast("double").alias("y"))
    return p.select("id", F.coalesce(*[F.when(V.point_in_ring(F.col("x"), F.col("y"), ring(r)), F.lit(n)) for n, r in areas.items()]).alias("area"))


@query("SELECT round(avg(CASE WHEN n_nationkey IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def j23_lookup_coverage(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation").where("n_nationkey < 20"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.agg(r4(F.avg(F.col("n_nationkey").isNotNull().cast("double"))).alias("coverage"))


# Windows, sorts, sets


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(trim(lower(text))) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def w01_first_of_duplicates(spark, d):
    w = Window.partitionBy(F.md5(F.trim(F.lower("text")))).orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("doc_id", F.row_number().over(w).alias("r")).where("r = 1").select("doc_id")


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS head FROM documents")
def w02_head_of_group(spark, d):
    w = Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("doc_id", F.first("doc_id").over(w).alias("head"))


@query("SELECT o_custkey, bool_and(o_orderkey > p) AS ordered FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1")
def w04_sortedness(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey", 1, -1).over(w).alias("p")).groupBy("o_custkey").agg(F.bool_and(F.col("o_orderkey") > F.col("p")).alias("ordered"))


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings) WHERE r = 1")
def w05_best_per_group(spark, d):
    hits = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("score"))
    return search.best_chunk(hits, "label", "vec_id").select("label", "vec_id")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY source) AS least FROM documents")
def w09_group_minimum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.min("doc_id").over(Window.partitionBy("source")).alias("least"))


@query("SELECT user_id, round(sum(epoch(coalesce(nxt, TIMESTAMP '2025-01-01')) - epoch(ts)) / 3600, 3) AS hours FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) GROUP BY 1")
def w12_run_durations(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    e = table(spark, d, "events").select("user_id", "ts", F.coalesce(F.lead("ts").over(w), F.lit("2025-01-01").cast("timestamp_ntz")).alias("nxt"))
    return e.groupBy("user_id").agg(F.round(F.sum(sec(F.col("nxt")) - sec(F.col("ts"))) / 3600, 3).alias("hours"))


@query(with_listings("SELECT district AS key, count(*) AS n FROM v_listings GROUP BY 1 ORDER BY n DESC, key LIMIT 10"))
def t02_top_n(spark, d):
    return market.top_areas(view(spark, d), "district", 10).select(F.col("district").alias("key"), "n")


@query("SELECT pos::INTEGER AS pos, c_name FROM customer JOIN (VALUES (0, 7), (1, 3), (2, 9)) t(pos, id) ON c_custkey = id")
def t04_fetch_in_order(spark, d):
    return search.fetch_in_order(table(spark, d, "customer"), "c_custkey", [7, 3, 7, 9, 10_000_000]).select("pos", "c_name")


@query("SELECT [3, 1, 2]::BIGINT[] AS ids")
def t05_ordered_distinct(spark, d):
    return spark.range(1).select(F.slice(F.array_distinct(F.array(*[F.lit(x).cast("bigint") for x in (3, 1, 3, 2, 9)])), 1, 3).alias("ids"))


@query("SELECT doc_id FROM documents ORDER BY ('0x' || substr(md5('42:' || doc_id), 1, 15))::BIGINT, doc_id LIMIT 200")
def t08_repeatable_sample(spark, d):
    return search.sample_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 200)


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def t10_required_union(spark, d):
    return table(spark, d, "documents").select("doc_id").union(table(spark, d, "labels").select("doc_id")).distinct()


@query("SELECT doc_id, (('0x' || substr(md5('42:' || doc_id), 1, 15))::BIGINT % 5)::INTEGER AS fold FROM documents")
def t11_folds(spark, d):
    return table(spark, d, "documents").select("doc_id", search.folds(F.col("doc_id"), 5).alias("fold"))


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s, lang = 'en', lang, doc_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS s FROM documents)) WHERE r <= 3")
def t12_examples(spark, d):
    from lodestone.operators.evaluation import examples

    return examples(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", "lang", "doc_id", 3, "en").select("source", "doc_id")


@query("SELECT part, count(*) AS n FROM (SELECT doc_id // 300 AS part FROM documents) GROUP BY 1")
def t14_buckets_by_id(spark, d):
    return table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 300).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, max(s) AS score FROM (SELECT doc_id, n_chars AS s FROM documents UNION ALL SELECT doc_id, quality * 1000 FROM labels) GROUP BY 1")
def u02_union_keep_best(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("s"))
    b = table(spark, d, "labels").select("doc_id", (F.col("quality").cast("bigint") * 1000).alias("s"))
    return a.unionByName(b).groupBy("doc_id").agg(F.max("s").alias("score"))


@query("SELECT label, len(list_intersect(list(vec_id), range(0, 100)))::BIGINT AS n FROM embeddings GROUP BY 1")
def u03_intersection_size(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.size(F.array_intersect(F.collect_list("vec_id"), F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint")))).cast("bigint").alias("n"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u04_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT label, list_sort(list(vec_id) FILTER (WHERE vec_id % 2 = 0)) AS supported, list_sort(list(vec_id) FILTER (WHERE vec_id % 2 = 1)) AS unsupported FROM embeddings GROUP BY 1")
def u05_partition_list(spark, d):
    ids = table(spark, d, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return ids.select("label", F.filter("ids", lambda x: x % 2 == 0).alias("supported"), F.filter("ids", lambda x: x % 2 == 1).alias("unsupported"))


# Scalar functions over tables


@query(r"SELECT doc_id, md5(trim(lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS h FROM documents")
def x01_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.norm(F.col("text")).cast("binary")).alias("h"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'a b' ELSE c_name END AS v FROM customer")
def x02_normalize_text(spark, d):
    v = F.when(F.col("c_custkey") % 3 == 0, F.lit(" None ")).when(F.col("c_custkey") % 3 == 1, F.lit(" a \n b")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", X.normalize_text(v).alias("v"))


PLACES = [("Q.7", "district", "Quận 7"), ("q7", "district", "Quận 7"), ("07", "district", "Quận 7"), ("Huyện Củ Chi", "district", "Củ Chi"), ("P.5", "ward", "Phường 5"), ("Xã Tân Phú", "ward", "Tân Phú"), ("tphcm", "province", "Hồ Chí Minh"), ("TP. Hồ Chí Minh", "province", "Hồ Chí Minh"), ("None", "province", None)]
values = lambda rows: "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


def literals(spark, rows, names):
    return spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])).alias("r")).select("r.*")


@query(f"SELECT * FROM ({values([(a, k, w) for a, k, w in PLACES])}) t(value, kind, place)")
def x03_normalize_place(spark, d):
    rows = literals(spark, [(a, k) for a, k, _ in PLACES], ["value", "kind"])
    return rows.withColumn("place", F.coalesce(*[F.when(F.col("kind") == k, X.normalize_place(F.col("value"), k)) for k in ("province", "district", "ward")]))


FOLDS = [("Hà Nội Paragon (Paragon Tower)", "ha noi paragon"), ("Đường  Số-5", "duong so 5"), ("Vinhomes Central Park", "vinhomes central park")]


@query(f"SELECT * FROM ({values(FOLDS)}) t(name, key)")
def x05_fold_names(spark, d):
    return literals(spark, [(a,) for a, _ in FOLDS], ["name"]).withColumn("key", X.fold_name("name"))


#: The patterns for an engine without look-around: the signs beside a number are kept, and a second pass takes numbers that
#: shared one.
SQL_PHONE = r"regexp_replace({0}, '(^|[^0-9])(?:\+?84|0)(?:[\t-\r .\-]?[0-9]){{8,10}}($|[^0-9])', '\1[phone_number]\2', 'g')"
SQL_EMAIL = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}.+-]+@[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}-]+\.[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}.]+"


@query(f"SELECT doc_id, md5(regexp_replace({SQL_PHONE.format(SQL_PHONE.format('text'))}, '{SQL_EMAIL}', '[email]', 'g')) AS h FROM documents")
def x09_mask_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.mask_pii(F.col("text")).cast("binary")).alias("h"))


@query("SELECT p_partkey, list_filter([CASE WHEN contains(p_name, 'ring') THEN 'ring' END, CASE WHEN regexp_matches(p_name, 'red|blue') THEN 'colour' END], lambda x: x IS NOT NULL) AS keys FROM part")
def x10_match_dictionary(spark, d):
    return table(spark, d, "part").select("p_partkey", X.match_amenities(F.col("p_name"), {"ring": ["ring"], "colour": ["red", "blue"]}).alias("keys"))


@query(r"SELECT doc_id, md5(nullif(trim(regexp_replace(text, '[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]+', ' ', 'g')), '')) AS h FROM documents")
def x11_clean_controls(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_controls(F.col("text")).cast("binary")).alias("h"))


@query(with_listings("SELECT listing_id, source_row, concat_ws(chr(10), title, concat_ws(' · ', property_type, concat_ws(', ', ward, district, province), 'giá ' || printf('%.2f', price_vnd / 1e9) || ' tỷ', printf('%g', area_m2) || ' m²', bedrooms || ' phòng ngủ')) AS header FROM v_listings"))
def x12_listing_header(spark, d):
    c = F.col
    return view(spark, d).select("listing_id", "source_row", X.listing_header(c("title"), c("property_type"), c("ward"), c("district"), c("province"), c("price_vnd"), c("area_m2"), c("bedrooms")).alias("header"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::BIGINT AS n FROM documents")
def x13_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("bigint").alias("n"))


@query("SELECT * FROM (VALUES ('abc', 891568578::BIGINT), ('the', 1011183078::BIGINT)) t(term, id)")
def x14_token_id(spark, d):
    return literals(spark, [("abc",), ("the",)], ["term"]).withColumn("id", X.token_id(F.col("term")))


@query("SELECT * FROM (VALUES (7.45e9, '7,45 tỷ'), (8.5e8, '850 triệu')) t(price, said)")
def x16_format_vnd(spark, d):
    return literals(spark, [(7.45e9,), (8.5e8,)], ["price"]).withColumn("said", X.format_vnd(F.col("price")))


@query("SELECT [12, 7]::BIGINT[] AS ids")
def x18_citations(spark, d):
    return spark.range(1).select(X.cited_ids(F.lit("theo (tin 12) và [Tin#7], [TIN 12]")).alias("ids"))


MONEY = [("5 tỷ", 5000.0), ("1 tỷ 2", 1200.0), ("2 tỷ 05", 2050.0), ("1 tỷ 50 triệu", 1050.0), ("500k", 0.5), ("vài tỷ", None), ("3.000.000.000", 3000.0), ("850 triệu", 850.0)]


@query(f"SELECT * FROM ({values(MONEY)}) t(said, million)")
def x20_parse_money(spark, d):
    return literals(spark, [(a,) for a, _ in MONEY], ["said"]).withColumn("million", V.money_million(F.col("said")))


@query("SELECT * FROM (VALUES ('1.234.567', 1234567.0::DOUBLE), ('2.500', 2500.0), ('91,26', 91.26), ('1,5,7', NULL)) t(said, number)")
def x21_parse_number(spark, d):
    return literals(spark, [(x,) for x in ("1.234.567", "2.500", "91,26", "1,5,7")], ["said"]).withColumn("number", V.answer_number(F.col("said")))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^small') THEN 'sale' ELSE 'sale' END AS deal FROM part")
def x23_deal_type(spark, d):
    return table(spark, d, "part").select("p_partkey", X.deal_type(F.col("p_name"), F.col("p_type"), F.col("p_retailprice")).alias("deal"))


PRICES = [("7450000000", 7.45e9), ("abc", None), ("0", None), ("-5", None), ("5d", None), (" 12.5 ", 12.5)]


@query(f"SELECT * FROM ({values(PRICES)}) t(raw, price)")
def x30_parse_price(spark, d):
    return literals(spark, [(a,) for a, _ in PRICES], ["raw"]).withColumn("price", V.parse_price(F.col("raw")))


@query("SELECT * FROM (VALUES (5e6, 'sale', 5e9, true), (5e3, 'sale', NULL, false), (1.5e7, 'rent', 1.5e7, false)) t(price, deal, fixed, flag)")
def x31_fix_thousand(spark, d):
    rows = literals(spark, [(5e6, "sale"), (5e3, "sale"), (1.5e7, "rent")], ["price", "deal"])
    fixed, flag = V.fix_thousand(F.col("price"), F.lit(100.0), F.col("deal"))
    return rows.withColumns({"fixed": fixed, "flag": flag})


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0)::SMALLINT AS half FROM lineitem")
def x32_small_int(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.small_int(F.col("l_quantity") / 2).alias("half"))


@query("SELECT doc_id, ('0x' || substr(md5(lower(text)), 1, 15))::BIGINT AS key FROM documents")
def x33_sql_key(spark, d):
    return table(spark, d, "documents").select("doc_id", V.sql_key(F.lower("text")).alias("key"))


@query("SELECT a.vec_id AS a, bit_count(xor(a.vec_id, 255::BIGINT))::BIGINT AS distance FROM embeddings a")
def x36_hamming(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), V.hamming(F.col("vec_id"), F.lit(255).cast("bigint")).cast("bigint").alias("distance"))


@query("SELECT doc_id, round(2.2 * 3 / (3 + 1.2 * (0.25 + 0.75 * n_chars / 2000.0)), 6) AS w, round(ln(1 + (1000 - 10 + 0.5) / 10.5), 6) AS idf FROM documents")
def x37_bm25_weight(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(V.bm25_weight(F.lit(3.0), F.col("n_chars"), F.lit(2000.0)), 6).alias("w"), F.round(V.bm25_idf(F.lit(1000.0), F.lit(10.0)), 6).alias("idf"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def x39_cosine(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return e.select("vec_id", F.round(V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 5).alias("cos"))


@query("SELECT doc_id, doc_id * 64 + 5 AS point, doc_id AS back, 5::BIGINT AS chunk FROM documents")
def x40_point_ids(spark, d):
    p = V.point_id(F.col("doc_id"), F.lit(5))
    a, b = V.unpack_point(p)
    return table(spark, d, "documents").select("doc_id", p.alias("point"), a.alias("back"), b.cast("bigint").alias("chunk"))


@query("SELECT o_orderkey, round(ln(o_totalprice), 6) AS lg, round(exp(ln(o_totalprice)), 2) AS back, round(ln(1 + o_totalprice), 6) AS lg1 FROM orders")
def x41_log_exp(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.log(p), 6).alias("lg"), F.round(F.exp(F.log(p)), 2).alias("back"), F.round(F.log1p(p), 6).alias("lg1"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 1000 THEN 'below_market' WHEN s_acctbal > 5000 THEN 'above_market' ELSE 'fair' END AS verdict FROM supplier")
def x43_verdict(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", V.verdict(F.col("s_acctbal"), F.lit(1000.0), F.lit(5000.0)).alias("verdict"))


@query("SELECT doc_id, CASE WHEN n_chars > 400 THEN ceil((n_chars - 100) / 300.0)::BIGINT ELSE 1 END AS chunks FROM documents")
def x44_chunk_count(spark, d):
    return table(spark, d, "documents").select("doc_id", V.chunk_count(F.col("n_chars"), 400, 100).alias("chunks"))


@query("SELECT 12.0::DOUBLE AS area, true AS inside, false AS outside")
def x45_rings(spark, d):
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    return spark.range(1).select(V.ring_area(ring).alias("area"), V.point_in_ring(F.lit(1.0), F.lit(1.0), ring).alias("inside"), V.point_in_ring(F.lit(5.0), F.lit(1.0), ring).alias("outside"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INTEGER AS idx, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def x51_dates(spark, d):
    m = V.month(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", m.alias("month"), V.month_index(m, 1995, 1).alias("idx"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT count(*) FILTER (WHERE t IS NULL) AS bad, count(t) AS good FROM (SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS t FROM events)")
def x50_try_timestamps(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, "not a date").otherwise(F.col("ts").cast("string"))
    t = table(spark, d, "events").select(F.try_to_timestamp(raw).alias("t"))
    return t.agg(F.count_if(F.col("t").isNull()).alias("bad"), F.count("t").alias("good"))


@query(with_listings("SELECT a, count(*) AS n FROM (SELECT DISTINCT listing_id, unnest(amenities) AS a FROM v_listings) WHERE a IN ('gara', 'an_ninh') GROUP BY 1"))
def x54_unnest(spark, d):
    return view(spark, d).select("listing_id", F.explode("amenities").alias("a")).where(F.col("a").isin("gara", "an_ninh")).distinct().groupBy("a").agg(F.count("*").alias("n"))


@query(with_listings("SELECT sum(list_contains(amenities, 'gara')::INT)::BIGINT AS has_gara, sum(list_contains(amenities, 'ho_boi')::INT)::BIGINT AS has_ho_boi FROM v_listings"))
def x55_one_hot(spark, d):
    from lodestone.operators.valuation import one_hot

    return view(spark, d).select(*[c.alias(k) for k, c in one_hot("amenities", ["gara", "ho_boi"]).items()]).agg(F.sum("has_gara").alias("has_gara"), F.sum("has_ho_boi").alias("has_ho_boi"))


@query(with_listings("SELECT listing_id, source_row, ((ward IS NOT NULL)::INT + (street IS NOT NULL)::INT + (project IS NOT NULL)::INT)::BIGINT AS n FROM v_listings"))
def x56_nonnull_count(spark, d):
    return view(spark, d).select("listing_id", "source_row", sum((F.col(c).isNotNull().cast("bigint") for c in ("ward", "street", "project")), F.lit(0).cast("bigint")).alias("n"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def x57_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT conv_id, sha256(string_agg(role || ':' || turn, ',' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def x59_digest(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string"))), ","), 256).alias("digest"))


@query("SELECT try_cast(substr(s_name, 10) AS BIGINT) AS id FROM supplier WHERE try_cast(substr(s_name, 10) AS BIGINT) IS NOT NULL")
def x60_numeric_ids(spark, d):
    c = F.expr("try_cast(substr(s_name, 10) AS BIGINT)")
    return table(spark, d, "supplier").select(c.alias("id")).where("id IS NOT NULL")


@query("SELECT item_id, least(400, 512 - 2 - length(text) % 300)::INTEGER AS size FROM benchmark")
def x61_effective_size(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.least(F.lit(400), 512 - 2 - F.length("text") % 300).alias("size"))


# Streams


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS arrivals FROM events""")
def r01_arrivals_in_window(spark, d):
    return limiter.arrivals_in_window(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "arrivals")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id AS k, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r(k, n, event_id, hits, retry_after) AS (
        SELECT DISTINCT k, 0::BIGINT, NULL::BIGINT, []::DOUBLE[], NULL::BIGINT FROM e
        UNION ALL
        SELECT k, n, event_id, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, CASE WHEN len(live) >= 2 THEN greatest(1, ceil(3600 - (t - live[1])))::BIGINT END
        FROM (SELECT e.k, e.n, e.event_id, e.t, list_filter(r.hits, lambda h: e.t - h <= 3600) AS live FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1))
    SELECT event_id, retry_after FROM r WHERE n > 0""")
def r01_rate_limit(spark, d):
    return limiter.limit_rate(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 3600.0)
