"""Queries for validation, gates, sinks of reports, ranks of pairs and descriptive summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.operators import filters, market, reports, valuation
from lodestone.plans.bindings import table, view, with_listings
from lodestone.plans.registry import query, rounded
from lodestone.plans.relational import literals
from lodestone.session import scratch
from lodestone.sources import io
from lodestone.streaming import events


def passes(check, *given) -> bool:
    try:
        check(*given)
    except ValueError:
        return False
    return True


def nations(spark, d):
    """A dimension of some dozen rows, as the inputs that single requests bring."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return [r.asDict() for r in rows.select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").collect()]


@query("SELECT n_nationkey, n_nationkey <= 10 AND n_nationkey % 4 <> 3 AND n_nationkey % 5 <> 4 AS ok, CASE WHEN n_nationkey <= 10 THEN n_nationkey * 1.0::DOUBLE END AS price_min FROM nation")
def f12_validation(spark, d):
    """Inverted ranges, months of no year and unknown keys fail strict input; extracted input loses the wrong fields only."""
    out = []
    for r in nations(spark, d):
        k = r["n_nationkey"]
        given = {"province": r["r_name"], "price_min": float(k), "price_max": 10.0} | ({"month_from": "2025-13"} if k % 4 == 3 else {})
        strict = given | ({"nope": 1} if k % 5 == 4 else {})
        loose = filters.validate(given, strict=False)
        out.append((k, passes(filters.validate, strict), -1.0 if loose.price_min is None else loose.price_min))
    rows = literals(spark, out, ["n_nationkey", "ok", "price_min"])
    return rows.withColumn("price_min", F.when(F.col("price_min") >= 0, F.col("price_min")))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 2 = 0 THEN r_name ELSE '-' END AS province,
    CASE WHEN n_nationkey % 6 = 0 THEN 'merged' WHEN n_nationkey % 3 = 0 THEN 'manual' ELSE 'llm' END AS source FROM nation JOIN region ON n_regionkey = r_regionkey""")
def f13_merge(spark, d):
    """Manual values win over extracted ones; the source tells which of the two there were."""
    out = []
    for r in nations(spark, d):
        k = r["n_nationkey"]
        both, source = filters.merge(filters.QueryFilters(province=r["r_name"] if k % 2 == 0 else None), filters.QueryFilters(province=r["n_name"] if k % 3 == 0 else None))
        out.append((k, both.province or "-", source))
    return literals(spark, out, ["n_nationkey", "province", "source"])


STATEMENTS = [
    ("SELECT count(*) FROM v_listings", True), ("WITH x AS (SELECT * FROM v_listings) SELECT max(price_vnd) FROM x", True), ("SELECT 1 FROM v_listings WHERE street = 'drop table; Set'", True),
    ("SELECT month FROM v_listings WHERE area_m2 > (SELECT avg(area_m2) FROM v_listings)", True), ("SELECT 1", False), ("DROP TABLE v_listings", False), ("SELECT 1 FROM v_listings; SELECT 2", False),
    ("SELECT java_method('java.lang.System', 'nanoTime') FROM v_listings", False), ("SELECT reflect('java.lang.System', 'nanoTime') FROM v_listings", False),
    ("SELECT * FROM v_listings WHERE 1 = (SELECT count(*) FROM own_orders)", False), ("SELECT * FROM v_listings JOIN own_orders ON true", False), ("SELECT input_file_name() FROM v_listings", False),
    ("WITH x AS (SELECT * FROM own_orders) SELECT * FROM x JOIN v_listings ON true", False), ("SELECT * FROM range(3) JOIN v_listings ON true", False), ("SELECT current_database() FROM v_listings", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(STATEMENTS)) + ") t(id, allowed)")
def f17_sql_gate(spark, d):
    """Other tables, files, reflection and commands are told by the analysed plan."""
    io.as_view(view(spark, d), "v_listings")
    io.as_view(table(spark, d, "orders"), "own_orders")
    files = f"SELECT * FROM v_listings JOIN parquet.`{d}/orders.parquet` ON true"
    if passes(filters.gated_sql, spark, files):
        raise AssertionError("files must not be read")
    return literals(spark, [(i, passes(filters.gated_sql, spark, s)) for i, (s, _) in enumerate(STATEMENTS)], ["id", "allowed"])


@query("SELECT n_nationkey, n_nationkey BETWEEN 1 AND 20 AND n_nationkey % 6 <> 5 AND n_nationkey % 7 <> 6 AS ok FROM nation")
def f27_valuation_input(spark, d):
    """Required keys, unknown keys and the range of the area."""
    known, required, out = {"province", "property_type", "district", "area_m2", "bedrooms"}, {"province", "property_type", "district", "area_m2"}, []
    for r in nations(spark, d):
        k = r["n_nationkey"]
        given = {"province": r["r_name"], "property_type": "PROMO", "district": r["n_name"], "area_m2": 5000.0 * k} | ({"odd": 1} if k % 6 == 5 else {})
        if k % 7 == 6:
            del given["district"]
        out.append((k, passes(valuation.check_input, given, known, required)))
    return literals(spark, out, ["n_nationkey", "ok"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def t13_row_cap(spark, d):
    rows = reports.collect_within(table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 5, 120.0)
    return literals(spark, [(r["o_orderkey"], r["o_totalprice"]) for r in rows], ["o_orderkey", "o_totalprice"]).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey::DOUBLE END AS value, len(n_name)::INTEGER AS n FROM nation")
def x58_plain_cells(spark, d):
    """Cells that no JSON has (NaN, infinities) are null in a report."""
    odd = F.when(F.col("n_nationkey") % 3 == 0, F.lit(float("nan"))).when(F.col("n_nationkey") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("n_nationkey").cast("double"))
    rows = [reports.plain(r) for r in table(spark, d, "nation").select("n_nationkey", odd.alias("value"), F.struct(F.length("n_name").alias("n")).alias("s")).collect()]
    out = literals(spark, [(r["n_nationkey"], -1.0 if r["value"] is None else r["value"], r["s"]["n"]) for r in rows], ["n_nationkey", "value", "n"])
    return out.withColumn("value", F.when(F.col("value") >= 0, F.col("value")))


@query("SELECT event_id, strftime(ts - to_hours([0, 7, -5][event_id % 3 + 1]), '%Y-%m') AS month FROM events")
def x53_utc_month(spark, d):
    """Times that name their zone, as months in UTC."""
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+07:00"), F.lit("-05:00")), (F.col("event_id") % 3 + 1).cast("int"))
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, d, "events").select("event_id", V.month(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.to_timestamp(said).cast("timestamp_ntz"))).alias("month"))


@query("SELECT 1::BIGINT AS schema_version, count(*) AS n FROM nation")
def s13_json_sink(spark, d):
    path = scratch(spark, "report") + ".json"
    for _ in range(2):  # the second takes the place of the first
        io.write_json(spark, path, {"n": table(spark, d, "nation").count()})
    return spark.read.json(path).select("schema_version", "n")


@query(with_listings("SELECT listing_id, source_row, dense_rank() OVER (ORDER BY province, property_type) AS g FROM v_listings"))
def w03_rank_of_pairs(spark, d):
    """Only the distinct pairs are ranked; rows take their pair's number by a null-safe join."""
    v = view(spark, d).select("listing_id", "source_row", "province", "property_type")
    pairs = v.select(F.col("province").alias("p"), F.col("property_type").alias("t")).distinct()
    ranks = pairs.withColumn("g", F.dense_rank().over(Window.orderBy(F.asc_nulls_last("p"), F.asc_nulls_last("t"))).cast("bigint"))
    return v.join(ranks, F.col("province").eqNullSafe(F.col("p")) & F.col("property_type").eqNullSafe(F.col("t"))).select("listing_id", "source_row", "g")


EMPTY = ["title", "description", "ward", "street", "project", "price_vnd", "area_m2", "bedrooms", "price_m2_mil"]
PAIR = ("AFRICA", "ASIA")
SALE = "FILTER (WHERE deal_type = 'sale')"


@query(with_listings(f"""SELECT section, key, n, round(value, 4) AS value FROM (
    SELECT 'period' AS section, unnest([min(month), max(month)]) AS key, NULL::BIGINT AS n, NULL::DOUBLE AS value FROM v_listings
    UNION ALL SELECT 'by_type', property_type, count(*), median(price_m2_mil) {SALE} FROM v_listings GROUP BY 2
    UNION ALL (SELECT 'top_provinces', province, count(*), count(*) / (SELECT count(*) FROM v_listings)::DOUBLE FROM v_listings GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
    UNION ALL SELECT 'pair_share', '{'+'.join(PAIR)}', count(*) FILTER (WHERE province IN {PAIR}), count(*) FILTER (WHERE province IN {PAIR}) / count(*)::DOUBLE FROM v_listings
    UNION ALL SELECT 'monthly', month, count(*), median(price_m2_mil) {SALE} FROM v_listings GROUP BY 2
    {' '.join(f"UNION ALL SELECT 'missing_pct', '{c}', NULL, 100 * avg(({c} IS NULL)::INT) FROM v_listings" for c in EMPTY)}
    {' '.join(f"UNION ALL SELECT 'description_chars', '{k}', NULL, quantile_cont(length(description), {q}) FROM v_listings" for k, q in (('p50', 0.5), ('p90', 0.9), ('p99', 0.99)))})"""))
def c06_eda_summary(spark, d):
    return rounded(market.eda_summary(view(spark, d), EMPTY, PAIR))


@query(with_listings(f"""SELECT section, key, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM (
    SELECT 'type_quartiles' AS section, property_type AS key, quantile_cont(price_m2_mil, 0.25) AS a, median(price_m2_mil) AS b, quantile_cont(price_m2_mil, 0.75) AS c FROM v_listings WHERE deal_type = 'sale' AND price_m2_mil IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'province_price', province, median(price_m2_mil), NULL, NULL FROM v_listings WHERE deal_type = 'sale' AND price_m2_mil IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'outliers', property_type, 100 * avg(is_price_outlier::INT), 100 * avg(is_area_outlier::INT), NULL FROM v_listings GROUP BY 2
    UNION ALL SELECT 'dup_buckets', b, count(m), NULL, NULL FROM (VALUES ('1', 1, 1), ('2', 2, 2), ('3', 3, 3), ('4-5', 4, 5), ('6-10', 6, 10), ('>10', 11, 1000000)) t(b, lo, hi) LEFT JOIN (SELECT count(*) AS m FROM v_listings GROUP BY dup_cluster_id) ON m BETWEEN lo AND hi GROUP BY 2
    UNION ALL SELECT 'districts', province || '|' || district, n, NULL, NULL FROM (SELECT province, district, count(*) AS n FROM v_listings WHERE province IN {PAIR} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY province ORDER BY count(*) DESC, district) <= 5))"""))
def c06_eda_plots(spark, d):
    return rounded(market.eda_plots(view(spark, d), PAIR))


# Event streams


@query("SELECT user_id, count(*) AS n, CASE WHEN arg_min(event_type, event_id) <> 'view' THEN 'begins without view' WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 'no purchase' WHEN count(*) FILTER (WHERE event_type = 'purchase') > 1 THEN 'more than one purchase' WHEN arg_max(event_type, event_id) <> 'purchase' THEN 'goes on after purchase' END AS fault FROM events GROUP BY 1")
def r03_event_protocol(spark, d):
    return events.protocol(table(spark, d, "events"), "user_id", ["event_id"], "event_type", "view", "purchase")


@query("SELECT event_id, (event_type <> 'view')::INTEGER AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'view', event_id)::INTEGER AS pos FROM events")
def r04_merged_streams(spark, d):
    e = table(spark, d, "events")
    return events.merged([e.where("event_type = 'view'"), e.where("event_type <> 'view'")], "user_id", ["ts", "event_id"]).select("event_id", "source", "pos")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN (event_id % 90)::DOUBLE ELSE least(60, 0.5 * 2 ** (event_id % 9)) END::DOUBLE AS seconds FROM events")
def r06_retry_delay(spark, d):
    asked = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 90)
    return table(spark, d, "events").select("event_id", events.retry_delay(F.col("event_id") % 9, asked, 0.5).alias("seconds"))


@query()
def r02_bounded_slots(spark, d):
    """Four slots a user; an event asks for one to three of them for an hour and waits at most two."""
    e = table(spark, d, "events").withColumns({"at": F.col("ts").cast("timestamp").cast("double"), "takes": F.lit(3600.0), "slots": (F.col("event_id") % 3 + 1).cast("int")})
    return events.bounded_slots(e, "user_id", "at", "takes", "slots", "event_id", 4, 7200.0)


@query("SELECT 0::BIGINT AS bad")
def s19_cluster_integrity(spark, d):
    """Every ward of a cluster, and every cluster of a ward, is a node."""
    from lodestone.operators import graph
    from lodestone.plans.analytics import ward_clusters

    g, c = graph.keyed(view(spark, d)), ward_clusters(spark, d)
    wards = graph.nodes(g, "Ward").select(F.lit("Ward").alias("label"), "key")
    clusters = graph.cluster_nodes(g, c).select(F.lit("Cluster").alias("label"), "key")
    return graph.dangling(graph.cluster_edges(c), wards.unionByName(clusters)).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("bad"))
