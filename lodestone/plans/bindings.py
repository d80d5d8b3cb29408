"""The listing relation over the test tables, and the same relation as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.market import publish_view

AMENITY_NAMES = {"gara": "Gara", "ho_boi": "Hồ bơi", "an_ninh": "An ninh 24/7"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as listings: part is the offer, supplier the ward, nation the district, region the province.

    Dimensions join by key; Catalyst broadcasts those below its size threshold, so the fact table is not shuffled for them.
    """
    t = lambda n: table(spark, sf_dir, n)
    joined = (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    tag = lambda k, c: F.when(c, F.lit(k))
    return joined.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("listing_id"),
        F.col("l_linenumber").cast("int").alias("source_shard"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("source_row"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"),
        F.col("p_type").alias("property_type"),
        F.when(F.col("l_returnflag") == "R", "rent").otherwise("sale").alias("deal_type"),
        F.col("r_name").alias("province"), F.col("n_name").alias("district"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).alias("ward"),
        F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("Street "), (F.col("l_partkey") % 40).cast("string"))).alias("street"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("p_brand")).alias("project"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_extendedprice") * 100003.7).alias("price_vnd"),
        F.col("l_quantity").alias("area_m2"),
        (F.col("p_size") % 6).cast("bigint").alias("bedrooms"),
        F.col("l_shipdate").alias("published_at"),
        (F.col("l_discount") >= 0.1).alias("is_price_outlier"),
        (F.col("l_quantity") >= 50).alias("is_area_outlier"),
        F.array_compact(F.array(tag("gara", F.col("l_linestatus") == "F"), tag("ho_boi", F.col("p_size") > 25), tag("an_ninh", F.col("l_tax") > 0.04))).alias("amenities"),
        (F.col("l_orderkey") * 8).alias("dup_cluster_id"),
    )


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish_view(listings(spark, sf_dir))


#: Common table expressions for oracle SQL: listings, v_listings, g (keyed), ms (market statistics).
LISTINGS = """listings AS (
    SELECT l_orderkey * 8 + l_linenumber AS listing_id, l_linenumber AS source_shard, l_partkey * 1000 + l_suppkey AS source_row, p_name AS title,
           p_name || ' ' || p_type || ' ' || p_brand AS description, p_type AS property_type,
           CASE WHEN l_returnflag = 'R' THEN 'rent' ELSE 'sale' END AS deal_type, r_name AS province, n_name AS district,
           CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS ward, CASE WHEN l_partkey % 5 <> 0 THEN 'Street ' || (l_partkey % 40) END AS street,
           CASE WHEN l_partkey % 3 = 0 THEN p_brand END AS project, CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice * 100003.7 END AS price_vnd,
           l_quantity AS area_m2, (p_size % 6)::BIGINT AS bedrooms, l_shipdate AS published_at, l_discount >= 0.1 AS is_price_outlier,
           l_quantity >= 50 AS is_area_outlier,
           list_filter([CASE WHEN l_linestatus = 'F' THEN 'gara' END, CASE WHEN p_size > 25 THEN 'ho_boi' END, CASE WHEN l_tax > 0.04 THEN 'an_ninh' END], lambda x: x IS NOT NULL) AS amenities,
           l_orderkey * 8 AS dup_cluster_id
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
v_listings AS (
    SELECT *, price_vnd / 1e9 AS price_bn,
           CASE WHEN NOT is_price_outlier AND NOT is_area_outlier AND price_vnd IS NOT NULL AND area_m2 IS NOT NULL THEN price_vnd / area_m2 / 1e6 END AS price_m2_mil,
           strftime(published_at, '%Y-%m') AS month
    FROM listings)"""
KEYED = """g AS (SELECT *, province || '|' || district AS dk, province || '|' || district || '|' || ward AS wk, province || '|' || district || '|' || street AS sk,
           province || '|' || lower(project) AS prk FROM v_listings)"""
_SCOPE = """SELECT '{s}' AS scope, ak AS area_key, CASE WHEN grouping(property_type) = 1 THEN 'ALL' ELSE property_type END AS property_type,
           CASE WHEN grouping(month) = 1 THEN 'ALL' ELSE month END AS month, deal_type, count(*) AS n, median(price_m2_mil) AS median_price_m2_mil,
           quantile_cont(price_m2_mil, 0.25) AS p25_price_m2_mil, quantile_cont(price_m2_mil, 0.75) AS p75_price_m2_mil,
           median(price_vnd) AS median_price_vnd, median(area_m2) AS median_area_m2
    FROM (SELECT {k} AS ak, * FROM g WHERE {k} IS NOT NULL AND price_m2_mil IS NOT NULL)
    GROUP BY GROUPING SETS ((ak, deal_type, property_type, month), (ak, deal_type, property_type), (ak, deal_type, month), (ak, deal_type)) HAVING count(*) >= 5"""
MARKET = "ms AS (" + " UNION ALL ".join(_SCOPE.format(s=s, k=k) for s, k in (("province", "province"), ("district", "dk"), ("ward", "wk"), ("project", "prk"))) + ")"


def with_listings(body: str, *more: str) -> str:
    return "WITH " + ", ".join([LISTINGS, *more]) + "\n" + body
