"""Logical schemas as StructTypes; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "smallint": T.ShortType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "binary": T.BinaryType(),
}


def of(name: str) -> T.DataType:
    return T.ArrayType(of(name[6:-1])) if name.startswith("array<") else TYPES[name]


def struct(spec: str) -> T.StructType:
    """`name type, ...`; needs no running session."""
    return T.StructType([T.StructField(*(lambda n, t: (n, of(t)))(*f.split())) for f in spec.split(",")])


RAW = struct(
    "name string, description string, property_type_name string, province_name string, district_name string, ward_name string, "
    "street_name string, project_name string, price string, area double, floor_count double, frontage_width double, "
    "house_depth double, road_width double, bedroom_count double, bathroom_count double, house_direction string, "
    "balcony_direction string, published_at string"
)
CLEAN = struct(
    "listing_id bigint, dup_cluster_id bigint, n_raw_rows bigint, source_shard smallint, source_row int, title string, "
    "description string, property_type string, deal_type string, province string, province_2025 string, district string, "
    "ward string, street string, project string, price_vnd double, price_fixed_thousand boolean, area_m2 double, "
    "floors smallint, bedrooms smallint, bathrooms smallint, frontage_m double, depth_m double, road_width_m double, "
    "house_direction string, balcony_direction string, published_at timestamp_ntz, is_price_outlier boolean, "
    "is_area_outlier boolean, amenities array<string>"
)
CHUNK = struct("point_id bigint, listing_id bigint, chunk_index int, text string, n_tokens int")
POSTING = struct("doc_id bigint, term string, tf int, doc_len int")
VECTOR = struct("vec_id bigint, embedding array<float>, label int")
EDGE = struct("src_label string, src string, type string, dst_label string, dst string")
ANSWER = struct("id string, system string, answer string, route string, latency_ms double, seq bigint")
