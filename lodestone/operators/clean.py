"""Cleaning of raw listings into typed rows with a drop reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V


#: The cleaned columns whose non-null number breaks ties between duplicates.
#: The provinces before July 2025, each with the province that it belongs to since.
PROVINCES_2025 = {
    "Hà Nội": "Hà Nội",
    "Huế": "Huế",
    "Lai Châu": "Lai Châu",
    "Điện Biên": "Điện Biên",
    "Sơn La": "Sơn La",
    "Lạng Sơn": "Lạng Sơn",
    "Quảng Ninh": "Quảng Ninh",
    "Thanh Hóa": "Thanh Hóa",
    "Nghệ An": "Nghệ An",
    "Hà Tĩnh": "Hà Tĩnh",
    "Cao Bằng": "Cao Bằng",
    "Tuyên Quang": "Tuyên Quang",
    "Hà Giang": "Tuyên Quang",
    "Lào Cai": "Lào Cai",
    "Yên Bái": "Lào Cai",
    "Thái Nguyên": "Thái Nguyên",
    "Bắc Kạn": "Thái Nguyên",
    "Phú Thọ": "Phú Thọ",
    "Vĩnh Phúc": "Phú Thọ",
    "Hòa Bình": "Phú Thọ",
    "Bắc Ninh": "Bắc Ninh",
    "Bắc Giang": "Bắc Ninh",
    "Hưng Yên": "Hưng Yên",
    "Thái Bình": "Hưng Yên",
    "Hải Phòng": "Hải Phòng",
    "Hải Dương": "Hải Phòng",
    "Ninh Bình": "Ninh Bình",
    "Hà Nam": "Ninh Bình",
    "Nam Định": "Ninh Bình",
    "Quảng Trị": "Quảng Trị",
    "Quảng Bình": "Quảng Trị",
    "Đà Nẵng": "Đà Nẵng",
    "Quảng Nam": "Đà Nẵng",
    "Quảng Ngãi": "Quảng Ngãi",
    "Kon Tum": "Quảng Ngãi",
    "Gia Lai": "Gia Lai",
    "Bình Định": "Gia Lai",
    "Khánh Hòa": "Khánh Hòa",
    "Ninh Thuận": "Khánh Hòa",
    "Lâm Đồng": "Lâm Đồng",
    "Đắk Nông": "Lâm Đồng",
    "Bình Thuận": "Lâm Đồng",
    "Đắk Lắk": "Đắk Lắk",
    "Phú Yên": "Đắk Lắk",
    "Hồ Chí Minh": "Hồ Chí Minh",
    "Bình Dương": "Hồ Chí Minh",
    "Bà Rịa - Vũng Tàu": "Hồ Chí Minh",
    "Đồng Nai": "Đồng Nai",
    "Bình Phước": "Đồng Nai",
    "Tây Ninh": "Tây Ninh",
    "Long An": "Tây Ninh",
    "Cần Thơ": "Cần Thơ",
    "Sóc Trăng": "Cần Thơ",
    "Hậu Giang": "Cần Thơ",
    "Vĩnh Long": "Vĩnh Long",
    "Bến Tre": "Vĩnh Long",
    "Trà Vinh": "Vĩnh Long",
    "Đồng Tháp": "Đồng Tháp",
    "Tiền Giang": "Đồng Tháp",
    "Cà Mau": "Cà Mau",
    "Bạc Liêu": "Cà Mau",
    "An Giang": "An Giang",
    "Kiên Giang": "An Giang",
}


def provinces_2025(spark: SparkSession) -> DataFrame:
    """old, new: the table above, for clean()."""
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in PROVINCES_2025.items() for x in pair])).alias("old", "new"))


COUNTED = (
    "title", "description", "province", "district", "ward", "street", "project", "price_vnd", "area_m2", "floors", "frontage_m", "depth_m",
    "road_width_m", "bedrooms", "bathrooms", "house_direction", "balcony_direction", "published_at",
)


def drop_reason(title: Column, description: Column, kind: Column, kinds: tuple[str, ...] = X.PROPERTY_TYPES) -> Column:
    """Rows without text go first, then rows of an unknown type; null keeps the row."""
    return F.when(title.isNull() & description.isNull(), "dropped_no_text").when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "dropped_bad_type")


def clean_frame(raw: DataFrame, provinces: DataFrame | None = None, kinds: tuple[str, ...] = X.PROPERTY_TYPES) -> DataFrame:
    """RAW columns (and source_shard, source_row where present) to typed, masked, keyed rows. `provinces` maps old to new names."""
    price = V.parse_price(F.col("price"))
    title0, desc0 = (X.normalize_text(F.col(c)) for c in ("name", "description"))
    deal = X.deal_type(F.coalesce(title0, F.lit("")), F.coalesce(X.mask_pii(desc0), F.lit("")), price)
    fixed, flag = V.fix_thousand(price, V.positive(F.col("area")), F.col("deal_type"))
    out = raw.withColumns({"__name": X.nfc(X.norm(F.col("name"))), "__desc": X.nfc(X.norm(F.col("description")))})
    out = out.withColumns(
        {
            "listing_id": V.listing_id("__name", "__desc"),
            "key_hash2": V.check_hash("__name", "__desc"),
            # The joined text is normalised, not its parts: blanks around the bar stay one blank.
            "prefix_key": V.prefix_key(X.nfc(X.norm(F.concat(F.coalesce("name", F.lit("")), F.lit("|"), F.coalesce("description", F.lit("")))))),
            "simhash": V.simhash("__desc"),
            "title": X.mask_pii(title0),
            "masked": X.mask_pii(desc0),
            "property_type": X.normalize_text(F.col("property_type_name")),
            "deal_type": deal,
            "province": X.normalize_place(F.col("province_name"), "province"),
            "district": X.normalize_place(F.col("district_name"), "district"),
            "ward": X.normalize_place(F.col("ward_name"), "ward"),
            "street": X.normalize_text(F.col("street_name")),
            "project": X.normalize_text(F.col("project_name")),
            "area_m2": V.positive(F.col("area")),
            "house_direction": X.normalize_text(F.col("house_direction")),
            "balcony_direction": X.normalize_text(F.col("balcony_direction")),
        }
    )
    out = out.withColumns({"price_vnd": fixed, "price_fixed_thousand": flag, "published_ts": F.try_to_timestamp(F.col("published_at")).cast("timestamp_ntz")})
    small = {n: V.small_int(V.positive(F.col(c))) for n, c in (("floors", "floor_count"), ("bedrooms", "bedroom_count"), ("bathrooms", "bathroom_count"))}
    sizes = {n: V.positive(F.col(c)) for n, c in (("frontage_m", "frontage_width"), ("depth_m", "house_depth"), ("road_width_m", "road_width"))}
    out = out.withColumns({**small, **sizes, "amenities": X.match_amenities(F.concat_ws("\n", "title", "masked")), "drop_reason": drop_reason(title0, desc0, F.col("property_type"), kinds)})
    out = out.drop("published_at", "description", "__name", "__desc").withColumnsRenamed({"published_ts": "published_at", "masked": "description"})
    out = out.withColumn("n_nonnull", sum((F.col(c).isNotNull().cast("int") for c in COUNTED), F.lit(0)))
    if provinces is None:
        return out.withColumn("province_2025", F.col("province"))
    names = provinces.toDF("__old", "__new")
    return out.join(names, F.col("province") == F.col("__old"), "left").withColumn("province_2025", F.coalesce("__new", "province")).drop("__old", "__new")


def ingest_report(interim: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """Counts by reason, price and area statistics, in one pass."""
    n = F.greatest(F.count("*"), F.lit(1))
    return interim.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(reason) == "dropped_no_text").alias("dropped_no_text"),
        F.count_if(F.col(reason) == "dropped_bad_type").alias("dropped_bad_type"),
        F.count_if(F.col("price_vnd").isNull()).alias("price_null"),
        F.count_if("price_fixed_thousand").alias("price_fixed"),
        F.round(100 * F.count_if(F.col("area_m2").isNull()) / n, 2).alias("area_missing_pct"),
        F.count_if(F.col("deal_type") == "rent").alias("n_rent"),
    )
