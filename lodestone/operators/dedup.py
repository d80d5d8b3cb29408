"""Three tiers of duplicates: equal ids, equal prefixes, and SimHash clusters (marked, never deleted)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.values import hamming
from lodestone.operators.components import connected_components
from lodestone.session import materialize


def newest() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("n_nonnull").desc_nulls_last(), F.col("source_shard").asc(), F.col("source_row").asc()]


def collisions(df: DataFrame, key: str = "listing_id", check: str = "key_hash2") -> DataFrame:
    """Ids under which two check hashes occur; must be empty. min/max need no distinct shuffle."""
    return df.groupBy(key).agg(F.min(check).alias("a"), F.max(check).alias("b")).where("a <> b").select(key)


def exact_and_prefix(df: DataFrame) -> DataFrame:
    """Every row with kept_id and reason (kept, exact_dup, prefix_dup, or its drop reason).

    Rows of an id share one prefix key, so the second tier is a window over first-tier winners only.
    """
    live = df.where("drop_reason IS NULL")
    first = live.withColumn("r1", F.row_number().over(Window.partitionBy("listing_id").orderBy(*newest())))
    heads = first.where("r1 = 1").withColumn("kept_id", F.first("listing_id").over(Window.partitionBy("prefix_key").orderBy(*newest(), "listing_id")))
    ids = heads.select("listing_id", "kept_id")
    marked = first.join(ids, "listing_id").withColumn(
        "reason", F.when(F.col("r1") > 1, "exact_dup").when(F.col("listing_id") != F.col("kept_id"), "prefix_dup").otherwise("kept")
    )
    gone = df.where("drop_reason IS NOT NULL").withColumns({"kept_id": F.lit(None).cast("bigint"), "reason": F.col("drop_reason")})
    return marked.drop("r1").unionByName(gone.select(*marked.drop("r1").columns))


def kept_rows(mapped: DataFrame) -> DataFrame:
    """The rows that stay, with the number of raw rows that each stands for."""
    counts = mapped.where("kept_id IS NOT NULL").groupBy("kept_id").agg(F.count("*").alias("n_raw_rows"))
    return mapped.where("reason = 'kept'").join(counts.withColumnRenamed("kept_id", "listing_id"), "listing_id")


def simhash_pairs(df: DataFrame, ident: str, groups: list[str], max_distance: int = 3, bands: int = 4, max_bucket: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """(pairs, skipped): ids within `max_distance` bits with their distance, and the buckets above the cap. Equal hashes are tied to
    their least id first, so a bucket holds distinct hashes only. Null group values form groups of their own.

    Bits are dealt to bands in turn, so short hashes fill all bands. Without a cap a pair is made in the first band that it shares, so
    pairs are not shuffled. Buckets are dealt to a fixed number of tasks, since few bytes of hashes may make many pairs."""
    masks = [sum(1 << i for i in range(b, 64, bands)) for b in range(bands)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\u0000")).alias(f"g{i}") for i, g in enumerate(groups)]
    names = [f"g{i}" for i in range(len(groups))]
    rows = df.where("simhash IS NOT NULL").select(F.col(ident).alias("id"), "simhash", *keys)
    same = rows.groupBy(*names, "simhash").agg(F.min("id").alias("rep"))
    equal = rows.join(same, [*names, "simhash"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    each = same.select(*names, "rep", "simhash", F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col("simhash").bitwiseAND(F.lit(m)).alias("v")) for b, m in enumerate(masks)
    ])).alias("k")).select(*names, "rep", "simhash", "k.*")
    on = [*names, "band", "v"]
    if max_bucket:
        sized = each.join(each.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), on)
        skipped, ok = sized.where(F.col("n") > max_bucket).select(*on).distinct(), sized.where(F.col("n") <= max_bucket)
    else:
        skipped, ok = each.limit(0).select(*on), each
    dealt = ok.select(*on, "rep", "simhash").repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *on)
    left, right = (dealt.select(*on, F.col("rep").alias(x), F.col("simhash").alias(f"h{x}")) for x in "ab")
    apart = F.col("ha").bitwiseXOR(F.col("hb"))
    # Under a cap, the bucket of an earlier band may be left out, so pairs are told apart afterwards.
    first = reduce(lambda x, y: x & y, ((F.col("band") <= b) | (apart.bitwiseAND(F.lit(m)) != 0) for b, m in enumerate(masks)))
    met = left.join(right, on).where((F.col("a") < F.col("b")) & (hamming(F.col("ha"), F.col("hb")) <= max_distance))
    near = met.where(first) if not max_bucket else met.dropDuplicates(["a", "b"])
    return equal.unionByName(near.select("a", "b", hamming(F.col("ha"), F.col("hb")).alias("distance"))), skipped


def close_hashes(t: pa.Table, max_distance: int) -> pa.Table:
    """rep, root: spanning edges of the hashes of each bucket that are within the distance and of one group. Buckets of one size
    are compared together."""
    bucket, grp, rep, own = (t.column(k).to_numpy() for k in ("bucket", "grp", "rep", "own"))
    bits = t.column("simhash").to_numpy().view(np.uint64)
    across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    order = np.lexsort((rep, bucket))
    starts = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
    sizes = np.diff(np.append(starts, len(order)))
    src, dst = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for n in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == n]
        step = max(1, 4_000_000 // (n * n))
        for a in range(0, len(at), step):
            k = order[at[a : a + step, None] + np.arange(n)[None, :]]
            near = np.bitwise_count(bits[k][:, :, None] ^ bits[k][:, None, :]) <= max_distance
            near &= grp[k][:, :, None] == grp[k][:, None, :]
            if across:
                near &= own[k][:, :, None] != own[k][:, None, :]
            near[:, np.arange(n), np.arange(n)] = True
            label = np.broadcast_to(np.arange(n), k.shape)
            while True:
                new = np.where(near, label[:, None, :], n).min(axis=2)
                if (new == label).all():
                    break
                label = new
            far = label != np.arange(n)
            src.append(rep[k][far])
            dst.append(rep[np.take_along_axis(k, label, axis=1)][far])
    return pa.table({"rep": np.concatenate(src), "root": np.concatenate(dst)})


def simhash_clusters(df: DataFrame, ident: str = "listing_id", groups: list[str] | None = None, max_distance: int = 3, bands: int = 4, block: int = 1024) -> DataFrame:
    """Every id with its cluster: the least id reachable over pairs within `max_distance` bits (transitive), or itself.

    Nothing is skipped: a bucket above `block` hashes is compared in block pairs. Only spanning edges leave a task, so no pair
    is ever a row. simhash_pairs() with its cap tells which buckets a capped run would leave out.
    """
    width = 64 // bands
    rows = materialize(df.select(F.col(ident).alias("id"), "simhash", F.xxhash64(*[F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in groups or []]).alias("grp") if groups else F.lit(0).cast("long").alias("grp")), "hashes")
    same = materialize(rows.where("simhash IS NOT NULL").groupBy("grp", "simhash").agg(F.min("id").alias("first")).withColumn("rep", F.monotonically_increasing_id()), "distinct")
    part = lambda b: F.shiftrightunsigned("simhash", b * width).bitwiseAND(F.lit((1 << width) - 1))
    each = same.select("grp", "rep", "simhash", F.explode(F.array(*[F.xxhash64(F.lit(b), "grp", part(b)) for b in range(bands)])).alias("bucket"))
    busy = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j")))).alias("p")
    bundles = max(1, same.count() * bands // (8 * block))
    group = F.when(F.col("n") <= block, F.pmod(F.xxhash64("bucket"), F.lit(bundles))).otherwise(F.col("bucket"))
    dealt = each.join(busy, "bucket").withColumn("own", own).select("*", pairs).select("*", "p.*").drop("p").withColumn("g", group).withColumn("one", F.col("n") <= block)
    edges = dealt.groupBy("g", "one", "i", "j").applyInArrow(lambda t: close_hashes(t, max_distance), "rep long, root long")
    classes = materialize(same.join(connected_components(edges, "rep", "root", least=False).toDF("rep", "class"), "rep", "left").select("grp", "simhash", "first", F.coalesce("class", "rep").alias("class")), "classes")
    named = classes.join(classes.groupBy("class").agg(F.min("first").alias("dup_cluster_id")), "class").select("grp", "simhash", "dup_cluster_id")
    return rows.join(named, ["grp", "simhash"], "left").groupBy(F.col("id").alias(ident)).agg(F.min(F.coalesce("dup_cluster_id", "id")).alias("dup_cluster_id"))


def outlier_flags(df: DataFrame, deal: str, kind: str, area_key: str, price: str, area: str, least: int = 200, price_range=(0.05, 2000.0), area_range=(10.0, 10000.0)) -> DataFrame:
    """Adds is_price_outlier and is_area_outlier. Groups of `least` rows use their own percentiles (price per m2: 1 and 99 by
    deal, type and place; area: 0.5 and 99.5 by type and place), others the fixed range; null values are no outliers."""
    m2 = F.try_divide(F.col(price), F.col(area)) / 1e6
    rows = df.withColumn("__m2", m2)
    by_price = rows.where("__m2 IS NOT NULL").groupBy(deal, kind, area_key).agg(F.count("*").alias("__n"), F.percentile("__m2", F.array(F.lit(0.01), F.lit(0.99))).alias("__p"))
    by_area = rows.where(F.col(area).isNotNull()).groupBy(kind, area_key).agg(F.count("*").alias("__an"), F.percentile(area, F.array(F.lit(0.005), F.lit(0.995))).alias("__a"))
    p = by_price.where(F.col("__n") >= least).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate((deal, kind, area_key))], "__p")
    a = by_area.where(F.col("__an") >= least).select(*[F.col(c).alias(f"__j{i}") for i, c in enumerate((kind, area_key))], "__a")
    same = lambda l, r: F.col(l).eqNullSafe(F.col(r))
    both = rows.join(p, same(deal, "__k0") & same(kind, "__k1") & same(area_key, "__k2"), "left").join(a, same(kind, "__j0") & same(area_key, "__j1"), "left")
    low = lambda c, v: F.coalesce(F.col(c)[0], F.lit(v))
    high = lambda c, v: F.coalesce(F.col(c)[1], F.lit(v))
    hard = (F.col(area) < area_range[0]) | (F.col(area) > area_range[1])
    soft = F.coalesce((F.col(area) < F.col("__a")[0]) | (F.col(area) > F.col("__a")[1]), F.lit(False))
    return both.withColumns(
        {
            "is_price_outlier": F.coalesce((F.col("__m2") < low("__p", price_range[0])) | (F.col("__m2") > high("__p", price_range[1])), F.lit(False)),
            "is_area_outlier": F.coalesce(hard | soft, F.lit(False)),
        }
    ).drop("__m2", "__p", "__a", "__k0", "__k1", "__k2", "__j0", "__j1")
