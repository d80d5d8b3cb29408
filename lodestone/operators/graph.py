"""The property graph as DataFrames: node tables, one edge table (src_label, src, type, dst_label, dst), paths and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.market import area_key
from lodestone.operators.neighbours import nearest_rows
from lodestone.session import materialize, release


def keyed(view: DataFrame) -> DataFrame:
    """The view with district, ward, street and project keys; a key is null if any of its parts is."""
    return view.withColumns(
        {
            "dk": area_key("province", "district"),
            "wk": area_key("province", "district", "ward"),
            "sk": area_key("province", "district", "street"),
            "prk": F.concat(F.col("province"), F.lit("|"), F.lower("project")),
        }
    )


def sale_median() -> Column:
    return F.median(F.when(F.col("deal_type") == "sale", F.col("price_m2_mil"))).alias("median_price_m2_mil")


def top_value(g: DataFrame, key: str, value: str) -> DataFrame:
    """key and its most frequent value; ties go to the least value."""
    counts = g.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("c")).alias("c"), F.col(value).alias("v")))["v"].alias(value))


def nodes(g: DataFrame, label: str, amenities: dict[str, str] | None = None) -> DataFrame:
    """The node table of a label over keyed() rows."""
    n = F.count("*").alias("n_listings")

    def area(key: str, name: str) -> DataFrame:
        return g.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(name).alias("name"), n, sale_median())

    if label == "Listing":
        return g.select(F.col("listing_id").cast("string").alias("key"), "title", "property_type", "deal_type", "price_vnd", "area_m2", "price_m2_mil", "bedrooms", "month", "dup_cluster_id")
    if label == "PropertyType":
        return g.where("property_type IS NOT NULL").select(F.col("property_type").alias("key")).distinct()
    if label == "Month":
        return g.where("month IS NOT NULL").select(F.col("month").alias("key"), F.left("month", F.lit(4)).cast("int").alias("year"), F.right("month", F.lit(2)).cast("int").alias("mon")).distinct()
    if label == "Amenity":
        spark = g.sparkSession
        return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("name")) for k, v in (amenities or {}).items()])).alias("a")).select("a.*")
    if label == "Project":
        return area("prk", "project").drop("name").join(top_value(g, "prk", "project").toDF("key", "name"), "key")
    return area(*{"Province": ("province", "province"), "District": ("dk", "district"), "Ward": ("wk", "ward"), "Street": ("sk", "street")}[label])


def edges(g: DataFrame, amenity_keys: list[str]) -> DataFrame:
    """All edges of the location, type, month, amenity and project hierarchies.

    Three passes: the edges of a row are exploded from one array, the hierarchy comes from its distinct keys, and projects
    go to the district that holds most of their rows.
    """
    one = lambda sl, s, k, dl, d: F.struct(F.lit(sl).alias("src_label"), F.col(s).cast("string").alias("src"), F.lit(k).alias("type"), F.lit(dl).alias("dst_label"), d.cast("string").alias("dst"))
    c, ofid = F.col, "listing_id"
    fixed = F.array(
        one("Listing", ofid, "OF_TYPE", "PropertyType", c("property_type")),
        one("Listing", ofid, "IN_WARD", "Ward", c("wk")),
        one("Listing", ofid, "IN_DISTRICT", "District", F.when(c("wk").isNull(), c("dk"))),
        one("Listing", ofid, "IN_PROVINCE", "Province", F.when(c("dk").isNull(), c("province"))),
        one("Listing", ofid, "ON_STREET", "Street", c("sk")),
        one("Listing", ofid, "IN_PROJECT", "Project", c("prk")),
        one("Listing", ofid, "POSTED_IN", "Month", c("month")),
    )
    levels = F.array(
        one("Ward", "wk", "IN_DISTRICT", "District", c("dk")),
        one("Street", "sk", "IN_DISTRICT", "District", c("dk")),
        one("District", "dk", "IN_PROVINCE", "Province", c("province")),
    )
    flat = lambda df, arr: df.select(F.explode(arr).alias("e")).select("e.*").where("src IS NOT NULL AND dst IS NOT NULL")
    tagged = g.select(ofid, F.explode(F.array_distinct("amenities")).alias("a")).where(F.col("a").isin(*amenity_keys)).distinct()
    has = flat(tagged, F.array(one("Listing", ofid, "HAS_AMENITY", "Amenity", c("a"))))
    tree = flat(g.select("province", "dk", "wk", "sk").distinct(), levels).distinct()
    projects = flat(top_value(g, "prk", "dk"), F.array(one("Project", "prk", "IN_DISTRICT", "District", c("dk"))))
    return reduce(DataFrame.unionByName, [flat(g, fixed), has, tree, projects])


def cluster_nodes(g: DataFrame, clusters: DataFrame) -> DataFrame:
    """key, n_wards, median_price_m2_mil and label (most frequent province, quartiles of the price) of each cluster, from its
    sales. `clusters` has ward_key, cluster_id."""
    rows = g.where("deal_type = 'sale'").join(clusters, F.col("wk") == F.col("ward_key"))
    q = F.percentile("price_m2_mil", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    each = rows.groupBy("cluster_id").agg(F.countDistinct("ward_key").alias("n_wards"), q.alias("q"))
    whole = lambda i: F.bround(F.col("q")[i]).cast("bigint").cast("string")
    named = each.join(top_value(rows, "cluster_id", "province"), "cluster_id", "left")
    label = F.concat(F.col("province"), F.lit(" · "), whole(0), F.lit("–"), whole(2), F.lit(" tr/m²"))
    return named.select(F.col("cluster_id").cast("string").alias("key"), "n_wards", F.col("q")[1].alias("median_price_m2_mil"), label.alias("label"))


def cluster_edges(clusters: DataFrame) -> DataFrame:
    """Wards to their clusters."""
    return clusters.select(F.lit("Ward").alias("src_label"), F.col("ward_key").alias("src"), F.lit("IN_CLUSTER").alias("type"), F.lit("Cluster").alias("dst_label"), F.col("cluster_id").cast("string").alias("dst"))


def stat_edges(stats: DataFrame) -> DataFrame:
    """MarketStat rows to their areas."""
    key = F.concat_ws("|", "scope", "area_key", "property_type", "month", "deal_type")
    return stats.select(F.lit("MarketStat").alias("src_label"), key.alias("src"), F.lit("STAT_OF").alias("type"), F.initcap("scope").alias("dst_label"), F.col("area_key").alias("dst"))


def dangling(edge: DataFrame, node_keys: DataFrame) -> DataFrame:
    """label, key, n: the ends of edges that no node (label, key) is, with the number of edges that end there; a sound graph has none.
    Ends and nodes are met by one aggregate, which counts before it moves them, so an end of many edges is a row of each task."""
    both = lambda label, key, *n: F.struct(label.alias("label"), key.alias("key"), *[F.lit(x).cast("long").alias(c) for c, x in zip(("n", "nodes"), n)])
    c = F.col
    ends = edge.select(F.explode(F.array(both(c("src_label"), c("src"), 1, 0), both(c("dst_label"), c("dst"), 1, 0))).alias("e")).select("e.*")
    nodes_ = node_keys.where("label IS NOT NULL AND key IS NOT NULL").select(both(c("label"), c("key"), 0, 1).alias("e")).select("e.*")
    met = ends.unionByName(nodes_).groupBy("label", "key").agg(F.sum("n").alias("n"), F.max("nodes").alias("nodes"))
    return met.where("n > 0 AND nodes = 0").select("label", "key", "n")


def hop(edge: DataFrame, kind: str | tuple[str, ...], src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
    kinds = (kind,) if isinstance(kind, str) else kind
    e = edge.where(F.col("type").isin(*kinds))
    e = e if src_label is None else e.where(F.col("src_label") == src_label)
    return (e if dst_label is None else e.where(F.col("dst_label") == dst_label)).select("src", "dst")


def one_or_two(edge: DataFrame, kinds: tuple[str, ...], src_label: str, dst_label: str) -> DataFrame:
    """src, dst over paths of one or two edges of the given types."""
    e = edge.where(F.col("type").isin(*kinds))
    first = e.where(F.col("src_label") == src_label).select("src", F.col("dst_label").alias("mid_label"), F.col("dst").alias("mid"))
    direct = first.where(F.col("mid_label") == dst_label).select("src", F.col("mid").alias("dst"))
    second = e.where(F.col("dst_label") == dst_label).select(F.col("src_label").alias("mid_label"), F.col("src").alias("mid"), "dst")
    return direct.unionByName(first.join(second, ["mid_label", "mid"]).select("src", "dst")).distinct()


def chain(edge: DataFrame, *steps: tuple[str, str, str]) -> DataFrame:
    """src, dst over a fixed chain of (type, src_label, dst_label)."""
    out = hop(edge, *steps[0])
    for s in steps[1:]:
        nxt = hop(edge, *s).toDF("mid", "end")
        out = out.join(nxt, out["dst"] == nxt["mid"]).select("src", F.col("end").alias("dst"))
    return out


def neighbourhood(edge: DataFrame, label: str, key: str, limit: int) -> DataFrame:
    """Undirected one-hop neighbours, at most limit + 1 rows: one more than asked tells that there are more."""
    out = edge.where((F.col("src_label") == label) & (F.col("src") == key)).select("type", F.col("dst_label").alias("label"), F.col("dst").alias("key"))
    into = edge.where((F.col("dst_label") == label) & (F.col("dst") == key)).select("type", F.col("src_label").alias("label"), F.col("src").alias("key"))
    return out.unionByName(into).orderBy("type", "label", "key").limit(limit + 1)


def degrees(edge: DataFrame, kind: str) -> DataFrame:
    return edge.where(F.col("type") == kind).groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("degree"))


def invariants(edge: DataFrame) -> DataFrame:
    return edge.groupBy("src_label", "type", "dst_label").agg(F.count("*").alias("n"))


def relative_to_parent(stats: DataFrame, child: str, parent: str, links: DataFrame, least: int = 1) -> DataFrame:
    """Each child area's median against its parent's, as a relative difference; `links` has src, dst."""
    all_ = (F.col("property_type") == "ALL") & (F.col("month") == "ALL") & (F.col("deal_type") == "sale")
    c = stats.where(all_ & (F.col("scope") == child) & (F.col("n") >= least)).select(F.col("area_key").alias("src"), F.col("median_price_m2_mil").alias("own"))
    p = stats.where(all_ & (F.col("scope") == parent)).select(F.col("area_key").alias("dst"), F.col("median_price_m2_mil").alias("above"))
    return c.join(links, "src").join(p, "dst").select("src", "dst", "own", "above", F.try_divide(F.col("own") - F.col("above"), "above").alias("diff"))


def co_members(members: DataFrame, key: str) -> DataFrame:
    """Others in the same cluster: `members` has key, cluster_id. Starts from one key, so it is a filter and a join."""
    mine = members.where(F.col("key") == key).select("cluster_id")
    return members.join(F.broadcast(mine.limit(1)), "cluster_id").where(F.col("key") != key).select("key", "cluster_id")


def nearest_neighbours(df: DataFrame, ident: str, features: list[str], k: int = 5, **more) -> DataFrame:
    """Undirected k-nearest-neighbour edges (a < b) by Euclidean distance on standardised features, exact; ties go to the least
    id. Rows with a missing feature have no neighbour."""
    s = df.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    z = [((F.col(f).cast("double") - F.lit(s[f"m_{f}"])) / F.lit(s[f"s_{f}"] or 1.0)) for f in features]
    # Numbers in the order of the ids, so that ties are those of the ids whatever their type.
    rows = materialize(df.select(F.col(ident).alias("id"), F.array(*z).alias("z")).orderBy("id").withColumn("row", F.monotonically_increasing_id()), "profiles")
    near = nearest_rows(rows, "row", "z", k, len(features), **more).select("q", "doc_id")
    ids = rows.select("row", "id")
    pairs = near.join(ids.toDF("q", "id"), "q").join(ids.toDF("doc_id", "o"), "doc_id")
    return pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def modularity(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Sum over communities of inner/m - (degree/2m)^2. `label` has node, community."""
    la, lb = label.toDF("a", "ca"), label.toDF("b", "cb")
    e = pairs.join(la, "a").join(lb, "b")
    ends = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).cast("double").alias("i")), F.struct(F.col("cb").alias("c"), (F.col("ca") == F.col("cb")).cast("double").alias("i")))).alias("x")).select("x.*")
    per = ends.groupBy("c").agg(F.count("*").alias("d"), (F.sum("i") / 2).alias("l"))
    m = per.agg((F.sum("d") / 2).alias("m"))
    return per.join(F.broadcast(m)).agg(F.sum(F.col("l") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def label_propagation(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """node, community: label propagation with ties to the least label, until no label changes.

    Half of the nodes (by a hash of node and round) change at a time, so that two sides can't swap labels for ever. A table
    that has not settled after `rounds` rounds is an error, never a half-done answer.
    """
    both = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    label = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    for r in range(rounds):
        votes = both.join(label.toDF("b", "community"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        own = label.select(F.col("node").alias("a"), F.col("community").alias("own"))
        # Of the labels with most votes, the own one stays; else the least one is taken.
        best = votes.join(own, "a").groupBy("a", "own").agg(F.min(F.struct((-F.col("n")).alias("n"), (F.col("community") != F.col("own")).alias("other"), F.col("community").alias("c")))["c"].alias("new"))
        turn = F.pmod(F.xxhash64(F.lit(r), "a"), F.lit(2)) == 0
        new = materialize(best.select(F.col("a").alias("node"), F.when(turn, F.col("new")).otherwise(F.col("own")).alias("community"), (F.col("new") != F.col("own")).alias("open")), "labels")
        open_ = not new.where("open").isEmpty()
        release(label)
        label = new.select("node", "community")
        label.stored_at = new.stored_at
        if not open_:
            release(both)
            return label
    raise ValueError(f"communities had not settled after {rounds} rounds")


def ward_profiles(g: DataFrame, kinds: list[str], least: int = 8) -> DataFrame:
    """Shares of property types, log of size and median price of each ward with at least `least` sales."""
    s = g.where("deal_type = 'sale' AND price_m2_mil IS NOT NULL AND wk IS NOT NULL")
    shares = [F.avg((F.col("property_type") == k).cast("double")).alias(f"share_{k.lower()}") for k in kinds]
    return s.groupBy("wk").agg(F.count("*").alias("n"), F.median("price_m2_mil").alias("median_m2"), *shares).where(F.col("n") >= least).withColumn("log_n", F.log1p("n"))


def community_table(profiles: DataFrame, label: DataFrame, g: DataFrame) -> DataFrame:
    """community, size, mean of medians, most common province and three example wards."""
    rows = profiles.join(label.toDF("wk", "community"), "wk").withColumn("province", F.substring_index("wk", "|", 1))
    common = top_value(rows, "community", "province")
    return rows.groupBy("community").agg(F.count("*").alias("size"), F.avg("median_m2").alias("mean_median"), F.slice(F.sort_array(F.collect_set("wk")), 1, 3).alias("examples")).join(common, "community")


