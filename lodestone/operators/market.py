"""Market statistics: the cube, descriptive summaries, series and options."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.values import month
from lodestone.session import materialize


def publish_view(df: DataFrame) -> DataFrame:
    """Adds price_bn, price_m2_mil (null for outliers) and month: the one relation that analytics read."""
    ok = ~F.col("is_price_outlier") & ~F.col("is_area_outlier") & F.col("price_vnd").isNotNull() & F.col("area_m2").isNotNull()
    return df.withColumns({"price_bn": F.col("price_vnd") / 1e9, "price_m2_mil": F.when(ok, F.try_divide("price_vnd", "area_m2") / 1e6), "month": month(F.col("published_at"))})


def area_key(*parts: str) -> Column:
    """Parts joined by a bar; null if any part is null."""
    return F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit("|")] if i else []) + [F.col(p)]])


def model_key(*parts: str) -> Column:
    """As area_key, but null only if the last part is; missing parts before it are empty."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(p), F.lit("")) for p in parts])
    return F.when(F.col(parts[-1]).isNotNull(), joined)


def scopes() -> dict[str, Column]:
    return {
        "province": F.col("province"),
        "district": area_key("province", "district"),
        "ward": area_key("province", "district", "ward"),
        "project": F.concat(F.col("province"), F.lit("|"), F.lower("project")),
    }


#: A group above this number of rows is not sorted as a whole: its quantiles are looked for in narrow ranges of values.
SPLIT = 1_000_000
#: Numbers of large groups that are broadcast (16 bytes each).
MAX_LISTED = 1 << 20
#: Rows of whole areas that a task orders at once.
AT_ONCE = 1 << 18
#: The quantiles of each measure.
QUANTILES = {"price_m2_mil": (0.25, 0.5, 0.75), "price_vnd": (0.5,), "area_m2": (0.5,)}
#: The one that series and comparisons read.
MEDIAN = {"price_m2_mil": (0.5,)}


def slot(measure: str, q: float) -> str:
    return f"{measure}_{int(100 * q)}"


def share(n: Column, rank: Column, q: float) -> Column:
    """The weight of the value at a rank (from 1) in the interpolated quantile of n values; 0 for all ranks but two."""
    at = (n - 1) * F.lit(q) + 1
    return F.greatest(F.lit(0.0), 1.0 - F.abs(rank - at))


def narrow(c: Column) -> Column:
    """A range of values, 64 to a power of two, in the order of the values."""
    steps = lambda x: F.floor(F.log2(x) * 64)
    return F.when(c > 0, steps(c) + (1 << 20)).when(c < 0, -steps(-c) - (1 << 20)).otherwise(0)


#: The sets of groups of an area and deal: by type, by month.
SETS = ((True, True), (True, False), (False, True), (False, False))


def quantiles_in_batches(rows: DataFrame, measures: dict[str, tuple[float, ...]], least: int) -> DataFrame:
    """k, t, m, n and the quantiles of the groups of rows that meet in a carrier (k, c), which fits in memory. `sets` are the bits of
    the SETS that a row counts for; a group by all types or months has ALL for their number. `rows` must be dealt by carrier (by
    repartition(), whose partitions adaptive execution never splits); the JVM sorts it by carrier, and each task orders the
    values of as many whole carriers as a few batches hold, a set and a measure at a time."""
    names = [slot(m, q) for m, qs in measures.items() for q in qs]

    def quantiles(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        area = np.cumsum(np.concatenate(([0], (x["k"][1:] != x["k"][:-1]).astype(np.int64))))
        (types, t), (months, m) = (np.unique(x[c], return_inverse=True) for c in "tm")
        for i, (by_type, by_month) in enumerate(SETS):
            at = np.flatnonzero(x["sets"] & (1 << i))
            if not len(at):
                continue
            code = area[at]
            if by_type:
                code = code * len(types) + t[at]
            if by_month:
                code = code * len(months) + m[at]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
            counts = np.diff(np.append(starts, len(at)))
            whole = counts >= least
            starts, counts, out = starts[whole], counts[whole], []
            one = at[order[starts]]
            for measure, qs in measures.items():
                v = x[measure][at]
                v = v[np.lexsort((v, code))]
                for q in qs:
                    rank = (counts - 1) * q
                    low = np.floor(rank).astype(np.int64)
                    lower, upper = v[starts + low], v[starts + np.minimum(low + 1, counts - 1)]
                    out.append(lower + (upper - lower) * (rank - low))
            all_ = np.full(len(one), ALL)
            keys = [x["k"][one], x["t"][one] if by_type else all_, x["m"][one] if by_month else all_, counts]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, keys + out)), names=["k", "t", "m", "n", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        columns = lambda t: {c: t.column(c).to_numpy() for c in t.column_names}
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) < AT_ONCE:
                continue
            t = pa.Table.from_batches(held)
            k, c = t.column("k").to_numpy(), t.column("c").to_numpy()
            ends = np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1]))
            if len(ends):
                last = int(ends[-1]) + 1  # the last carrier may go on in the next batch
                yield from quantiles(columns(t.slice(0, last)))
                held = t.slice(last).to_batches()
        if held:
            yield from quantiles(columns(pa.Table.from_batches(held)))

    sorted_ = rows.select("k", "c", "t", "m", "sets", *[F.col(m).cast("double").alias(m) for m in measures]).sortWithinPartitions("k", "c")
    return sorted_.mapInArrow(run, ", ".join(["k long, t long, m long, n long", *[f"{n} double" for n in names]]))


def quantiles_by_ranges(rows: DataFrame, measures: dict[str, tuple[float, ...]]) -> DataFrame:
    """As quantiles_in_batches, for large groups: rows are counted by range of values, the ranges that hold a rank that is asked
    for are found by running sums, and only their values are counted one by one. Counting starts before the exchange, so no
    group, and no value that many rows share, meets in one task."""
    each = rows.select("gid", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x")).select("gid", "n", "x.*").withColumn("r", narrow(F.col("v")))
    asked = lambda low, high: reduce(
        lambda a, b: a | b, ((F.col("m") == m) & (F.floor((F.col("n") - 1) * F.lit(q)) + 1 <= high) & (F.ceil((F.col("n") - 1) * F.lit(q)) + 1 >= low) for m, qs in measures.items() for q in qs))
    upto = Window.partitionBy("gid", "m").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = each.groupBy("gid", "n", "m", "r").agg(F.count("*").alias("c")).withColumn("last", F.sum("c").over(upto))
    ranges = ranges.where(asked(F.col("last") - F.col("c") + 1, F.col("last"))).select("gid", "m", "r", (F.col("last") - F.col("c")).alias("before"))
    values = each.join(ranges, ["gid", "m", "r"]).groupBy("gid", "n", "m", "r", "before", "v").agg(F.count("*").alias("c"))
    within = Window.partitionBy("gid", "m", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("last", F.col("before") + F.sum("c").over(within)).withColumn("first", F.col("last") - F.col("c") + 1)
    # A value that stands on several ranks has the weight of all of them: the two that count are next to each other.
    low = lambda q: F.floor((F.col("n") - 1) * F.lit(q)) + 1
    one = lambda r, q: F.when(r.between(F.col("first"), F.col("last")), share(F.col("n"), r, q)).otherwise(0.0)
    weight = {(m, q): F.when(F.col("m") == m, one(low(q), q) + one(low(q) + 1, q)).otherwise(0.0) for m, qs in measures.items() for q in qs}
    return values.groupBy("gid").agg(*[F.sum(F.when(w > 0, w * F.col("v"))).alias(slot(m, q)) for (m, q), w in weight.items()])


#: The number that stands for all types or all months.
ALL = 0


def number(seed: int, *c: Column) -> Column:
    return F.xxhash64(F.lit(seed), *[F.coalesce(x, F.lit("\u0000")) for x in c])


def group_number(t: Column, m: Column) -> Column:
    return F.xxhash64("k", t, m)


def carried(rows: DataFrame, sets: int, large: DataFrame | None, listed: bool = True) -> DataFrame:
    """k, c, t, m, sets and measures: the carriers that a row (k, t, m, measures) is sent to, with the SETS (bits) it counts for there.
    A row goes once, to its area, where all of it fits; else to its type and its month, as far as those fit. `large`: k, t, m."""
    if large is None:
        return rows.withColumns({"c": F.lit(0).cast("long"), "sets": F.lit(sets)})
    own = rows
    for i, (t, m) in enumerate(SETS):
        one = large.where(F.col("t").__ne__(ALL) if t else F.col("t") == ALL).where(F.col("m").__ne__(ALL) if m else F.col("m") == ALL)
        on = ["k", *["t"] * t, *["m"] * m]
        one = one.select(*on, F.lit(True).alias(f"large{i}"))
        own = own.join(F.broadcast(one) if listed else one, on, "left")
    fits = lambda i: F.lit(bool(sets >> i & 1)) & F.col(f"large{i}").isNull()
    finest, by_type, by_month = fits(0), fits(1), fits(2)
    all_ = F.lit(ALL).cast("long")
    send = lambda ok, c, bits: F.when(ok, F.struct(c.alias("c"), bits.cast("int").alias("sets")))
    apart = F.array_compact(F.array(
        send(by_month, group_number(all_, F.col("m")), F.lit(4) + finest.cast("int")),
        send(by_type, group_number(F.col("t"), all_), F.lit(2) + (finest & ~by_month).cast("int")),
        send(finest & ~by_month & ~by_type, group_number(F.col("t"), F.col("m")), F.lit(1)),
    ))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("c"), F.lit(sets).alias("sets")))
    each = F.when(F.col("large3").isNull(), whole).otherwise(apart)
    return own.withColumn("x", F.explode(each)).select(*rows.columns, "x.*")


def market_stats(
    view: DataFrame, least: int = 5, deals: tuple[str, ...] = ("sale", "rent"), split: int = SPLIT, of: tuple[str, ...] | None = None,
    area: Callable[[Column], Column] | None = None, by: tuple[tuple[bool, bool], ...] = SETS, measures: dict[str, tuple[float, ...]] | None = None,
) -> DataFrame:
    """Scope x area x type|ALL x month|ALL x deal, for groups of at least `least` rows. Where only some are wanted: `of` names scopes,
    `area` is a condition on area keys, `by` the SETS; with `measures` {} the groups come with their n alone.

    Areas are counted first, by plain hash aggregates. A row then travels once for each scope, as the numbers of its area, type and
    month and its values, and all groups of an area are made where its rows meet. An area above `split` rows is sent by month and by
    type; groups that are above it themselves do not meet in a task. Numbers are hashes; that they are distinct is checked, and another
    seed is taken if not.
    """
    measures = QUANTILES if measures is None else measures
    sets = sum(1 << SETS.index(x) for x in set(by))
    scope = {s: k for s, k in scopes().items() if of is None or s in of}
    wanted = lambda a: a["area_key"].isNotNull() & (area(a["area_key"]) if area else F.lit(True))
    deal = view.where(F.col("price_m2_mil").isNotNull() & F.col("deal_type").isin(*deals))
    rows = deal.select(
        F.explode(F.filter(F.array(*[F.struct(F.lit(s).alias("scope"), k.alias("area_key")) for s, k in scope.items()]), wanted)).alias("a"),
        "deal_type", "property_type", "month", *measures,
    ).select("a.*", "deal_type", "property_type", "month", *measures)
    areas = materialize(rows.groupBy("scope", "area_key", "deal_type").agg(F.count("*").alias("size")), "areas")
    texts = materialize(deal.select(F.explode(F.array("property_type", "month")).alias("text")).distinct(), "texts")
    for seed in range(8):
        own = areas.withColumn("k", number(seed, F.col("scope"), F.col("area_key"), F.col("deal_type")))
        text = texts.select("text", number(seed, F.col("text")).alias("number"))
        clash = own.select("k").groupBy("k").count().unionByName(text.unionByName(own.sparkSession.range(1).select(F.lit(None).cast("string").alias("text"), F.lit(ALL).cast("long").alias("number"))).select(F.col("number").alias("k")).groupBy("k").count())
        if clash.where("count > 1").isEmpty():
            break
    else:
        raise ValueError("the numbers of two groups clash under every seed")
    dealt = rows.select(number(seed, F.col("scope"), F.col("area_key"), F.col("deal_type")).alias("k"), number(seed, F.col("property_type")).alias("t"), number(seed, F.col("month")).alias("m"), *measures)
    big = own.where(F.col("size") > split).select("k")
    n_big = big.count()
    if n_big:
        # At most one area in `split` rows is large, so their list is short; beyond MAX_LISTED it is joined as any other table.
        inside = dealt.join(F.broadcast(big) if n_big <= MAX_LISTED else big, "k").groupBy("k", "t", "m").agg(F.count("*").alias("c"))
        pick = lambda c, use: F.col(c) if use else F.lit(ALL).cast("long").alias(c)
        level = [inside.groupBy("k", pick("t", t), pick("m", m)).agg(F.sum("c").alias("n")).where(F.col("n") > split) for t, m in SETS]
        large = materialize(reduce(DataFrame.unionByName, level).select("k", "t", "m", "n"), "large")
        listed = large.count() <= MAX_LISTED
        found = quantiles_in_batches(carried(dealt, sets, large.drop("n"), listed).repartition("k", "c"), measures, least)
        asked = [F.array(F.when(F.lit(t), F.col("t")).otherwise(ALL), F.when(F.lit(m), F.col("m")).otherwise(ALL)) for i, (t, m) in enumerate(SETS) if sets >> i & 1]
        members = dealt.select("k", *measures, F.explode(F.array(*asked)).alias("x")).select("k", F.col("x")[0].alias("t"), F.col("x")[1].alias("m"), *measures)
        groups = large.where(F.col("n") >= least).withColumn("gid", F.xxhash64("k", "t", "m"))
        if measures:
            kept = quantiles_by_ranges(members.join(F.broadcast(groups) if listed else groups, ["k", "t", "m"]), measures)
            groups = groups.join(kept, "gid")
        else:
            groups = groups.where(reduce(lambda a, b: a | b, ((F.col("t").__ne__(ALL) == F.lit(t)) & (F.col("m").__ne__(ALL) == F.lit(m)) for i, (t, m) in enumerate(SETS) if sets >> i & 1)))
        found = found.unionByName(groups.drop("gid"))
    else:
        found = quantiles_in_batches(carried(dealt, sets, None).repartition("k", "c"), measures, least)
    named = found.join(own.drop("size"), "k")
    for c, out in (("t", "property_type"), ("m", "month")):
        named = named.join(text.select(F.col("number").alias(c), F.col("text").alias(out)), c, "left").withColumn(out, F.when(F.col(c) == ALL, "ALL").otherwise(F.col(out)))
    wide = {"median_price_m2_mil": ("price_m2_mil", 0.5), "p25_price_m2_mil": ("price_m2_mil", 0.25), "p75_price_m2_mil": ("price_m2_mil", 0.75), "median_price_vnd": ("price_vnd", 0.5), "median_area_m2": ("area_m2", 0.5)}
    return named.select("scope", "area_key", "property_type", "month", "deal_type", "n", *[F.col(slot(*x)).alias(c) for c, x in wide.items() if x[1] in measures.get(x[0], ())]).where(F.col("month").isNotNull())


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing_pct; one pass, then one row per column."""
    wide = df.agg(*[(100 * F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "missing_pct")


def bucket(c: Column) -> Column:
    return F.when(c <= 3, c.cast("int").cast("string")).when(c <= 5, "4-5").when(c <= 10, "6-10").otherwise(">10")


BUCKETS = ("1", "2", "3", "4-5", "6-10", ">10")


def histogram(counts: DataFrame, column: str) -> DataFrame:
    """bucket, n in fixed order, empty buckets with 0."""
    found = counts.groupBy(bucket(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))
    all_ = counts.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(b) for b in BUCKETS])).alias("pos", "bucket"))
    return all_.join(F.broadcast(found), "bucket", "left").select("pos", "bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).orderBy("pos")


def median_of_all(rows: DataFrame, column: str) -> DataFrame:
    """One row: the median of a column (null without a value). Its values are counted by ranges; they never meet in one task."""
    given = rows.where(F.col(column).isNotNull()).select(F.lit(0).cast("long").alias("gid"), column)
    sized = given.join(F.broadcast(given.agg(F.count("*").alias("n"))))
    return quantiles_by_ranges(sized, {column: (0.5,)}).agg(F.max(slot(column, 0.5)).alias("median"))


def overview(view: DataFrame) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    sale = F.col("deal_type") == "sale"
    counts = view.agg(
        F.count("*").alias("n_listings"), F.count_if(sale).alias("n_sale"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
        (F.count_if(F.col("is_price_outlier")) / n).alias("price_outlier_share"), F.coalesce(F.sum("price_vnd"), F.lit(0.0)).alias("sum_price"),
    )
    median = median_of_all(view.where(sale), "price_m2_mil").withColumnRenamed("median", "median_sale_m2")
    return counts.join(F.broadcast(median)).select("n_listings", "n_sale", "first_at", "last_at", "median_sale_m2", "price_outlier_share", "sum_price")


def top_areas(view: DataFrame, key: str, n: int) -> DataFrame:
    """Most listings first; ties by key."""
    return view.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.median("price_m2_mil").alias("median_m2")).orderBy(F.desc("n"), key).limit(n)


def within_top(view: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n largest areas: a semi-join with the top-n subquery."""
    return view.join(top_areas(view, key, n).select(key), key, "left_semi")


def filter_options(view: DataFrame) -> DataFrame:
    return view.where("province IS NOT NULL").groupBy("province").agg(F.sort_array(F.collect_set("district")).alias("districts"), F.sort_array(F.collect_set("month")).alias("months"))


def series(stats: DataFrame, area: str, deal: str = "sale") -> DataFrame:
    """Monthly trend of an area, all types together."""
    return stats.where((F.col("area_key") == area) & (F.col("month") != "ALL") & (F.col("property_type") == "ALL") & (F.col("deal_type") == deal)).select("month", "n", "median_price_m2_mil").orderBy("month")


def children(stats: DataFrame, area: str, scope: str, n: int = 10, least: int = 20, deal: str = "sale") -> DataFrame:
    """Dearest child areas: a prefix predicate on the key, which reaches the scan."""
    return (
        stats.where((F.col("scope") == scope) & F.col("area_key").startswith(area + "|") & (F.col("property_type") == "ALL") & (F.col("month") == "ALL") & (F.col("deal_type") == deal) & (F.col("n") >= least))
        .select("area_key", "n", "median_price_m2_mil").orderBy(F.desc("median_price_m2_mil"), "area_key").limit(n)
    )


def comparables(view: DataFrame, area: float, spread: float = 0.2, **equal: str) -> DataFrame:
    """Same place and type, area within the spread."""
    same = reduce(lambda a, b: a & b, (F.col(k) == v for k, v in equal.items()), F.lit(True))
    return view.where(same & F.col("area_m2").between(area * (1 - spread), area * (1 + spread)))


def fingerprint(df: DataFrame, column: str = "price_vnd") -> DataFrame:
    """Row count and an exact sum: decimals make it independent of order."""
    return df.agg(F.count("*").alias("n"), F.sum(F.col(column).cast("decimal(38,6)")).cast("double").alias("checksum"))


def eda_summary(view: DataFrame, columns: list[str], pair: tuple[str, str], top: int = 10) -> DataFrame:
    """section, key, n, value: months of the data, types, largest provinces with their shares, the share of two provinces, months,
    missing cells in per cent and description lengths."""
    sale = F.median(F.when(F.col("deal_type") == "sale", F.col("price_m2_mil")))
    none, whole = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    row = lambda df, section, key, n=none, value=whole: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("bigint").alias("n"), value.cast("double").alias("value"))
    all_ = view.agg(F.count("*").alias("total"), F.min("month").alias("low"), F.max("month").alias("high"), F.count_if(F.col("province").isin(*pair)).alias("pair"))
    provinces = view.where("province IS NOT NULL").groupBy("province").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "province").limit(top)
    lengths = view.where("description IS NOT NULL").agg(F.percentile(F.length("description"), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("q"))
    named = F.array(*[F.struct(F.lit(name).alias("key"), F.col("q")[i].alias("v")) for i, name in enumerate(("p50", "p90", "p99"))])
    parts = [
        row(all_.select(F.explode(F.array("low", "high")).alias("m")), "period", F.col("m")),
        row(view.groupBy("property_type").agg(F.count("*").alias("n"), sale.alias("v")), "by_type", F.col("property_type"), F.col("n"), F.col("v")),
        row(provinces.join(F.broadcast(all_)), "top_provinces", F.col("province"), F.col("n"), F.col("n") / F.greatest("total", F.lit(1))),
        row(all_, "pair_share", F.lit("+".join(pair)), F.col("pair"), F.col("pair") / F.greatest("total", F.lit(1))),
        row(view.where("month IS NOT NULL").groupBy("month").agg(F.count("*").alias("n"), sale.alias("v")), "monthly", F.col("month"), F.col("n"), F.col("v")),
        row(missing_rates(view, columns), "missing_pct", F.col("column"), none, F.col("missing_pct")),
        row(lengths.select(F.explode(named).alias("x")).select("x.*"), "description_chars", F.col("key"), none, F.col("v")),
    ]
    return reduce(DataFrame.unionByName, parts)


def eda_plots(view: DataFrame, pair: tuple[str, str], top: int = 10, districts: int = 5) -> DataFrame:
    """section, key, a, b, c: price quartiles of types, medians of the largest provinces, outliers in per cent, rows by size of
    their duplicate cluster, largest districts of two provinces."""
    sale = view.where("deal_type = 'sale' AND price_m2_mil IS NOT NULL")
    gap = F.lit(None).cast("double")
    row = lambda df, section, key, a, b=gap, c=gap: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), *[x.cast("double").alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"))])
    q = F.percentile("price_m2_mil", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    size = view.groupBy("dup_cluster_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("province").orderBy(F.desc("n"), "district")
    near = view.where(F.col("province").isin(*pair) & F.col("district").isNotNull()).groupBy("province", "district").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= districts)
    pct = lambda c: 100 * F.avg(F.col(c).cast("int"))
    parts = [
        row(sale.groupBy("property_type").agg(q), "type_quartiles", F.col("property_type"), F.col("q")[0], F.col("q")[1], F.col("q")[2]),
        row(within_top(sale, "province", top).groupBy("province").agg(F.median("price_m2_mil").alias("m")), "province_price", F.col("province"), F.col("m")),
        row(view.groupBy("property_type").agg(pct("is_price_outlier").alias("p"), pct("is_area_outlier").alias("s")), "outliers", F.col("property_type"), F.col("p"), F.col("s")),
        row(histogram(size, "n"), "dup_buckets", F.col("bucket"), F.col("n")),
        row(near, "districts", F.concat_ws("|", "province", "district"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)
