"""Queries over the methods with data structures of their own: spatial joins, streams with state, paired resampling, name batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import names, resampling, segment, spatial
from lodestone.plans.bindings import listings, table, with_listings
from lodestone.plans import relational  # noqa: F401  (registers the SQL that is shared)
from lodestone.plans.registry import ORACLES, query
from lodestone.session import materialize, scratch
from lodestone.sources import versions
from lodestone.streaming import window_state

# Areas: an eight-pointed ring with a square hole for each nation, and a wide one for each region.
DIRECTIONS = [(1.0, 0.0), (0.7, 0.7), (0.0, 1.0), (-0.7, 0.7), (-1.0, 0.0), (-0.7, -0.7), (0.0, -1.0), (0.7, -0.7)]
HOLE = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]


def star(key, x, y, radius):
    """rings of an area around a point; the radius of every second direction is half of it."""
    outer = F.array(*[F.array(x + dx * radius / (1 + i % 2), y + dy * radius / (1 + i % 2)) for i, (dx, dy) in enumerate(DIRECTIONS)])
    hole = F.array(*[F.array(x + dx, y + dy) for dx, dy in HOLE])
    return key, F.array(outer, hole).alias("rings")


def nation_areas(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(*star(k.alias("area"), (k * 7 % 25).cast("double"), (k * 11 % 25).cast("double"), 2.0 + (k % 3).cast("double")))


def region_areas(spark, d):
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(*star(k.alias("area"), (k * 5).cast("double") + 2.0, (k * 13 % 25).cast("double"), F.lit(9.0)))


def star_sql(key: str, x: str, y: str, radius: str, source: str) -> str:
    """The edges of the same areas: area, ring, x0, y0, x1, y1, and px, py of each vertex."""
    corners = ", ".join([f"(0, {i}, 8, {dx}::DOUBLE, {dy}::DOUBLE, {1 + i % 2}::DOUBLE)" for i, (dx, dy) in enumerate(DIRECTIONS)] + [f"(1, {i}, 4, {dx}::DOUBLE, {dy}::DOUBLE, 0::DOUBLE)" for i, (dx, dy) in enumerate(HOLE)])
    at = lambda c, z: f"{z} + CASE WHEN w = 0 THEN {c} ELSE {c} * ({radius}) / w END"
    return f"""(SELECT a.area, a.px AS x0, a.py AS y0, b.px AS x1, b.py AS y1 FROM
        (SELECT {key} AS area, ring, i, n, {at("dx", x)} AS px, {at("dy", y)} AS py FROM {source}, (VALUES {corners}) c(ring, i, n, dx, dy, w)) a JOIN
        (SELECT {key} AS area, ring, i, n, {at("dx", x)} AS px, {at("dy", y)} AS py FROM {source}, (VALUES {corners}) c(ring, i, n, dx, dy, w)) b
        ON a.area = b.area AND a.ring = b.ring AND b.i = (a.i + 1) % a.n)"""


NATION_EDGES = star_sql("n_nationkey", "(n_nationkey * 7 % 25)::DOUBLE", "(n_nationkey * 11 % 25)::DOUBLE", "2.0::DOUBLE + n_nationkey % 3", "nation")
REGION_EDGES = star_sql("r_regionkey", "(r_regionkey * 5)::DOUBLE + 2.0::DOUBLE", "(r_regionkey * 13 % 25)::DOUBLE", "9.0::DOUBLE", "region")
CROSSED = "(y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0"
POINTS = """(SELECT 'supplier' AS kind, s_suppkey AS id, (s_suppkey * 37 % 1000)::DOUBLE / 40 AS x, (s_suppkey * 91 % 997)::DOUBLE / 40 AS y FROM supplier
    UNION ALL SELECT 'customer', c_custkey, (c_custkey * 53 % 1009)::DOUBLE / 40, (c_custkey * 29 % 991)::DOUBLE / 40 FROM customer)"""


def points(spark, d):
    at = lambda k, a, b: ((F.col(k) * a % b).cast("double") / 40)
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), at("s_suppkey", 37, 1000).alias("x"), at("s_suppkey", 91, 997).alias("y"))
    return s.unionByName(table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), at("c_custkey", 53, 1009).alias("x"), at("c_custkey", 29, 991).alias("y")))


@query(f"SELECT kind, id, area FROM {POINTS} p, {NATION_EDGES} e WHERE {CROSSED} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1")
def j22_points_in_areas(spark, d):
    """Suppliers and customers with every nation's area that holds them."""
    return spatial.join_areas(points(spark, d), "x", "y", nation_areas(spark, d), "area", "rings", 0.5).select("kind", "id", "area")


@query(f"""WITH held AS (SELECT kind, id FROM {POINTS} p, {NATION_EDGES} e WHERE {CROSSED} GROUP BY 1, 2, area HAVING count(*) % 2 = 1)
    SELECT id, min_by(area, (d, area)) AS area, round(sqrt(min(d)), 6) AS distance FROM
        (SELECT id, area, (x - x0) * (x - x0) + (y - y0) * (y - y0) AS d FROM {POINTS} p, {NATION_EDGES} e WHERE kind = 'supplier' AND id NOT IN (SELECT id FROM held WHERE kind = 'supplier')) GROUP BY 1""")
def j22_nearest_areas(spark, d):
    """Suppliers in no area, with the area of the nearest vertex."""
    own, areas = points(spark, d).where("kind = 'supplier'"), nation_areas(spark, d)
    outside = spatial.join_areas(own, "x", "y", areas, "area", "rings", 0.5, how="left").where("area IS NULL").drop("area")
    return spatial.nearest_area(outside, "id", "x", "y", areas, "area", "rings").select("id", "area", F.round("distance", 6).alias("distance"))


@query(f"""WITH e AS (SELECT * FROM {NATION_EDGES}), box AS (SELECT area, min(x0) AS lx, max(x0) AS hx, min(y0) AS ly, max(y0) AS hy FROM e GROUP BY 1),
    grid AS (SELECT area AS inner_area, i.range * 9 + j.range AS n, lx + (hx - lx) * (i.range + 0.5::DOUBLE) / 9 AS x, ly + (hy - ly) * (j.range + 0.5::DOUBLE) / 9 AS y FROM box, range(9) i, range(9) j),
    probe AS (SELECT inner_area, n, any_value(x) AS x, any_value(y) AS y FROM grid, e WHERE area = inner_area AND {CROSSED} GROUP BY 1, 2 HAVING count(*) % 2 = 1),
    held AS (SELECT inner_area, n, area FROM probe, {REGION_EDGES} r WHERE {CROSSED} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
    v AS (SELECT inner_area, area, count(*) AS votes FROM held GROUP BY 1, 2),
    won AS (SELECT inner_area, area, votes FROM v QUALIFY row_number() OVER (PARTITION BY inner_area ORDER BY votes DESC, area) = 1),
    middle AS (SELECT area AS inner_area, avg(x0) AS x, avg(y0) AS y FROM e WHERE area NOT IN (SELECT inner_area FROM won) GROUP BY 1),
    near AS (SELECT inner_area, area FROM middle, {REGION_EDGES} r QUALIFY row_number() OVER (PARTITION BY inner_area ORDER BY (x - x0) * (x - x0) + (y - y0) * (y - y0), area) = 1)
    SELECT inner_area AS area, area AS other, votes AS n FROM won UNION ALL SELECT inner_area, area, 0 FROM near""")
def j22_area_votes(spark, d):
    """The region of every nation's area: by votes of its probe points, else by the nearest vertex."""
    return spatial.match_areas(nation_areas(spark, d), region_areas(spark, d), "area", "rings", 1.0)


# Streams

#: Sets of users that share a state; a call to the state store costs more than a thousand hits.
LANES = 128


@query(ORACLES["r01_rate_limit"])
def r01_limited_stream(spark, d):
    """All events through the stream with state: the earlier half, a restart, the later half, and a mark that ends the stream."""
    events, source, out, check = table(spark, d, "events").select("event_id", "user_id", "ts"), scratch(spark, "events"), scratch(spark, "limited"), scratch(spark, "state")
    middle, last = events.agg(F.percentile_approx("ts", 0.5), F.max("ts")).first()
    steps = [events.where(F.col("ts") <= F.lit(middle)), events.where(F.col("ts") > F.lit(middle))]
    ends = [spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.lit(last) + F.expr(f"INTERVAL {n} DAY")).alias("ts")) for n in (10, 20)]
    for step in (*steps, *ends):
        step.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        window_state.run_to_end(window_state.limit_with_state(stream, "user_id", "ts", "event_id", 2, 3600.0, "1 minute", 86_400.0, LANES), out, check, 2 * spark.sparkContext.defaultParallelism)
    return spark.read.schema(window_state.OUTPUT).parquet(out).where("k <> '-1'").select(F.col("id").alias("event_id"), "retry_after")


# Paired resampling

REPLICATES, SEED = 400, 42
WIDE = "18446744073709551616::UHUGEINT"


def mixed(z: str, shift: int, factor: int) -> str:
    return f"((xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {WIDE})::UBIGINT"


def paired_sql(measures: str) -> str:
    """The same weights by the same arithmetic, one row for each row and replicate."""
    step = resampling.STEPS
    start = f"((doc_id::UHUGEINT * {step[0]}::UHUGEINT) % {WIDE} + (range::UHUGEINT * {step[1]}::UHUGEINT) % {WIDE} + ({SEED}::UHUGEINT * {step[2]}::UHUGEINT) % {WIDE}) % {WIDE}"
    weight = " + ".join(f"(draw >= {t}::UBIGINT)::INT" for t in resampling.DRAWS)
    return f"""WITH m AS ({measures}), z0 AS (SELECT range AS boot, a, b, ({start})::UBIGINT AS z FROM m, range({REPLICATES})),
        z1 AS (SELECT boot, a, b, {mixed("z", 30, resampling.MIX[0])} AS z FROM z0), z2 AS (SELECT boot, a, b, {mixed("z", 27, resampling.MIX[1])} AS z FROM z1),
        w AS (SELECT boot, a, b, {weight} AS w FROM (SELECT boot, a, b, xor(z, z >> 31) >> 11 AS draw FROM z2)),
        d AS (SELECT boot, (sum(w * a) - sum(w * b)) / sum(w) AS diff FROM w GROUP BY 1 HAVING sum(w) > 0), al AS (SELECT count(*) AS n, avg(a - b) AS diff FROM m)
        SELECT any_value(al.n) AS n, round(any_value(al.diff), 6) AS diff, round(quantile_cont(d.diff, 0.025), 6) AS low, round(quantile_cont(d.diff, 0.975), 6) AS high,
               round(avg(CASE WHEN al.diff > 0 THEN d.diff <= 0 WHEN al.diff < 0 THEN d.diff >= 0 ELSE true END::INT), 6) AS p_value FROM d, al"""


def paired_row(rows):
    found = resampling.paired_test(rows, "doc_id", "a", "b", REPLICATES, SEED)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("diff", "low", "high", "p_value")])


@query(paired_sql("SELECT doc_id, quality::DOUBLE AS a, toxic::DOUBLE AS b FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL"))
def c24_paired_labels(spark, d):
    """The difference of the means of two labels of each document, its interval and its p value."""
    return paired_row(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b")))


@query(paired_sql("SELECT doc_id, ln(1 + n_chars) AS a, ln(1 + length(text)) * (1 + 0.01::DOUBLE * (doc_id % 3 - 1)) AS b FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL"))
def c24_paired_measures(spark, d):
    """The same for two real measures of every document."""
    t = table(spark, d, "documents")
    return paired_row(t.select("doc_id", F.log1p("n_chars").alias("a"), (F.log1p(F.length("text")) * (1 + 0.01 * (F.col("doc_id") % 3 - 1))).alias("b")))


# Names


ASKED = "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Chung cư ' || p_brand || ' ' || split_part(p_name, ' ', 1) ELSE 'Brand' END"
SMALL = "replace(lower({}), '#', ' ')"


@query(with_listings(f"""SELECT id, name, tier, rank FROM (SELECT id, name, (r).t AS tier, row_number() OVER (PARTITION BY id ORDER BY r, name)::INTEGER AS rank FROM (
        SELECT id, name, min({{'t': tier, 'n': -n}}) AS r FROM (
            SELECT id, project AS name, n, CASE WHEN key = q THEN 0 WHEN contains(' ' || key || ' ', ' ' || q || ' ') THEN 1 WHEN contains(' ' || q || ' ', ' ' || key || ' ') THEN 2 END AS tier
            FROM (SELECT p_partkey AS id, {SMALL.format("replace(" + ASKED + ", 'Chung cư ', '')")} AS q FROM part),
                 (SELECT project, count(*) AS n, {SMALL.format("project")} AS key FROM listings WHERE project IS NOT NULL GROUP BY project, district, province)) WHERE tier IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 20"""))
def c27_batch_names(spark, d):
    """A text for every part, resolved against the projects of the listings in one plan."""
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(ASKED).alias("value"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("province"))
    return names.resolve_all(names.vocabulary(listings(spark, d), "project"), asked)


# Versions


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, 4 AS version, true AS conflict FROM embeddings WHERE vec_id % 7 <> 0
    UNION ALL SELECT vec_id + 1000000, label, 4, true FROM embeddings WHERE vec_id % 5 = 0""")
def s16_versioned_upsert(spark, d):
    """All vectors' labels: changed, removed, added, the addition done again, and compacted; a writer of an old version conflicts."""
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    t = versions.VersionedTable(spark, scratch(spark, "versions"), "vec_id")
    t.create(rows)
    t.upsert(rows.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100))
    t.remove(rows.where("vec_id % 7 = 0").select("vec_id"))
    more = rows.where("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    t.upsert(more)
    try:
        t.upsert(more, at=2)
        conflict = False
    except versions.Conflict:
        conflict = True
    last = t.compact()
    return t.read(last).withColumns({"version": F.lit(last), "conflict": F.lit(conflict)})


@query("SELECT 'first' AS seen, count(*) AS n FROM embeddings UNION ALL SELECT 'second', count(*) FROM embeddings WHERE vec_id % 2 = 0")
def s18_durable_name(spark, d):
    """A name that is moved to another table: another session sees each target."""
    rows, folder = table(spark, d, "embeddings").select("vec_id"), scratch(spark, "names")
    other, out = spark.newSession(), None
    for k, part in (("first", rows), ("second", rows.where("vec_id % 2 = 0"))):
        path = scratch(spark, "target")
        part.write.parquet(path)
        versions.set_name(spark, folder, "vectors", path)
        seen = other.read.parquet(versions.target_of(other, folder, "vectors")).count()
        one = spark.range(1).select(F.lit(k).alias("seen"), F.lit(seen).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# Segmentation

LEAST_COUNT, ATTRACTION = 5, 3.0
RUNS_SQL = r"""runs AS (SELECT string_split_regex(r, ' +') AS s FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+(?: +[\p{L}\p{N}_]+)*')) AS r FROM documents)),
    c AS (SELECT unit, len(string_split(unit, ' '))::INTEGER AS n, count(*) AS count FROM (SELECT unnest(s) AS unit FROM runs
        UNION ALL SELECT unnest(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1])) FROM runs
        UNION ALL SELECT unnest(list_transform(range(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 1] || ' ' || s[i + 2])) FROM runs) GROUP BY 1)"""


@query(f"""WITH {RUNS_SQL}, k AS (SELECT *, string_split(unit, ' ') AS w FROM c WHERE count >= {LEAST_COUNT}), total AS (SELECT sum(count)::DOUBLE AS t FROM c WHERE n = 1),
    cuts AS (SELECT unit, n, count, array_to_string(w[1:i], ' ') AS a, array_to_string(w[i + 1:], ' ') AS b FROM (SELECT *, unnest(range(1, n)) AS i FROM k WHERE n > 1)),
    scored AS (SELECT unit, n, cuts.count, min(ln(cuts.count * t / (ka.count * kb.count))) AS score FROM cuts JOIN (SELECT unit AS a, count FROM k) ka USING (a) JOIN (SELECT unit AS b, count FROM k) kb USING (b), total GROUP BY 1, 2, 3)
    SELECT unit, n, count, round(score, 6) AS score FROM scored WHERE score >= {ATTRACTION} UNION ALL SELECT unit, n, count, 0 FROM k WHERE n = 1""")
def x13_learnt_units(spark, d):
    """The units of all documents: frequent syllables and runs of syllables that attract each other."""
    counts = materialize(segment.run_counts(table(spark, d, "documents"), "text"), "runs")
    return segment.learnt_units(counts, LEAST_COUNT, ATTRACTION).select("unit", "n", "count", F.round("score", 6).alias("score"))


@query("SELECT doc_id, length(text) AS n_chars, true AS kept FROM documents WHERE text IS NOT NULL")
def x13_segmented_documents(spark, d):
    """Every document cut into units: all its characters are kept, but for underscores in place of blanks inside units."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    counts = materialize(segment.run_counts(docs, "text"), "runs")
    out = segment.with_segments(docs.where("text IS NOT NULL"), segment.load_model(segment.learnt_units(counts, LEAST_COUNT, ATTRACTION)))
    same = F.translate("segmented", "_", " ") == F.translate("text", "_", " ")
    return out.select("doc_id", F.length("segmented").cast("long").alias("n_chars"), (same & (F.size("units") <= F.length("text"))).alias("kept"))
