"""Scalar functions over whole tables; their fixed examples stand in relational.py and extras.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import values as V
from lodestone.operators import clean, evaluation, graph
from lodestone.plans.bindings import table
from lodestone.plans.registry import query
from lodestone.session import scratch
from lodestone.sources import io

PRICE = "o_totalprice * 100003.7"


@query("SELECT n_nationkey, 'Quận ' || n_nationkey AS numbered, n_name AS named, 'Phường ' || n_nationkey AS ward FROM nation")
def x03_places_of_nations(spark, d):
    n, k = F.col("n_name"), F.col("n_nationkey").cast("string")
    return table(spark, d, "nation").select(
        "n_nationkey", X.normalize_place(F.concat(F.lit("Q. 0"), k), "district").alias("numbered"), X.normalize_place(F.concat(F.lit("Huyện  "), n), "district").alias("named"),
        X.normalize_place(F.concat(F.lit("p"), k), "ward").alias("ward"),
    )


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^0-9a-z]+', ' ', 'g')) AS key FROM customer")
def x05_folded_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.fold_name(F.concat(F.lit("(x) "), F.col("c_name"))).alias("key"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[*_#`]', '', 'g'), '\s+', ' ', 'g'))) AS answer FROM documents")
def x06_folded_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.fold_answer("text").cast("binary")).alias("answer"))


@query(f"SELECT o_orderkey, CASE WHEN {PRICE} >= 1e9 THEN replace(printf('%.2f', {PRICE} / 1e9), '.', ',') || ' tỷ' ELSE printf('%.0f', {PRICE} / 1e6) || ' triệu' END AS said FROM orders")
def x16_said_prices(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.format_vnd(F.expr(PRICE)).alias("said"))


@query("SELECT n_nationkey, [n_nationkey, n_nationkey + 100]::BIGINT[] AS ids FROM nation")
def x18_cited_nations(spark, d):
    k = F.col("n_nationkey")
    said = F.concat(F.lit("x (tin "), k.cast("string"), F.lit(") y 【Tin# "), (k + 100).cast("string"), F.lit("] [TIN#"), k.cast("string"), F.lit("]"))
    return table(spark, d, "nation").select("n_nationkey", X.cited_ids(said).alias("ids"))


@query(r"""SELECT item_id, md5('<documents>' || chr(10) || '<document index="1">' || chr(10) || text || '<\/document>' || chr(10) || '</document>' || chr(10) || '</documents>') AS h FROM benchmark""")
def x19_wrapped_benchmark(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(X.wrap_documents(F.array(F.concat("text", F.lit("</document>")))).cast("binary")).alias("h"))


@query("SELECT o_orderkey, (o_orderkey % 90 + 1) * 1000 + rpad((o_orderkey % 1000)::VARCHAR, 3, '0')::DOUBLE AS million, (o_orderkey % 50 + 1) * 1000.0 + o_orderkey % 777 AS both FROM orders")
def x20_said_amounts(spark, d):
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    return table(spark, d, "orders").select(
        "o_orderkey", V.money_million(F.concat(text(k % 90 + 1), F.lit(" Tỷ "), text(k % 1000))).alias("million"),
        V.money_million(F.concat(text(k % 50 + 1), F.lit("tỷ "), text(k % 777), F.lit(" triệu"))).alias("both"),
    )


@query("SELECT o_orderkey, o_orderkey % 1000 + (10 + o_orderkey % 89) / 100.0::DOUBLE AS number, (o_orderkey % 1000 + 1) * 1000000.0::DOUBLE AS thousands FROM orders")
def x21_numbers_of_answers(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", V.answer_number(F.concat((k % 1000).cast("string"), F.lit(","), (k % 89 + 10).cast("string"))).alias("number"), V.answer_number(F.concat((k % 1000 + 1).cast("string"), F.lit(".000.000"))).alias("thousands"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL WHEN value > 0 THEN value END AS price FROM events")
def x30_prices_of_events(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, "abc").when(F.col("event_id") % 4 == 1, "-5").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return table(spark, d, "events").select("event_id", V.parse_price(raw).alias("price"))


LOW = "l_returnflag <> 'R' AND l_extendedprice * 100 < 1e8"
PLAUSIBLE = "l_extendedprice * 100 * 1000 / (l_quantity * 1e6) BETWEEN 5 AND 2000"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {LOW} THEN CASE WHEN {PLAUSIBLE} THEN l_extendedprice * 100 * 1000 END ELSE l_extendedprice * 100 END AS price, {LOW} AND {PLAUSIBLE} AS fixed FROM lineitem")
def x31_prices_in_thousands(spark, d):
    price, flag = V.fix_thousand(F.col("l_extendedprice") * 100, F.col("l_quantity"), F.when(F.col("l_returnflag") == "R", "rent").otherwise("sale"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", price.alias("price"), flag.alias("fixed"))


@query("SELECT n_nationkey, ((n_nationkey + 1) * (n_nationkey + 2))::DOUBLE AS area, true AS inside, false AS outside FROM nation")
def x45_rings_of_nations(spark, d):
    w, h = (F.col("n_nationkey") + i for i in (1, 2))
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ring = F.array(corner(F.lit(0), F.lit(0)), corner(w, F.lit(0)), corner(w, h), corner(F.lit(0), h))
    return table(spark, d, "nation").select("n_nationkey", V.ring_area(ring).alias("area"), V.point_in_ring(w / 2.0, h / 3.0, ring).alias("inside"), V.point_in_ring(w + 0.5, h / 3.0, ring).alias("outside"))


@query("SELECT conv_id, list(role ORDER BY first_turn)[1:2] AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY 1")
def t05_first_roles(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return c.select("conv_id", F.slice(F.array_distinct("r"), 1, 2).alias("roles"))


@query("""WITH e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey % 5 AS ca, b.s_nationkey % 5 AS cb FROM supplier a JOIN supplier b ON b.s_suppkey IN (a.s_suppkey + 1, a.s_suppkey + 7)),
    m AS (SELECT count(*)::DOUBLE AS m FROM e), d AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY 1), l AS (SELECT ca AS c, count(*) AS l FROM e WHERE ca = cb GROUP BY 1)
    SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM d LEFT JOIN l USING (c), m""")
def c20_modularity_of_suppliers(spark, d):
    s = table(spark, d, "supplier")
    steps = s.select(F.col("s_suppkey").alias("a"), F.explode(F.array(F.col("s_suppkey") + 1, F.col("s_suppkey") + 7)).alias("b"))
    pairs = steps.join(s.select(F.col("s_suppkey").alias("b")), "b", "left_semi").select("a", "b")
    label = s.select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 5).alias("community"))
    return graph.modularity(pairs, label).select(F.round("modularity", 6).alias("modularity"))


@query("""SELECT n_nationkey, lower(replace(r_name, ' ', '_')) AS key, r_name AS name, 2 AS n_patterns, true AS matched FROM nation JOIN region ON n_regionkey = r_regionkey""")
def s07_dictionary_of_regions(spark, d):
    """A dictionary file of the regions, written, read back and matched with the nations' region names."""
    path = scratch(spark, "dictionary")
    key = F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))
    line = F.concat(key, F.lit(': {name: "'), F.col("r_name"), F.lit("\", patterns: ['"), F.lower("r_name"), F.lit("', '\\bnone\\b']}"))
    rows = table(spark, d, "region")
    rows.select(F.lit("# regions").alias("value")).limit(1).unionByName(rows.select(line.alias("value"))).coalesce(1).write.text(path)
    found = io.read_dictionary(spark, path)
    nations = table(spark, d, "nation").join(rows, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("name"))
    return nations.join(found, "name").select("n_nationkey", "key", "name", F.size("patterns").alias("n_patterns"), F.exists("patterns", lambda p: F.rlike(F.lower("name"), p)).alias("matched"))


# DuckDB has no crc32: the table of its 256 steps and the fold over the bytes of each distinct word are spelt out.
@query(r"""WITH RECURSIVE bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    steps AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
    w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM documents), h AS (SELECT term, hex(encode(term)) AS x FROM w)
    SELECT term, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) & 2147483647 AS id FROM h, steps""")
def x14_token_ids_of_documents(spark, d):
    """The id of every distinct word of all documents."""
    return table(spark, d, "documents").select(F.explode(X.words(F.col("text"))).alias("term")).distinct().withColumn("id", X.token_id(F.col("term")))


PAIRS = "(VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(clean.PROVINCES_2025.items())) + ") p(i, old, now)"


@query(f"SELECT c_custkey, old, now FROM customer JOIN {PAIRS} ON i = c_custkey % 63 UNION ALL SELECT s_suppkey + 1000000000, s_name, s_name FROM supplier")
def x04_provinces_2025(spark, d):
    """Every customer's province of before 2025 and the one of today; names that are none stay as they are."""
    names = F.array(*[F.lit(n) for n in clean.PROVINCES_2025])
    old = table(spark, d, "customer").select("c_custkey", F.element_at(names, (F.col("c_custkey") % 63 + 1).cast("int")).alias("old"))
    old = old.unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"), F.col("s_name").alias("old")))
    return old.join(clean.provinces_2025(spark), "old", "left").select("c_custkey", "old", F.coalesce("new", "old").alias("now"))


# Answers made of the orders, so that what should be found in them is known by arithmetic.
LOW, HIGH, MILLION = "(o_custkey % 9 + 1)", "(o_custkey % 9 + 1 + o_orderkey % 5 + 1)", "(100 + o_custkey % 800)"
SAID = f"""CASE o_orderkey % 4 WHEN 0 THEN concat('Tháng ', month(o_orderdate), '/', year(o_orderdate), ' và ', year(o_orderdate), '-', lpad(cast(month(o_orderdate) % 12 + 1 AS {{t}}), 2, '0'))
    WHEN 1 THEN concat('khoảng ', {LOW}, ' đến ', {HIGH}, ' tỷ') WHEN 2 THEN concat({MILLION}, ' triệu') ELSE 'Không có dữ liệu.' END"""
MONTH_OF = "concat(year(o_orderdate), '-', lpad(cast({} AS VARCHAR), 2, '0'))"


@query(f"""SELECT o_orderkey, {SAID.format(t="VARCHAR")} AS said,
    CASE WHEN o_orderkey % 4 = 0 THEN least({MONTH_OF.format("month(o_orderdate)")}, {MONTH_OF.format("month(o_orderdate) % 12 + 1")}) || ',' || greatest({MONTH_OF.format("month(o_orderdate)")}, {MONTH_OF.format("month(o_orderdate) % 12 + 1")}) ELSE '' END AS months,
    CASE o_orderkey % 4 WHEN 1 THEN ({LOW} + {HIGH}) / 2.0::DOUBLE WHEN 2 THEN {MILLION} / 1000.0::DOUBLE END AS bn, o_orderkey % 4 = 3 AS refused FROM orders""")
def x22_answers_of_orders(spark, d):
    """Months, amounts and refusals in an answer for every order."""
    f = table(spark, d, "orders").select("o_orderkey", F.expr(SAID.format(t="string")).alias("said")).withColumn("f", X.fold_answer("said"))
    return f.select("o_orderkey", "said", F.array_join(F.sort_array(evaluation.answer_months(F.col("f"))), ",").alias("months"), evaluation.forecast_bn(F.col("f")).alias("bn"), evaluation.is_refusal(F.col("f")).alias("refused"))


NUMBER, SHADE = "((o_custkey % 9 + 1) * 100)", "(CAST(floor(o_orderkey / 6) AS BIGINT) % 4)"
OFF = f"(CASE {SHADE} WHEN 0 THEN 100 WHEN 1 THEN 103 WHEN 2 THEN 115 ELSE 160 END)"
SCORED = {
    "answer": f"""CASE o_orderkey % 6 WHEN 0 THEN concat('giá là ', CAST({NUMBER} * {OFF} / 100 AS BIGINT), ' triệu') WHEN 1 THEN CASE WHEN {SHADE} < 2 THEN 'Không có dữ liệu' ELSE 'Giá là 5' END
        WHEN 2 THEN concat('Tháng ', CASE WHEN {SHADE} < 2 THEN month(o_orderdate) ELSE month(o_orderdate) % 12 + 1 END, '/', year(o_orderdate))
        WHEN 3 THEN CASE WHEN {SHADE} < 2 THEN concat('Quận ', o_custkey % 4 + 1, ' cao hơn Quận ', o_custkey % 4 + 6) ELSE concat('Quận ', o_custkey % 4 + 6, ' cao hơn Quận ', o_custkey % 4 + 1) END WHEN 4 THEN 'x' ELSE '' END""",
    "question": "CASE o_orderkey % 6 WHEN 3 THEN concat('Quận ', o_custkey % 4 + 1, ' hay Quận ', o_custkey % 4 + 6, '?') ELSE '?' END",
    "category": "CASE o_orderkey % 6 WHEN 1 THEN 'unanswerable' WHEN 3 THEN 'comparison' ELSE 'lookup' END",
    "gt_kind": "CASE o_orderkey % 6 WHEN 1 THEN 'refusal' WHEN 4 THEN 'ids' ELSE 'value' END",
    "gt_value": f"CASE o_orderkey % 6 WHEN 0 THEN CAST({NUMBER} AS string) WHEN 2 THEN concat(year(o_orderdate), '-', lpad(CAST(month(o_orderdate) AS string), 2, '0')) WHEN 3 THEN concat('Quận ', o_custkey % 4 + 1) WHEN 5 THEN '7' END",
    "value_tolerance": "CAST(NULL AS double)",
    "recall_5": f"CASE WHEN o_orderkey % 6 = 4 THEN CAST(CASE {SHADE} WHEN 0 THEN 0.85 WHEN 1 THEN 0.8 WHEN 2 THEN 0.2 ELSE 0 END AS double) END",
}


@query(f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN [2, 2, 1, 0][{SHADE} + 1] WHEN 4 THEN [2, 2, 1, 0][{SHADE} + 1] WHEN 5 THEN 0 ELSE CASE WHEN {SHADE} < 2 THEN 2 ELSE 0 END END AS points FROM orders")
def c23_scores_of_orders(spark, d):
    """The rules' points for an answer to a question about every order."""
    rows = table(spark, d, "orders").select("o_orderkey", *[F.expr(e).alias(k) for k, e in SCORED.items()])
    return evaluation.score_answers(rows).select("o_orderkey", "points")


JUDGED = {
    "points": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_id % 3 END", "error": "CASE WHEN event_id % 11 = 0 THEN 'boom' END",
    "answer": "CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'Không có dữ liệu' ELSE 'x' END", "category": "CASE WHEN event_id % 5 = 0 THEN 'unanswerable' ELSE 'lookup' END",
    "system": "CASE user_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'basic_rag' ELSE 'llm_only' END", "route": "'r'", "route_gold": "CASE WHEN user_id % 4 = 0 THEN 'g' ELSE 'r' END",
    "cypher": "CASE WHEN event_id % 17 = 0 THEN 'MATCH' END", "gt_kind": "CASE WHEN event_id % 6 < 2 THEN 'ids' ELSE 'value' END", "recall_5": "CASE WHEN event_id % 4 > 0 THEN 0.5 END",
    "n_unsupported": "CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END", "faithfulness": "CASE WHEN event_id % 23 = 0 THEN 0.3 WHEN event_id % 23 = 1 THEN 0.5 END",
}


@query("WITH j AS (SELECT event_id, user_id % 5 = 0 AS wrong, " + ", ".join(f"{e} AS {k}" for k, e in JUDGED.items()) + """ FROM events)
    SELECT event_id, CASE WHEN points IS NULL OR points = 2 THEN NULL WHEN error IS NOT NULL AND answer = '' THEN 'runtime_error' WHEN category = 'unanswerable' THEN 'refusal_missing'
        WHEN system = 'hybrid' AND route <> route_gold THEN 'router_wrong' WHEN cypher IS NOT NULL AND error IS NOT NULL THEN 'cypher_error' WHEN gt_kind = 'ids' AND system = 'llm_only' THEN 'insufficient_context'
        WHEN gt_kind = 'ids' AND coalesce(recall_5, 0) = 0 AND wrong THEN 'filter_wrong' WHEN gt_kind = 'ids' THEN 'retrieval_miss' WHEN n_unsupported > 0 THEN 'llm_hallucination'
        WHEN answer = 'Không có dữ liệu' THEN 'insufficient_context' WHEN faithfulness < 0.5 THEN 'llm_hallucination' WHEN cypher IS NOT NULL THEN 'cypher_wrong_result' ELSE 'insufficient_context' END AS cause FROM j""")
def c25_causes_of_events(spark, d):
    """The cause of a bad answer for every event, by the first rule that fits."""
    rows = table(spark, d, "events").select("event_id", "user_id", *[F.expr(e).alias(k) for k, e in JUDGED.items()])
    rows = rows.withColumn("unsupported", F.array_repeat(F.lit(1).cast("long"), F.col("n_unsupported")))
    return rows.select("event_id", evaluation.error_cause(F.col("user_id") % 5 == 0).alias("cause"))
