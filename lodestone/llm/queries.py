"""The corpus operators as registered queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embedding_dedup, exact_dedup, fim, language_id, line_dedup, minhash, packing, quality, rank_bpe, resample, urls
from .common import held_out, inline, table

#: The listed rules of op7 (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
INST = "</s>[INST] ok [/INST]"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The split pattern of the public vocabularies; the operators take any."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict_languages(docs, language_id.fit(docs, usable=~held_out("doc_id")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = inline(spark, [(-1, 0, "user", INST), (-1, 1, "assistant", INST)], ["conv_id", "turn", "role", "text"], ["long", "long", "string", "string"])
    return chat.digest(chat.format_chats(rows.unionByName(own)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out("doc_id"))
    return quality.score_quality(docs, model)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = inline(spark, RULES, ["host", "path", "verdict"], ["string"] * 3)
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern())


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_bpe, op3_line_dedup, op4_chat_format, op5_quality, op6_minhash_dedup, op7_url_filter, op8_exact_dedup,
        op9_embedding_dedup, op10_packing, op11_importance, op12_rank_bpe, op13_fill_in_middle,
    )
}

BLANK_ENDS = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HASHED = "('0x' || substr(h, {at}, 8))::BIGINT"

ORACLE_SQL = {
    # DuckDB has no crc32: the table of its 256 steps and the fold over the bytes of each distinct feature are spelt out.
    "op11_importance": f"""
        WITH RECURSIVE bits(b, c, k) AS (
            SELECT range, range, 0 FROM range(256) UNION ALL
            SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        steps AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
        texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
        split AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM texts),
        runs AS (
            SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                                                list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM split),
        counted AS (SELECT side, id, feature, count(*) AS n FROM runs GROUP BY ALL),
        hexed AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM counted)),
        crcs AS (
            SELECT feature, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM hexed, steps),
        cells AS (SELECT side, id, bucket, sum(n) AS n FROM counted JOIN crcs USING (feature) GROUP BY ALL),
        sums AS (
            SELECT range AS bucket, coalesce(sum(n) FILTER (WHERE side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0)::DOUBLE AS t
            FROM range(10000) LEFT JOIN cells ON bucket = range GROUP BY range),
        gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM sums),
        weighed AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM cells JOIN gain USING (bucket) WHERE side = 's' GROUP BY id),
        scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln(({HASHED.format(at=1)} + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM (SELECT doc_id, sha256('42:' || doc_id) AS h FROM documents) JOIN (SELECT id, w FROM split WHERE side = 's') ON id = doc_id LEFT JOIN weighed USING (id)),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS candidates FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, place AS rank
        FROM scored LEFT JOIN (SELECT doc_id, place FROM placed WHERE place <= candidates * 5 // 100) USING (doc_id)""",
    "op13_fill_in_middle": f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
        cut AS (
            SELECT *, least({HASHED.format(at=1)} % (n + 1), {HASHED.format(at=9)} % (n + 1)) AS a, greatest({HASHED.format(at=1)} % (n + 1), {HASHED.format(at=9)} % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {HASHED.format(at=17)} % 100 >= 90 THEN 'plain'
                        WHEN {HASHED.format(at=25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM texts)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t
                   WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                   ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM cut""",
    "op3_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (SELECT doc_id, pos, line, translate({BLANK_ENDS}, '{UPPER}', '{SMALL}') AS k FROM lines),
        repeated AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
        SELECT doc_id, count(*)::BIGINT AS n_lines,
               count(*) FILTER (WHERE first_doc IS NOT NULL AND first_doc <> doc_id)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first_doc IS NULL OR first_doc = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN repeated USING (k) GROUP BY doc_id""",
    "op4_chat_format": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{INST}' UNION ALL SELECT -1, 1, 'assistant', '{INST}'),
        marked AS (
            SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        sized AS (
            SELECT *, CASE WHEN opens THEN length('<|role|>' || role || '<|text|>' || '<|end|>') ELSE length('<|next|>') END + length(text)
                + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]'))
                + CASE WHEN opens THEN len(regexp_extract_all(role, '\\')) + len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]')) ELSE 0 END AS chars
            FROM marked)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op7_url_filter": r"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
            ('example.org', '/en/1', 'allow'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        keyed AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)
        SELECT page_id, host, path,
               (SELECT rule_host || rule_path FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
                ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS rule,
               coalesce((SELECT verdict FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
                ORDER BY length(rule_host || rule_path) DESC LIMIT 1), 'allow') AS verdict
        FROM keyed""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm)::BIGINT AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)""",
    "op9_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
              AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
            WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links,
               least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
               least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) = vec_id AS kept
        FROM embeddings""",
}
