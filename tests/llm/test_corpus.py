"""Corpus operators against brute force, round trips, SQL and held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connection, same_rows
from lodestone.llm import bpe, chat, common, embedding_dedup, exact_dedup, language_id, line_dedup, minhash, packing, pieces, quality, urls
from lodestone.llm.queries import ORACLE_SQL, QUERIES, RULES, vocabulary

SF = "/root/testdata/sf0.001"
BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
LONG = "lang und weit " * 9000
#: Nulls, empty and very long texts, ties, repeated rows, blanks, odd characters; the further columns clash with inner names.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "The cat sat on the mat today.\nSecond line here, long\nx"), (5, "the CAT sat on the mat today. \nAnother one, all new"),
    (6, LONG), (7, LONG + "!"), (8, "a b c"), (8, "a b c"), (9, "ab c"), (None, "a b c"), (None, None), (10, "x" * 70000), (11, "é́ 日本語 <|endoftext|> don't\x1c\x85 12²½"),
    (12, "!!! ... 123"), (13, "Second line here, long\nSecond line here, long\n"), (14, "abc" * 3000 + "\n" + "abc" * 3000), (15, "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if k % 2 else None, "s", len(t or ""), "block", 1, 2) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string, name int, doc int")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# Language


def test_language_held_out(spark):
    rows = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def plain_language(model, text):
    """The model's answer by single steps: every n-gram of every word hashed with plain integers, then mean, softmax, thresholds."""
    top = (1 << 64) - 1

    def bucket(h):
        h = (h ^ (h >> 31)) * 0x9E3779B97F4A7C15 & top
        return (h ^ (h >> 29)) % len(model.embed)

    ids = []
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        raw = b"<" + w.encode() + b">"
        for n in (2, 3, 4):
            for a in range(len(raw) - n + 1):
                h = 0
                for b in raw[a : a + n]:
                    h = (h * 1000003 + b + 1) & top
                ids.append(bucket((h + (n << 56)) & top))
        ids.append(bucket((sum((b + 1) * pow(31, k & 0xFFFF, 1 << 64) for k, b in enumerate(raw)) + 1) & top))
    if not ids:
        return "und", 0.0, True
    z = (model.embed[ids].astype(np.float64).mean(axis=0) @ model.out + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    k = int(p.argmax())
    return model.languages[k], p[k], bool(p[k] < model.least_score[k] or model.met[ids].mean() < model.least_met[k])


def test_language_equals_plain_steps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, usable=~common.held_out("doc_id"))
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").collect()}
    rows = [r for r in docs.where("doc_id % 4 = 1").collect() if len(r["text"] or "") < 6000][:200]
    for r in rows:
        lang, score, rejected = plain_language(model, r["text"])
        mine = got[r["doc_id"]]
        assert mine["lang_pred"] == lang and abs(mine["score"] - score) < 1e-4 and mine["rejected"] == rejected


#: Letters without sense, and words of languages that the tables don't hold.
FOREIGN = [
    "asdkj qwlek zxcmn qpwoe rutiy fjdks wqpo vbnm", "sdfg hjkl wert zxcv bnmq lkjh gfds rtzu", "これは日本語の文章です。今日は天気がいい", "Это русский текст о погоде и природе",
    "Αυτό είναι ένα ελληνικό κείμενο", "Příliš žluťoučký kůň úpěl ďábelské ódy", "Bu bir Türkçe metin örneğidir ve güzel", "Det här är en svensk text om vädret och naturen",
    "هذا نص عربي عن الطقس", "这是一段关于天气的中文文字", "이것은 날씨에 관한 한국어 글입니다", "xkcd qqqq zzzz wwww jjjj kkkk vvvv", "זהו טקסט בעברית על מזג האוויר", "นี่คือข้อความภาษาไทย",
]


def test_language_rejects_noise_and_foreign_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, usable=~common.held_out("doc_id"))
    assert 0.01 < model.temperature < 50 and (model.least_score > 0).all() and (model.least_met > 0).all()
    held = [r["text"] for r in docs.where(common.held_out("doc_id")).collect()]
    _, _, rejected = model.predict(held)
    assert rejected.mean() <= 0.01
    noise = language_id.negatives(held, np.random.default_rng(1))
    assert np.mean(model.predict(noise)[2]) >= 0.95 and model.predict(FOREIGN)[2].all()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(FOREIGN)], "doc_id long, text string")
    assert language_id.keep_identified(df, model).count() == 0


def test_language_odd_rows(spark, odd):
    model = language_id.train(["the cat and the dog"] * 20 + ["der hund und die katze"] * 20, ["en"] * 20 + ["de"] * 20)
    got = language_id.predict_languages(odd, model).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["rejected"] and by[i][0]["score"] == 0 for i in (1, 2, 3, 12))
    assert by[4][0]["lang_pred"] == "en" and by[6][0]["lang_pred"] == "de"
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3, 12}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language_id.predict_languages(odd.limit(0), model).count() == 0
    none = language_id.fit(odd.where("lang = 'zz'"))
    assert {r["lang_pred"] for r in language_id.predict_languages(odd, none).collect()} == {"und"}


def test_language_models_do_not_share_words():
    one = language_id.train(["the cat and the dog"] * 20 + ["der hund und die katze"] * 20, ["en"] * 20 + ["de"] * 20)
    other = language_id.train(["der hund und die katze"] * 20 + ["the cat and the dog"] * 20, ["en"] * 20 + ["de"] * 20)
    same = language_id.train(["the cat and the dog"] * 20 + ["der hund und die katze"] * 20, ["en"] * 20 + ["de"] * 20)
    text = ["the cat", "der hund"]
    language_id._WORDS.clear()
    lang, score, _ = other.predict(text)
    assert lang == ["de", "en"] and one.predict(text)[0] == ["en", "de"]
    again, cached, _ = other.predict(text)
    assert again == lang and cached.tolist() == score.tolist()
    assert one.name != other.name and one.name == same.name


# Quality


def test_quality_held_out(spark):
    rows = QUERIES["op5_quality"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    known = [(r["predicted"], y[r["doc_id"]]) for r in rows if r["doc_id"] in y]
    assert np.mean([a == b for a, b in known]) > 0.97 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def plain_quality(model, texts):
    """The vote by single steps: shapes counted one by one, all cosines with float64 vectors, the nearest by sorting."""
    out = []
    for text in texts:
        dims = len(model.idf)
        words = [p for w in (text or "").split() for p in quality.pieces(w)]
        tf = np.zeros(dims)
        ids = [quality.shape_id(w) for w in words]
        for a in ids:
            tf[a % (dims - 32)] += 1
        for a, b in zip(ids, ids[1:]):
            tf[(b * 31 + a) * 2654435761 % (1 << 31) % (dims - 32)] += 1
        n = len(words)
        if not n:
            out.append(model.prior)
            continue
        pairs = list(zip(words, words[1:]))
        shares = (sum(a == b for a, b in pairs) / n, 1 - len(set(words)) / n, 1 - len(set(pairs)) / max(1, n - 1))
        for k, x in enumerate(shares):
            tf[dims - 32 + 8 * k + min(7, int(x * 8))] = n * (0.25 + x)
        x = np.sqrt(tf / n) * model.idf
        z = (x / np.linalg.norm(x)) @ model.basis
        cosine = model.vectors.astype(np.float64) @ (z / np.linalg.norm(z))
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: model.neighbours]
        vote = [np.exp(20 * (cosine[k] - cosine[near[0]])) * model.weights[model.labels[k]] for k in near]
        out.append(sum(v for v, k in zip(vote, near) if model.labels[k] == 1) / sum(vote))
    return out


def test_quality_equals_plain_steps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), usable=~common.held_out("doc_id"))
    got = {r["doc_id"]: r for r in QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()}
    rows = docs.where("doc_id % 4 = 1").collect()
    want = plain_quality(model, [r["text"] for r in rows])
    # Ties of the last neighbour may be broken either way, in single precision.
    off = [abs(got[r["doc_id"]]["score"] - w) for r, w in zip(rows, want)]
    assert np.mean([x < 1e-3 for x in off]) >= 0.99 and all(got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7) for r in rows)


def test_quality_odd_rows(spark, odd):
    model = quality.train(["A fine calm text. It goes on and on here."] * 10 + ["BUY!! NOW!! BUY!! NOW!!"] * 10, [1] * 10 + [0] * 10)
    got = quality.score_quality(odd, model).collect()
    assert len(got) == len(ODD)
    want = plain_quality(model, [t for _, t in ODD])
    assert sorted(((r["doc_id"], round(r["score"], 3)) for r in got), key=repr) == sorted(((i, round(w, 3)) for (i, _), w in zip(ODD, want)), key=repr)
    assert all(r["score"] == 0.5 for r in got if r["doc_id"] in (1, 2, 3))  # no term: the share of label 1
    assert quality.score_quality(odd.limit(0), model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    labels = spark.createDataFrame([(4, None), (5, 7)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(odd, quality.fit(odd, labels)).collect()} == {1.0}


def test_quality_scores_all_of_a_text_without_spaces():
    prose, spam = "我们今天去看了一本书，觉得它很好。" * 200, "￥99！@@#买%买￥1！！" * 200
    model = quality.train([prose] * 10 + [spam] * 10, [1] * 10 + [0] * 10)
    start = prose[:300]
    good, bad = model.score([start + prose, start + spam])
    assert good > 0.7 > bad
    for w in (prose, spam, "aB3+/x-9Zk" * 500, "กัขิคุ" * 300, "https://a.b/c?d=" * 90, "(" * 90 + "aB1cD2" * 50, "A1" * 41):
        cut = quality.pieces(w)
        assert "".join(cut) == w and len(cut) > 1 and max(len(quality.shape(p)) for p in cut) <= quality.SYMBOLS
    for w in ("x" * 70000, "!" * 50, "Well-known.", "a.b" * 13):
        assert quality.pieces(w) == [w]


# Encoding


def reference(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_bpe_equals_library(spark, odd):
    tok = reference(BYTE)
    want = []
    for i, t in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(odd, BYTE).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.digests(odd.limit(0), BYTE).count() == 0


def test_bpe_on_table(spark):
    tok, docs = reference(BYTE), texts(spark)
    got = {r["doc_id"]: r["ids"] for r in bpe.ids_of(spark.read.parquet(f"{SF}/documents.parquet"), BYTE, leaf=256, spread=2048).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in docs.items()}


def test_tree_joins_agree_with_library():
    tok, rng = reference(BYTE), random.Random(5)
    parts = ["a", "b", " ", "\n", "'s", "é", "日", "1", "!", "   ", "<|endoftext|>", "the", "tion", "😀", "\u0301"]
    for k in range(300):
        alphabet = parts if k % 3 else rng.choice([["a", "b"], ["t", "h", "e", "i", "n"], [" "], ["1", "2"], ["!", "?", "'"], ["é", "日"]])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 1500)))
        assert bpe.encode_text(BYTE, t, rng.choice([40, 100, 333])).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_word_pieces_equal_library():
    tok, rng = reference(WORD), random.Random(6)
    enc = pieces.PieceEncoder(WORD, "word")
    parts = ["a", "B", " ", "\n", "'s", "É", "日", "1", "!", "İ", "<|endoftext|>", "the", "Σ", "´", "ẞ"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


# Lines


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(line_dedup.LOWER)
    last = (1 << 63) - 1
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark, odd):
    for more in ({}, dict(shards=1, probes_per_lane=1), dict(shards=3, probes_per_lane=2)):
        assert sorted((tuple(r) for r in line_dedup.line_report(odd, **more).collect()), key=repr) == brute_lines(ODD)
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    five = out.where("doc_id = 5").first()
    assert five["text"] == "Another one, all new" and five["n_chars"] == 20
    assert line_dedup.line_report(odd.limit(0)).count() == 0


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 5000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
        assert sorted(line_dedup.mphf_slots(line_dedup.build_mphf(keys), keys)) == list(range(n))
    h = np.array([5, 5, 9, 11], dtype=np.uint64)
    shard = line_dedup.Shard(**line_dedup.build_shard(h, np.array([1, 2, 3, 6]), np.array([2, 4, 3, 1]), np.array([7, 8, 9, 4])))
    count, first = shard.probe(np.array([5, 5, 9, 9, 11, 12]), np.array([1, 2, 3, 4, 6, 7]))
    assert count.tolist() == [2, 4, 3, 0, 1, 0] and first.tolist() == [7, 8, 9, -1, -1, -1]
    wide = line_dedup.Shard(**line_dedup.build_shard(h[2:], np.array([3, 6]), np.array([1 << 40, 1]), np.array([9, 4])))
    assert wide.probe(np.array([9, 11]), np.array([3, 6]))[0].tolist() == [1 << 40, 1]


def test_line_decisions_come_from_the_count_array(spark, odd, monkeypatch):
    build = line_dedup.build_shard
    monkeypatch.setattr(line_dedup, "build_shard", lambda h1, h2, counts, firsts: build(h1, h2, np.ones_like(counts), firsts))
    assert all(r["n_dropped"] == 0 for r in line_dedup.line_report(odd).collect())


def test_bloom_filter_holds_all_its_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 1 << 12)
    ids = spark.range(0, 30000, 3)
    bits = common.bloom_of(ids, "id")

    class Shared:
        value = bits

    assert common.may_hold(Shared, np.arange(0, 30000, 3)).all() and common.may_hold(Shared, np.arange(1, 30000, 3)).mean() < 0.01
    few = common.bloom_of(ids, "id", most=1 << 12)
    assert len(few) == 512


def test_line_filter_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "one long line here", 1, 2, 3), (2, "one long line here\nx", 1, 2, 3)], "doc_id long, text string, doc int, `drop` int, `a.b` int")
    out = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(df).collect()}
    assert out[2]["text"] == "x" and out[1]["text"] == "one long line here" and list(out[1].asDict()) == df.columns


# Chat


TURNS = [
    (1, 0, "system", "s"), (1, 2, "user", "u2"), (1, 1, "user", "u1 <|end|> \\ [INST] <s>"), (1, 3, "assistant", "a <|text|>\\|"), (1, 4, "assistant", None), (1, 5, "assistant", "b\n</s>"),
    (2, 0, None, None), (2, None, "user", "<"), (3, 0, "assistant", "|><|"), (3, 0, "assistant", "|><|"), (4, 1, "we<|role|>ird\\", "x" * 50000), (None, 0, "user", "n"), (5, 0, "user", "only"),
]


def test_chat_round_trip(spark):
    t = spark.createDataFrame([(*r, 1, "x") for r in TURNS], "conv_id long, turn long, role string, text string, turns int, blocks string")
    out = chat.format_chats(t)
    back = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    conv = defaultdict(list)
    for c, turn, role, text in TURNS:
        conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, rows in conv.items():
        rows.sort()
        assert [(x["role"], x["text"]) for x in back[c]["t"]] == [(r[2], r[3]) for r in rows]
        assert back[c]["loss"] == "".join(r[3] for r in rows if r[2] == "assistant")
        assert not re.search(r"</?s>|\[/?INST\]", back[c]["formatted"])
    assert back[1]["formatted"].count("<|role|>") == 3
    assert chat.format_chats(t.limit(0)).count() == 0
    assert {r["conv_id"]: r["n_turns"] for r in chat.digest(out).collect()} == {c: len(v) for c, v in conv.items()}


# Near duplicates


def shingle_bag(t):
    w = re.findall(r"\w+", (t or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    bags = [(i, shingle_bag(t)) for i, t in rows]
    root = {i: i for i, _ in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            inter = sum((a & b).values())
            if inter and inter >= 0.8 * (sum(a.values()) + sum(b.values()) - inter) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def near_copies(n=240, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for base in range(n // 8):
        text = [rng.choice(words) for _ in range(rng.choice([3, 30, 200, 600]))]
        for c in range(8):
            t = list(text)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((base * 8 + c, " ".join(t)))
    rng.shuffle(rows)
    return rows


def test_near_classes_equal_brute_force(spark):
    rows = near_copies()
    want = brute_classes(rows)
    for block in (384, 3):
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
        assert got == want


def test_near_classes_on_table(spark):
    docs = texts(spark)
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op6_minhash_dedup"](spark, SF).collect()}
    assert got == brute_classes(sorted(docs.items()))


def test_near_odd_rows(spark, odd):
    out = minhash.near_classes(odd).collect()
    assert len(out) == len(ODD)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in out if r["doc_id"] is not None}
    assert got[1] == (1, True) and got[6] == (6, True) and got[7] == (6, False) and got[8][0] == 8 and got[15] == (15, True)
    kept = minhash.keep_first_of_class(odd)
    assert kept.columns == odd.columns and 7 not in {r["doc_id"] for r in kept.collect()}
    assert minhash.near_classes(odd.limit(0)).count() == 0


def brute_rows(rows, similarity=0.8):
    """(id, least id of the class, rows of the class) by row, comparing the texts of all rows."""
    bags = [shingle_bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(bags):
        for m, b in enumerate(bags[:n]):
            inter = sum((a & b).values())
            if inter and inter >= similarity * (sum(a.values()) + sum(b.values()) - inter) - 1e-9:
                root[find(n)] = find(m)
    groups = defaultdict(list)
    for n in range(len(rows)):
        groups[find(n)].append(n)
    least = {g: min((rows[n][0] is None, rows[n][0] or 0) for n in own) for g, own in groups.items()}
    return [(rows[n][0], None if least[find(n)][0] else least[find(n)][1], len(groups[find(n)])) for n in range(len(rows))]


def words_of(start, n=60):
    return " ".join(f"w{k}" for k in range(start, start + n))


NULL_AND_REPEATED = [
    (1, words_of(0)), (None, words_of(1000)), (None, words_of(0) + " x"), (4, words_of(1000) + " q"),  # null ids with two texts
    (7, words_of(2000)), (7, words_of(3000)), (8, words_of(2000) + " x"), (9, words_of(3000) + " x"),  # one id, two texts
    (None, words_of(4000)), (None, words_of(4000) + " y"),  # a class without ids
    (20, words_of(5000)), (20, words_of(5000)), (21, words_of(5000)),  # repeated rows
    (30, words_of(6000)), (30, words_of(6000) + " z"),  # near-copies under one id
    (40, None), (40, None), (41, ""), (None, "!!!"), (None, None),
]


def test_near_rows_with_null_and_repeated_ids(spark):
    names = "doc_id long, text string, doc int, x1 int, `a.b` int, again int, _again int, rep int, __gone int"
    df = spark.createDataFrame([(*r, 1, 2, k, 4, 5, 6, 7) for k, r in enumerate(NULL_AND_REPEATED)], names)
    want = brute_rows(NULL_AND_REPEATED)
    for block in (384, 1):
        out = minhash.near_classes(df, block=block).collect()
        assert sorted(((r["doc_id"], r["class_id"]) for r in out), key=repr) == sorted(((i, c) for i, c, _ in want), key=repr)
        # One row of each class stays: classes count by their shares.
        assert sum(r["kept"] for r in out) == round(sum(1 / n for _, _, n in want))
        kept = minhash.keep_first_of_class(df, block=block)
        assert kept.columns == df.columns
        rows = kept.collect()
        assert len(rows) == sum(r["kept"] for r in out)
        assert sorted((r["doc_id"] for r in out if r["kept"]), key=repr) == sorted((r["doc_id"] for r in rows), key=repr)
        at = [r["a.b"] for r in rows]
        assert len(set(at)) == len(at) and {0, 4, 5} <= set(at) and len({10, 11} & set(at)) == 1 and {15, 16, 17, 18, 19} <= set(at)


def test_large_groups_are_compared_in_lanes_and_blocks(spark):
    rng = random.Random(9)
    rows, words = [], [f"v{k}" for k in range(900)]
    base = [rng.choice(words) for _ in range(300)]
    for k in range(90):  # copies of one text, of which some drift away from it in steps
        t = list(base)
        for j in range(k // 30 * 12 + rng.randint(0, 3)):
            t[(j * 7) % len(t)] = f"n{k // 30}-{j}"
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(df, block=8).collect()}
    assert got == {i: c for i, c, _ in brute_rows(rows)}


def test_main_class_of_masks():
    import pyarrow as pa

    t = pa.table({"grp": pa.array([3] * 5, pa.int64()), "mask": pa.array([0, 1, 3, 6, 8], pa.int32()), "n": pa.array([4, 2, 2, 1, 3], pa.int64())})
    out = minhash.main_class(t).to_pydict()
    assert out["tied"] == [False, True, True, True, False] and set(out["s"]) == {5} and set(out["r"]) == {7}


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    a, b = rng.integers(1, 9, 60).astype(float), rng.integers(1, 9, 60).astype(float)
    k = 4000
    same = (minhash.signature(items, a, k) == minhash.signature(items, b, k)).mean()
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    scaled = (minhash.signature(items, a, k) == minhash.signature(items, a + 0.5, k)).mean()
    assert abs(scaled - a.sum() / (a + 0.5).sum()) < 0.03


# URLs


def test_urls_odd_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?y#z"), (4, "https://example.org"), (5, "http://org/"), (6, "http://x.com/de/"), (6, "http://x.com/de/"), (7, "http://xorg/"), (8, "x://a.com/fr/" + "p" * 50000), (None, "http://example.org/en/12")]
    pages = spark.createDataFrame([(*r, "k", "b") for r in rows], "page_id long, url string, key string, block string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()), key=repr)
    want = [(1, "", None, "allow"), (2, "", None, "allow"), (3, "a.example.org", "example.org/es/", "block"), (4, "example.org", None, "allow"), (5, "org", "org/", "allow"), (6, "x.com", "com/de/", "block"), (6, "x.com", "com/de/", "block"), (7, "xorg", None, "allow"), (8, "a.com", "com/fr/", "allow"), (None, "example.org", "example.org/en/1", "allow")]
    assert got == sorted(want, key=repr)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    wide = urls.judge_urls(pages, rules, broadcast_keys=0)
    assert sorted(((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in wide.collect()), key=repr) == got


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    listed = "allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/"
    verdicts = {rule: verdict for verdict, rule in (x.split(" ") for x in listed.split(", "))}
    rows = [(i, f"http://www.{rule}2.html") for i, rule in enumerate(verdicts)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["rule"]: r["verdict"] for r in QUERIES["op7_url_filter"](spark, str(tmp_path)).collect()}
    assert got == verdicts


# Exact copies


def brute_copies(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr)


def test_copies_equal_brute_force(spark, odd):
    for more in ({}, dict(block=7), dict(block=64, hash_bits=3)):
        out = exact_dedup.exact_duplicates(odd, **more).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=repr) == brute_copies(ODD)
        assert sum(r["kept"] for r in out) == len({r["text_sha256"] for r in out})
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0


def test_block_names_depend_on_texts_alone(spark, odd):
    def identities(df, partitions, **more):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            return sorted(((r["text_sha256"], r["n_blocks"], r["name"]) for r in exact_dedup.block_identities(df, **more).collect()), key=repr)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    for more in (dict(block=7), dict(block=64, hash_bits=3)):
        assert identities(odd, 4, **more) == identities(odd.orderBy(F.desc("text")).repartition(3), 7, **more)


# Embeddings


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for g in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((k, (base + rng.normal(size=16) * 0.12).astype(float).tolist(), int(g % 3)))
            k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 0), (k + 2, rows[0][1], 1), (k + 3, None, 1), (k + 4, [0.0] * 16, 1), (k + 5, [float("nan")] * 16, 1), (k + 6, rows[1][1], None), (k + 7, [1.0, 2.0], 1), (k + 8, [2.0, 4.0], 1), (k + 9, [], 1), (k + 10, [None] * 16, 1), (None, rows[3][1], rows[3][2])]
    good = [(i, np.array(x, dtype=float), y) for i, x, y in rows if x and y is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    links = defaultdict(set)
    for n, (i, x, y) in enumerate(good):
        for m, (j, z, w) in enumerate(good):
            if n != m and y == w and len(x) == len(z) and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= 0.93:
                links[i].add(j)
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, cell string")
    for block in (1024, 2):
        out = {r["vec_id"]: r for r in embedding_dedup.link_vectors(df, block=block).collect()}
        assert len(out) == len(rows)
        found = sum(r["n_links"] for r in out.values())
        assert found >= 0.99 * sum(map(len, links.values()))
        assert all(r["n_links"] <= len(links[i]) for i, r in out.items())
        assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in (k + 3, k + 4, k + 5, k + 6, k + 9, k + 10))
        assert out[k]["component_id"] == out[0]["component_id"] == 0 and out[k + 8]["component_id"] == k + 7
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def test_vectors_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=32), rng.normal(size=32)
    near = lambda x: (x + rng.normal(size=32) * 0.02).tolist()
    rows = [(None, a.tolist(), 0), (None, b.tolist(), 0), (3, near(a), 0), (4, near(b), 0), (5, rng.normal(size=32).tolist(), 0), (5, near(a), 0)]
    out = embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr)
    assert got == sorted([(None, 2, 3), (None, 1, 4), (3, 2, 3), (4, 1, 4), (5, 0, 5), (5, 2, 3)], key=repr)


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    words = np.concatenate((embedding_dedup.sketches(a), embedding_dedup.sketches(b)))
    cell, rep, home = np.tile(np.arange(4000), 2), np.arange(8000), np.arange(8000) < 4000
    assert embedding_dedup.likely(cell, rep, home, None, words).all()
    assert not embedding_dedup.likely(cell, rep, np.zeros(8000, dtype=bool), None, words).any()
    other = np.concatenate((words[:4000], np.roll(words[4000:], 1, axis=0)))
    assert embedding_dedup.likely(cell, rep, home, None, other).mean() < 0.001
    one = np.zeros(6, dtype=np.int64)
    block = np.array([0, 0, 0, 1, 1, 1])
    same = np.repeat(words[:2], 3, axis=0)
    assert embedding_dedup.likely(one, np.arange(6), np.ones(6, dtype=bool), None, same).all()
    assert not embedding_dedup.likely(one, np.arange(6), np.ones(6, dtype=bool), block, same).any()


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(2000, 64)))
    n = rng.normal(size=a.shape)
    n = unit(n - (n * a).sum(1, keepdims=True) * a)
    b, zero = 0.93 * a + np.sqrt(1 - 0.93**2) * n, np.zeros(2000, dtype=np.int64)
    assert (embedding_dedup.matching(embedding_dedup.cells(a, zero), embedding_dedup.cells(b, zero)) != 0).mean() > 0.99


def test_e8_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    p = embedding_dedup.nearest_e8(x)
    two = np.round(2 * p).astype(int)
    assert np.allclose(two, 2 * p) and ((two % 2 == two[:, :1] % 2).all()) and (p.sum(axis=1) % 2 == 0).all()
    best = ((x[:, None] - (p[:, None] + embedding_dedup.NEAR[None])) ** 2).sum(axis=2).min(axis=1)
    assert (((x - p) ** 2).sum(axis=1) <= best + 1e-9).all() and (((x - p) ** 2).sum(axis=1) <= 1 + 1e-9).all()


# Packing


def check_pieces(rows, got, length):
    tok = reference(WORD)
    want = Counter((i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes())) for i, t in rows)
    docs = defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at and n > 0
            at += n
        assert at <= length
    assert Counter(i for i, _ in want.elements()) == Counter(r["doc_id"] for r in got if r["start"] == 0)
    sizes = sorted(sum(n for _, n in s) for s in seqs.values())
    assert sizes[1:] == [length] * (len(sizes) - 1) or sizes[0] <= length and all(x == length for x in sizes[1:])
    return want, docs


def test_packing_holds_every_token_once(spark, odd):
    for length in (2048, 64):
        got = packing.pieces(odd, WORD, length, with_ids=True).collect()
        _, docs = check_pieces(ODD, got, length)
        tok = reference(WORD)
        for i, t in ODD:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
            if sum(j == i for j, _ in ODD) == 1:
                mine = sorted(docs[i], key=lambda r: r["start"])
                assert sum((r["ids"] for r in mine), []) == ids and all(r["doc_tokens"] == len(ids) for r in mine)
                assert [r["ids_crc32"] for r in mine] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for r in mine]
    assert packing.pieces(odd.limit(0), WORD).count() == 0


def test_registered_encoding_and_packing_equal_the_library(spark):
    docs = texts(spark)
    tok = reference(BYTE)
    got = {r["doc_id"]: tuple(r)[1:4] for r in QUERIES["op2_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(docs)
    for i, t in docs.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    pieces_ = QUERIES["op10_packing"](spark, SF).collect()
    whole, by = check_pieces(list(docs.items()), pieces_, 2048)
    for i, t in docs.items():
        check_tokens(t, by[i])
    assert sum(whole.values()) == len(docs) == len(by)


def check_tokens(text, mine):
    """The pieces of one row hold the library's ids of the text and the end, each once."""
    ids = reference(WORD).encode(text or "", add_special_tokens=False).ids + [1]
    mine = sorted(mine, key=lambda r: r["start"])
    assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine[:-1]]]).tolist() and sum(r["length"] for r in mine) == len(ids)
    assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for r in mine)


def test_sequences_are_padded(spark, odd):
    seqs = packing.sequences(odd, WORD, 64).collect()
    assert all(len(r["ids"]) == 64 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in seqs)


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, "/root/testdata/sf0.01")
        assert out.columns == docs.columns
        assert 0 < out.count() <= n


def test_pipeline_runs(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "lines", "near_duplicates", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def kept_by_pipeline(rows, score, rejected):
    """The first four stages one after the other, in plain Python, over (id, text) rows."""
    rows = [r for r, s in zip(rows, score([t or "" for _, t in rows])) if s >= 0.7]
    rows = [r for r, bad in zip(rows, rejected([t for _, t in rows])) if not bad]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(line_dedup.LOWER)
    last = (1 << 63) - 1
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(last if i is None else i)
    own = lambda i, line: len(held.get(key(line), ())) < 2 or min(held[key(line)]) == (last if i is None else i)
    rows = [(i, "\n".join(line for line in t.split("\n") if own(i, line))) for i, t in rows]
    first = {}
    for n, (i, c, size) in enumerate(brute_rows(rows)):
        if size == 1:
            first[("row", n)] = rows[n]
        elif i == c:
            first.setdefault((c, frozenset(shingle_bag(rows[n][1]).items()) if c is None else None), rows[n])
    return list(first.values())


def test_pipeline_equals_plain_composition(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    usable = ~common.held_out("doc_id")
    q = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), usable=usable)
    good = [r for r in docs.collect() if q.score([r["text"] or ""])[0] >= 0.7]
    lang = language_id.fit(spark.createDataFrame(good, docs.schema), usable=usable)
    want = kept_by_pipeline([(r["doc_id"], r["text"]) for r in docs.collect()], q.score, lambda t: lang.predict(t)[2])
    by = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        by[r["doc_id"]].append(r)
    assert set(by) == {i for i, _ in want} and len(want) > 50
    for i, t in want:
        check_tokens(t, by[i])


def test_pipeline_of_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    fine = [(100 + k, f"The {w} cat sat on the mat and looked at the {w} dog, which slept all day long.", "en", "s", 80, "b", 1, 2) for k, w in enumerate("red blue green grey black white brown small large round".split())]
    for name, rows in (("odd", odd.unionByName(spark.createDataFrame(fine, odd.schema))), ("empty", odd.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1) for i in range(1, 111)], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {r["doc_id"] for r in got}
    assert ids and ids <= {i for i, _ in ODD} | {r[0] for r in fine} and ids.isdisjoint({1, 2, 3, 12})
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd")
        assert docs.columns == odd.columns
