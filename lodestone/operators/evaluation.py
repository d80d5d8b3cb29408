"""Retrieval metrics, rule scoring, bootstrap, error causes and summaries over question, answer and score tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import fold_answer
from lodestone.functions.values import answer_number, answer_numbers

FULL_RECALL, DEFAULT_TOLERANCE, PARTIAL_TOLERANCE, COMPARE_WINDOW = 0.8, 0.05, 0.20, 60
#: Folded phrases that decline to answer.
REFUSALS = (
    "khong co du lieu", "khong du du lieu", "khong co thong tin", "khong du thong tin", "khong tim thay",
    "ngoai pham vi", "khong the tra loi", "khong co trong du lieu", "chua co du lieu", "khong co so lieu",
    "khong the cung cap", "khong co du thong tin",
)
#: Folded words that say which side is higher, or that a value fell.
UP, DOWN = r"\b(cao hon|dat hon|lon hon|nhieu hon)\b", r"\b(thap hon|giam|re hon|kem)\b"


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Hits among the first k over min(k, relevant); null without relevant items."""
    return F.try_divide(F.size(F.array_intersect(F.slice(ranked, 1, k), relevant)), F.least(F.size(relevant), F.lit(k)))


def reciprocal_rank(ranked: Column, relevant: Column) -> Column:
    first = F.array_min(F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull()))
    return F.when(F.size(relevant) > 0, F.coalesce(1.0 / first, F.lit(0.0)))


def ndcg_at(ranked: Column, relevant: Column, k: int) -> Column:
    gain = lambda p: F.lit(1.0) / (F.log(p + 1.0) / F.log(F.lit(2.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    got = total(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), gain(i + 1)).otherwise(0.0)))
    best = total(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(relevant), F.lit(k)), F.lit(1))), gain))
    return F.when(F.size(relevant) > 0, got / best)


def context_precision(verdicts: Column) -> Column:
    """Mean of precision@i over relevant positions; 0 without any."""
    upto = F.transform(verdicts, lambda v, i: F.when(v, F.size(F.filter(F.slice(verdicts, 1, i + 1), lambda x: x)) / (i + 1)))
    hits = F.filter(upto, lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(hits, F.lit(0.0), lambda s, x: s + x), F.size(hits)), F.lit(0.0))


def faithfulness(verdicts: Column, n: Column) -> Column:
    """Share of true verdicts of n statements: padded with false, cut at n; no statement gives NaN."""
    v = F.slice(F.concat(verdicts, F.array_repeat(F.lit(False), n)), F.lit(1), n)
    return F.coalesce(F.try_divide(F.size(F.filter(v, lambda x: x)).cast("double"), n), F.lit(float("nan")))


def retrieval_metrics(df: DataFrame, ranked: str = "ranked", relevant: str = "relevant") -> DataFrame:
    r, t = F.array_distinct(ranked), F.array_distinct(relevant)
    return df.withColumns({"recall_5": recall_at(r, t, 5), "recall_10": recall_at(r, t, 10), "mrr": reciprocal_rank(r, t), "ndcg_10": ndcg_at(r, t, 10)})


def ranked_metrics(hits: DataFrame, relevant: DataFrame, *by: str) -> DataFrame:
    """The same measures from rows: `hits` has the query's columns, rank and hit (whether the row is relevant), `relevant` the
    query's columns and n_rel. No list is built, so neither rankings nor relevant sets meet in one cell. A query without a hit
    has zeros; one without relevant items has nulls."""
    log2 = lambda c: F.log(c) / F.log(F.lit(2.0))
    at = lambda k: F.count_if(F.col("hit") & (F.col("rank") <= k))
    found = hits.groupBy(*by).agg(
        at(5).alias("h5"), at(10).alias("h10"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") & (F.col("rank") <= 10), 1.0 / log2(F.col("rank") + 1.0))).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(10)).cast("int")), F.lit(0.0), lambda t, i: t + 1.0 / log2(i + 1.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    some = F.col("n_rel") > 0
    return relevant.join(found, list(by), "left").select(
        *by, (zero("h5") / F.when(some, F.least(F.col("n_rel"), F.lit(5)))).alias("recall_5"), (zero("h10") / F.when(some, F.least(F.col("n_rel"), F.lit(10)))).alias("recall_10"),
        F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.when(some, F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg_10"),
    )


def run_summary(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")], F.count("*").alias("n"))


def recall_points(recall: Column, full: float = FULL_RECALL) -> Column:
    return F.when(recall >= full, 2).when(recall > 0, 1).otherwise(0)


def error_points(value: Column, truth: Column, tolerance: Column | float, partial: float | None = None) -> Column:
    """2 within the tolerance, 1 within twice of it (or `partial`, if larger), else 0; zero, missing or non-finite is 0."""
    tol = F.lit(tolerance) if isinstance(tolerance, float) else tolerance
    err = F.try_divide(F.abs(value - truth), F.abs(truth))
    wide = F.greatest(2 * tol, F.lit(partial)) if partial is not None else 2 * tol
    return F.when(F.isnan(value) | F.coalesce(err, F.lit(float("inf"))).isin(float("inf")), 0).when(err <= tol, 2).when(err <= wide, 1).otherwise(0)


def is_refusal(folded: Column) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in REFUSALS]), lambda p: F.contains(folded, p))


#: How answers write months (month and year, year-month) and amounts (one, or a range, with a unit).
MONTH_YEAR = r"(?<![\d/.-])(\d{1,2}\s*(?:/|-|\.|\s+nam\s+)\s*\d{4})(?!\d)"
YEAR_MONTH = r"(?<!\d)(\d{4}-\d{1,2})(?![\d-])"
AMOUNT = r"(\d+(?:[.,]\d+)*)(?:\s*(?:-|–|den|toi)\s*(\d+(?:[.,]\d+)*))?\s*(ty|trieu)\b"
#: Systems that use filters, and words by which an answer says that it lacks data.
FILTER_SYSTEMS = ("basic_rag", "hybrid")
NO_DATA = r"(?U)không (đủ|có) (dữ liệu|thông tin)|không tìm thấy"


def answer_months(folded: Column) -> Column:
    """All months in an answer as YYYY-MM."""
    a = F.transform(F.regexp_extract_all(folded, F.lit(MONTH_YEAR), 1), lambda x: F.concat(F.regexp_extract(x, r"(\d{4})$", 1), F.lit("-"), F.lpad(F.regexp_extract(x, r"^(\d{1,2})", 1), 2, "0")))
    b = F.transform(F.regexp_extract_all(folded, F.lit(YEAR_MONTH), 1), lambda x: F.concat(F.left(x, F.lit(4)), F.lit("-"), F.lpad(F.substring_index(x, "-", -1), 2, "0")))
    return F.filter(F.array_distinct(F.concat(a, b)), lambda m: F.right(m, F.lit(2)).between("01", "12"))


def forecast_bn(folded: Column) -> Column:
    """The first amount, or the middle of the first range, in billions."""
    low, high, unit = (F.regexp_extract(folded, AMOUNT, i) for i in (1, 2, 3))
    v = (answer_number(low) + F.when(high != "", answer_number(high)).otherwise(answer_number(low))) / 2
    return F.when(unit == "ty", v).when(unit == "trieu", v / 1000)


def score_answers(rows: DataFrame) -> DataFrame:
    """Adds points. Rows: answer, question, category, gt_kind, gt_value, value_tolerance, recall_5."""
    f = rows.withColumns({"__a": fold_answer(F.coalesce("answer", F.lit(""))), "__q": fold_answer(F.coalesce("question", F.lit(""))), "__t": fold_answer(F.coalesce("gt_value", F.lit("")))})
    truth = F.regexp_replace("gt_value", ",", "")
    number = F.when(truth.rlike(r"^-?\d+(\.\d+)?$"), truth).try_cast("double")
    tol = F.coalesce("value_tolerance", F.lit(DEFAULT_TOLERANCE))
    found = answer_numbers(F.col("__a"))
    signed = F.when((number < 0) & F.col("__a").rlike(DOWN), F.concat(found, F.transform(found, lambda n: -n))).otherwise(found)
    bands = F.transform(signed, lambda n: error_points(n, number, tol, PARTIAL_TOLERANCE))
    value = F.when(number == 0, F.when(F.exists(found, lambda n: n == 0), 2).otherwise(0)).otherwise(F.coalesce(F.array_max(bands), F.lit(0)))
    at = F.regexp_instr("__a", F.lit(UP))
    before = F.substring(F.col("__a"), F.greatest(at - COMPARE_WINDOW, F.lit(1)), F.least(at - 1, F.lit(COMPARE_WINDOW)))
    winner = (at > 0) & F.contains(before, F.col("__t"))
    compare = (F.col("category") == "comparison") | F.contains(F.col("__q"), F.col("__t"))
    words = F.when(F.col("__t") == "", 0).when(F.when(compare, winner).otherwise(F.contains(F.col("__a"), F.col("__t"))), 2).otherwise(0)
    is_month = F.coalesce(F.col("gt_value").rlike(r"^\d{4}-\d{1,2}$"), F.lit(False))
    month = F.when(F.array_contains(answer_months(F.col("__a")), F.concat(F.left("gt_value", F.lit(4)), F.lit("-"), F.lpad(F.substring_index("gt_value", "-", -1), 2, "0"))), 2).otherwise(0)
    points = (
        F.when(F.col("gt_kind") == "ids", recall_points(F.col("recall_5")))
        .when(F.col("__a") == "", 0)
        .when(F.col("gt_kind") == "refusal", F.when(is_refusal(F.col("__a")), 2).otherwise(0))
        .when(is_refusal(F.col("__a")), 0)
        .when(F.col("category") == "valuation", error_points(forecast_bn(F.col("__a")), number, F.coalesce("value_tolerance", F.lit(0.15))))
        .when(is_month, month).when(number.isNotNull(), value).otherwise(words)
    )
    return f.withColumn("points", points).drop("__a", "__q", "__t")


def error_cause(filters_wrong: Column | None = None, hallucination_below: float = 0.5) -> Column:
    """First rule that fits; null for full points or no score."""
    said, no_data = F.trim(F.coalesce("answer", F.lit(""))), F.lower("answer").rlike(NO_DATA)
    ids, missed = F.col("gt_kind") == "ids", F.coalesce(F.col("recall_5"), F.lit(0.0)) == 0
    return (
        F.when(F.col("points").isNull() | (F.col("points") == 2), None)
        .when(F.col("error").isNotNull() & (said == ""), "runtime_error")
        .when(F.col("category") == "unanswerable", "refusal_missing")
        .when((F.col("system") == "hybrid") & (F.col("route") != F.col("route_gold")), "router_wrong")
        .when(F.col("cypher").isNotNull() & F.col("error").isNotNull(), "cypher_error")
        .when(ids & (F.col("system") == "llm_only"), "insufficient_context")
        .when(ids & missed & F.col("system").isin(*FILTER_SYSTEMS) & (F.lit(False) if filters_wrong is None else filters_wrong), "filter_wrong")
        .when(ids, "retrieval_miss")
        .when(F.size("unsupported") > 0, "llm_hallucination")
        .when(no_data, "insufficient_context")
        .when(F.col("faithfulness") < hallucination_below, "llm_hallucination")
        .when(F.col("cypher").isNotNull(), "cypher_wrong_result")
        .otherwise("insufficient_context")
    )


def accuracy_grid(scores: DataFrame, systems: list[str], categories: list[str]) -> DataFrame:
    """system, category, n, accuracy, mean points, unscored; cells without rows have n 0 and nulls."""
    spark = scores.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.lit(c).alias("category")) for s in systems for c in categories])).alias("g")).select("g.*")
    agg = scores.groupBy("system", "category").agg(F.count("points").alias("n"), F.avg((F.col("points") == 2).cast("double")).alias("accuracy"), F.avg("points").alias("mean_points"), F.count_if(F.col("points").isNull()).alias("unscored"))
    return F.broadcast(grid).join(agg, ["system", "category"], "left").na.fill(0, ["n", "unscored"])


def confusion(df: DataFrame, gold: str, pred: str, values: list[str]) -> DataFrame:
    """Counts of gold by predicted, with zeros; a missing prediction is `none`."""
    rows = df.select(F.col(gold).alias("gold"), F.coalesce(pred, F.lit("none")).alias("p"))
    return rows.groupBy("gold").agg(*[F.count_if(F.col("p") == v).alias(v) for v in [*values, "none"]])


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc_nulls_last())
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def stratified(df: DataFrame, category: str, order: str, n: int) -> DataFrame:
    """First n of each category."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(category).orderBy(order))).where(F.col("__r") <= n).drop("__r")


def round_robin(df: DataFrame, category: str, order: str, total: int) -> DataFrame:
    """Rows taken in turn from each category until there are `total`."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(category).orderBy(order))).orderBy("__r", category).limit(total).drop("__r")


def examples(df: DataFrame, group: str, system: str, order: str, n: int = 3, last: str = "llm_only") -> DataFrame:
    """n rows per group: the first of each system before second ones, `last` behind the others."""
    one = df.withColumn("__s", F.row_number().over(Window.partitionBy(group, system).orderBy(order)))
    w = Window.partitionBy(group).orderBy("__s", F.col(system) == last, system, order)
    return one.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__s", "__r")


def bootstrap_mean(x: list[float], n_boot: int = 10_000, seed: int = 42) -> tuple[float, float] | None:
    """95 % interval of the mean of a small sample; None if empty, an error for non-finite values."""
    a = np.asarray(x, dtype=float)
    if not np.isfinite(a).all():
        raise ValueError("values must be finite")
    if not len(a):
        return None
    means = a[np.random.default_rng(seed).integers(0, len(a), (n_boot, len(a)))].mean(axis=1)
    return tuple(float(round(q, 4)) for q in np.quantile(means, [0.025, 0.975]))


def bootstrap_paired(a: list[float], b: list[float], n_boot: int = 10_000, seed: int = 42) -> dict | None:
    """Difference of means of paired samples, its interval, and the share of resamples of the other sign (or zero)."""
    if len(a) != len(b):
        raise ValueError("paired samples differ in length")
    d = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    if not len(d):
        return None
    means = d[np.random.default_rng(seed).integers(0, len(d), (n_boot, len(d)))].mean(axis=1)
    diff = float(d.mean())
    p = 1.0 if diff == 0 else float((means <= 0).mean() if diff > 0 else (means >= 0).mean())
    return {"diff": round(diff, 4), "ci95": bootstrap_mean(list(d), n_boot, seed), "p_value": round(p, 4), "n": len(d)}


def bootstrap_counts(df: DataFrame, value: str, n_boot: int, seed: int = 42) -> DataFrame:
    """boot, mean: resamples of all values that are not null, drawn from the counts of the distinct values.

    Rows are counted before they move, so only the distinct values (a label has few) reach the driver, which draws.
    """
    found = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).count().collect()
    pairs = sorted((r["v"], r["count"]) for r in found)
    v, c = np.array([x for x, _ in pairs]), np.array([n for _, n in pairs], dtype=np.int64)
    n = int(c.sum())
    means = np.random.default_rng(seed).multinomial(n, c / n, n_boot) @ v / n if n else []
    said = F.split(F.lit(",".join(repr(float(x)) for x in means)), ",")
    boots = df.sparkSession.range(n_boot).withColumnRenamed("id", "boot")
    return boots.select("boot", F.get(said, F.col("boot").cast("int")).try_cast("double").alias("mean"))


def rescore(answers: DataFrame, old: DataFrame, version: str) -> DataFrame:
    """Answers whose digest or rules version changed, or that were not scored or failed."""
    digest = F.sha2(F.to_json(F.struct("answer", "route")), 256)
    now = answers.withColumn("digest", digest)
    o = old.select("id", "system", F.col("digest").alias("__d"), F.col("rules_version").alias("__v"), F.col("judge_error").alias("__e"))
    changed = F.col("__d").isNull() | (F.col("__d") != F.col("digest")) | (F.col("__v") != version) | F.col("__e").isNotNull()
    return now.join(o, ["id", "system"], "left").where(changed).drop("__d", "__v", "__e")


def rule_query(df: DataFrame, rule: dict) -> DataFrame:
    """A small rule language: {filter, measure, op: count|mean|median|nunique, group, min_count, pick: min|max|top5} as a plan."""
    rows = df.where(rule["filter"]) if rule.get("filter") else df
    op = {"count": lambda c: F.count(c), "mean": F.avg, "median": F.median, "nunique": F.countDistinct}[rule["op"]](F.col(rule["measure"]))
    if not rule.get("group"):
        return rows.agg(op.alias("value"))
    out = rows.groupBy(F.col(rule["group"]).alias("key")).agg(op.alias("value"), F.count("*").alias("n")).where(F.col("n") >= rule.get("min_count", 1)).drop("n")
    pick = rule.get("pick")
    return out.orderBy(F.asc("value") if pick == "min" else F.desc("value"), "key").limit({"top5": 5, "min": 1, "max": 1}.get(pick, 1 << 30))
