"""Price features and models: target encoding, baselines, error measures, PCA, boosted trees and single valuations."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.values import verdict
from lodestone.operators.market import narrow
from lodestone.session import materialize, release

#: Values of a group that are ordered in one aggregate. Of a larger group only the ranges of values that hold a rank asked for are.
AT_ONCE = 100_000


def time_split(month: Column, train_to: str, valid: str, test_from: str) -> dict[str, Column]:
    return {"is_train": month <= train_to, "is_valid": month == valid, "is_test": month >= test_from, "is_fit": (month <= train_to) & (month != valid)}


def smoothed_means(df: DataFrame, key: str, target: str, weight: float = 20.0) -> DataFrame:
    """key, encoded: (sum + weight * prior) / (n + weight); null keys are left out."""
    prior = df.agg(F.avg(target).alias("prior"))
    by = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    return by.join(F.broadcast(prior)).select(key, ((F.col("s") + weight * F.col("prior")) / (F.col("n") + weight)).alias("encoded"))


def target_encode_oof(df: DataFrame, key: str, target: str, fold: str, weight: float = 20.0) -> DataFrame:
    """Adds encoded: each fold's rows get means of the other folds only (total minus own fold: one aggregate, no loop)."""
    per = df.groupBy(key, fold).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    tot = per.groupBy(key).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    pf = df.groupBy(fold).agg(F.sum(target).alias("fs"), F.count(target).alias("fn"))
    pt = pf.agg(F.sum("fs").alias("as"), F.sum("fn").alias("an"))
    prior = pf.join(F.broadcast(pt)).select(fold, F.try_divide(F.col("as") - F.col("fs"), F.col("an") - F.col("fn")).alias("prior"))
    k = per.where(F.col(key).isNotNull()).join(tot, key).join(F.broadcast(prior), fold)
    enc = k.select(key, fold, ((F.col("ts") - F.col("s") + weight * F.col("prior")) / (F.col("tn") - F.col("n") + weight)).alias("__e"))
    out = df.join(enc, [key, fold], "left").join(F.broadcast(prior), fold, "left")
    return out.withColumn("encoded", F.coalesce("__e", "prior")).drop("__e", "prior")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], at_once: int = AT_ONCE) -> DataFrame:
    """keys, n (rows) and q (an array of the interpolated quantiles of the values that are not null), of every group; no keys: one
    group. A group of more than `at_once` values never meets in a task: its values are counted by ranges, and those of the
    few ranges that hold a rank asked for are counted one by one."""
    rows = df.select(*keys, (F.struct(*keys) if keys else F.lit(0)).alias("__k"), F.col(value).alias("__x"))
    sizes = materialize(rows.groupBy("__k").agg(F.count("*").alias("n"), F.count("__x").alias("__m")), "sizes")
    large = sizes.where(F.col("__m") > at_once)
    names = [F.col(f"__k.{k}").alias(k) for k in keys]
    few = rows.join(F.broadcast(large.select("__k")), "__k", "left_anti").groupBy("__k").agg(F.percentile("__x", F.array(*map(F.lit, qs))).alias("q"))
    if large.isEmpty():
        return few.join(sizes, "__k").select(*names, "n", "q")
    big = rows.where("__x IS NOT NULL").select("__k", "__x").join(F.broadcast(large.select("__k", "__m")), "__k").withColumn("__bin", narrow(F.col("__x")))
    place = [(F.col("__m") - 1) * F.lit(q) for q in qs]
    bins = materialize(big.groupBy("__k", "__m", "__bin").agg(F.count("*").alias("c")), "ranges")
    last = F.sum("c").over(Window.partitionBy("__k").orderBy("__bin"))
    held = lambda rank: (rank > F.col("before")) & (rank <= F.col("upto"))
    wanted = reduce(lambda a, b: a | b, [held(f(p) + 1) for p in place for f in (F.floor, F.ceil)])
    chosen = bins.withColumn("upto", last).withColumn("before", F.col("upto") - F.col("c")).where(wanted).select("__k", "__bin", F.col("before").alias("start"))
    values = big.join(F.broadcast(chosen), ["__k", "__bin"]).groupBy("__k", "__m", "__bin", "start", "__x").agg(F.count("*").alias("c"))
    upto = F.col("start") + F.sum("c").over(Window.partitionBy("__k", "__bin").orderBy("__x"))
    ranked = values.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    part = lambda p: F.sum(F.when(held(F.floor(p) + 1), F.col("__x") * (1 - (p - F.floor(p)))).otherwise(0.0) + F.when((p > F.floor(p)) & held(F.floor(p) + 2), F.col("__x") * (p - F.floor(p))).otherwise(0.0))
    many = ranked.groupBy("__k").agg(F.array(*map(part, place)).alias("q"))
    # Dealt out anew, as in search.hybrid().
    out = materialize(few.unionByName(many).repartition("__k").join(sizes, "__k").select(*names, "n", "q"), "quantiles")
    release(sizes, bins)
    return out


def level_medians(train: DataFrame, levels: list[list[str]], target: str, least: int = 5, at_once: int = AT_ONCE) -> list[DataFrame]:
    """For baseline(): the median and count of each level's groups with enough rows, and last the median of all rows."""
    known = [train.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))) for keys in levels]
    found = [exact_quantiles(rows, keys, target, [0.5], at_once).where(F.col("n") >= least).select(*keys, F.col("q")[0].alias(f"__m{i}"), F.col("n").alias(f"__n{i}")) for i, (rows, keys) in enumerate(zip(known, levels))]
    # One row, also without rows to learn from.
    return [*found, exact_quantiles(train, [], target, [0.5], at_once).agg(F.max(F.col("q")[0]).alias("__all"))]


def baseline(train: DataFrame, rows: DataFrame, levels: list[list[str]], target: str, least: int = 5, medians: list[DataFrame] | None = None) -> DataFrame:
    """Adds base and base_n: the median and count of the first level with enough rows; the global median has count 0. `medians`:
    those of level_medians(), where they serve several times."""
    *found, all_ = medians or level_medians(train, levels, target, least)
    out = rows
    for keys, med in zip(levels, found):
        out = out.join(med, keys, "left")
    out = out.join(F.broadcast(all_))
    n = range(len(levels))
    return out.withColumns({"base": F.coalesce(*[F.col(f"__m{i}") for i in n], F.col("__all")), "base_n": F.coalesce(*[F.col(f"__n{i}") for i in n], F.lit(0))}).drop("__all", *[f"__{x}{i}" for i in n for x in "mn"])


def error_measures(df: DataFrame, truth: str, pred: str, by: str | None = None) -> DataFrame:
    """MAE, MAPE and R2 (null without variance), by a group or over all, in one pass."""
    y, p = F.col(truth), F.col(pred)
    ss = F.sum((y - p) * (y - p))
    var = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    aggs = [F.count(y).alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.avg(F.try_divide(F.abs(y - p), F.abs(y))).alias("mape"), (1 - F.try_divide(ss, F.when(var > 1e-9, var))).alias("r2")]
    return (df.groupBy(by) if by else df.groupBy()).agg(*aggs)


def ratio_interval(df: DataFrame, truth: str, pred: str, kind: str, at_once: int = AT_ONCE) -> DataFrame:
    """p10 and p90 of truth/prediction by kind and over all (ALL)."""
    r = df.select(F.col(kind).alias("kind"), F.try_divide(truth, pred).alias("__r"))
    own, all_ = (exact_quantiles(r, keys, "__r", [0.1, 0.9], at_once) for keys in (["kind"], []))
    return own.unionByName(all_.agg(F.max("q").alias("q")).select(F.lit("ALL").alias("kind"), "q"), allowMissingColumns=True).select("kind", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"))


def one_hot(c: str, keys: list[str]) -> dict[str, Column]:
    return {f"has_{k}": F.array_contains(c, k).cast("tinyint") for k in keys}


def fit_pca(df: DataFrame, vector: str, k: int = 32):
    rows = df.select(array_to_vector(vector).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="pc").fit(rows)


def apply_pca(model, df: DataFrame, vector: str) -> DataFrame:
    return model.transform(df.withColumn("v", array_to_vector(vector))).withColumn("pca", vector_to_array("pc")).drop("v", "pc")


def fit_price_model(df: DataFrame, target: str, numeric: list[str], categorical: list[str], valid: str, configs: list[dict] | None = None) -> PipelineModel:
    """Boosted trees on the log of the target; each configuration stops early on the validation rows, the least error wins."""
    rows = df.withColumn("label", F.log(target)).na.fill(0.0, numeric)
    best = None
    for c in configs or [dict(maxDepth=5, maxIter=20), dict(maxDepth=6, maxIter=20, stepSize=0.15)]:
        index = [StringIndexer(inputCol=x, outputCol=f"{x}_ix", handleInvalid="keep") for x in categorical]
        vec = VectorAssembler(inputCols=numeric + [f"{x}_ix" for x in categorical], outputCol="features", handleInvalid="keep")
        model = Pipeline(stages=[*index, vec, GBTRegressor(seed=42, validationIndicatorCol=valid, maxBins=64, **c)]).fit(rows)
        err = RegressionEvaluator(metricName="rmse").evaluate(model.transform(rows.where(valid)))
        if best is None or err < best[0]:
            best = (err, model)
    return best[1]


def predict_price(model: PipelineModel, df: DataFrame, numeric: list[str]) -> DataFrame:
    return model.transform(df.na.fill(0.0, numeric)).withColumn("predicted", F.exp("prediction"))


def check_input(given: dict, known: set[str], required: set[str]) -> dict:
    if odd := set(given) - known:
        raise ValueError(f"unknown inputs: {sorted(odd)}")
    if missing := {k for k in required if given.get(k) is None}:
        raise ValueError(f"missing inputs: {sorted(missing)}")
    if not 0 < float(given["area_m2"]) <= 100_000:
        raise ValueError("area_m2 must be in (0, 100000]")
    return given


def valuate(rows: DataFrame, interval: DataFrame, kind: str, asking: str) -> DataFrame:
    """Adds low, high and the verdict on the asking price; `rows` has predicted, `interval` is ratio_interval()'s."""
    own = interval.where("kind <> 'ALL'").toDF(kind, "p10", "p90")
    all_ = interval.where("kind = 'ALL'").select(F.col("p10").alias("a10"), F.col("p90").alias("a90"))
    out = rows.join(own, kind, "left").join(F.broadcast(all_))
    low, high = F.col("predicted") * F.coalesce("p10", "a10"), F.col("predicted") * F.coalesce("p90", "a90")
    return out.withColumns({"low": low, "high": high, "verdict": verdict(F.col(asking), low, high)}).drop("p10", "p90", "a10", "a90")


def dealt(df: DataFrame, column: str, ident: list[str], buckets: int, seed: int) -> DataFrame:
    """A column's values dealt anew: in each of `buckets` random sets of rows, every row takes the value of the next one in a
    random order, and the last that of the first. No value is lost or comes twice, and no set is larger than it must be."""
    w = Window.partitionBy("__set").orderBy(F.xxhash64(F.lit(seed + 1), *ident), *ident)
    first = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.lead(F.lit(1)).over(w).isNull()
    rows = df.withColumn("__set", F.pmod(F.xxhash64(F.lit(seed), *ident), F.lit(buckets)))
    return rows.withColumns({"__next": F.lead(column).over(w), "__first": first, "__last": last}).withColumn(column, F.when(F.col("__last"), F.col("__first")).otherwise(F.col("__next"))).drop("__set", "__next", "__first", "__last")


def permutation_importance(model: PipelineModel, df: DataFrame, numeric: list[str], ident: list[str], label: str = "label", seed: int = 42, per_set: int = 20_000) -> dict[str, float]:
    """Growth of the error when a feature's values are dealt anew among rows; `ident` names the columns that order rows."""
    ev = RegressionEvaluator(metricName="rmse", labelCol=label)
    base = ev.evaluate(model.transform(df))
    buckets = max(1, -(-df.count() // per_set))
    out = {f: ev.evaluate(model.transform(dealt(df, f, ident, buckets, seed))) - base for f in numeric}
    return dict(sorted(out.items(), key=lambda kv: -kv[1]))
