"""Bootstrap over tables: every row is read once, and only sums of replicates move.

A row's weight in a replicate is a Poisson draw of mean 1 from a counter-based generator (id, replicate and seed are mixed into
64 bits), the limit of drawing rows with replacement. So weights depend on nothing but the row: not on partitions, order or
retries; and each task adds up its rows' weighted values for all replicates, a row for each replicate out. Rows of one id are
drawn together. Replicates that happen to draw no row (of tiny tables) are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The odd constants of a 64-bit mixing function, and the steps by which counters are spread.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEPS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)
#: Draws of 53 bits from which on a weight is 1, 2, 3 ...: the distribution function of the Poisson law of mean 1.
DRAWS = [int(sum(exp(-1) / factorial(i) for i in range(k + 1)) * 2**53) for k in range(12)]
#: Rows whose weights for all replicates are in memory at once.
ROWS = 1024


def weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """[rows, replicates] weights."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.int64).view(np.uint64) * np.uint64(STEPS[0]))[:, None] + (np.arange(replicates, dtype=np.uint64) * np.uint64(STEPS[1]))[None, :] + np.uint64(seed) * np.uint64(STEPS[2])
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
    draw = (z ^ (z >> np.uint64(31))) >> np.uint64(11)
    return np.searchsorted(np.array(DRAWS, dtype=np.uint64), draw.ravel(), side="right").reshape(draw.shape)


def replicate_sums(df: DataFrame, ident: str, values: list[str], replicates: int, seed: int) -> DataFrame:
    """boot, w (sum of weights) and the weighted sum of each value column, by replicate. Rows with a null are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + len(values), replicates))
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                w = weights(part.column("id").to_numpy(), replicates, seed).astype(np.float64)
                total[0] += w.sum(axis=0)
                for k, name in enumerate(values, 1):
                    total[k] += part.column(name).to_numpy() @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(t) for t in total]], names=["boot", "w", *values])

    rows = df.select(F.col(ident).cast("long").alias("id"), *[F.col(v).cast("double").alias(v) for v in values]).dropna()
    sums = rows.mapInArrow(run, ", ".join(["boot int, w double", *[f"{v} double" for v in values]]))
    return sums.groupBy("boot").agg(*[F.sum(c).alias(c) for c in ("w", *values)])


def paired_differences(df: DataFrame, ident: str, a: str, b: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """boot, diff: mean(a) - mean(b) of each replicate."""
    return replicate_sums(df, ident, [a, b], replicates, seed).where("w > 0").select("boot", ((F.col(a) - F.col(b)) / F.col("w")).alias("diff"))


def paired_test(df: DataFrame, ident: str, a: str, b: str, replicates: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: n, diff (mean of a minus mean of b over rows that have both), low and high of its interval, and p_value: the share
    of replicates of the other sign or zero (1 if the difference is 0). Values that are not finite are an error; no row: nulls."""
    finite = F.when(F.abs(a) + F.abs(b) < float("inf"), F.col(a) - F.col(b)).otherwise(F.raise_error(F.lit("values must be finite")).cast("double"))
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    whole = both.agg(F.count("*").alias("n"), F.avg(finite).alias("diff"))
    tail = (1 - level) / 2
    boots = paired_differences(both, ident, a, b, replicates, seed).join(F.broadcast(whole.select(F.col("diff").alias("all"))))
    other = F.when(F.col("all") > 0, F.col("diff") <= 0).when(F.col("all") < 0, F.col("diff") >= 0).otherwise(True)
    found = boots.agg(F.percentile("diff", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.avg(other.cast("double")).alias("p_value"))
    return whole.join(F.broadcast(found)).select("n", "diff", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_value")
