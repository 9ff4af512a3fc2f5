"""Score to probability: 20 bins, weighted by their neighbours, smoothed to 101 keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, SMOOTH, FEWEST = 20, 15, 3


def bin_of(score: Column) -> Column:
    """Right-closed bins of 0.05; 0 falls in the first."""
    return F.when((score >= 0) & (score <= 1), F.greatest(F.ceil(F.round(score * BINS, 9)) - 1, F.lit(0))).cast("int")


def bins(df: DataFrame, score: Column, target: Column) -> DataFrame:
    """bin, n, mean of the target: at most 20 rows."""
    return df.select(bin_of(score).alias("bin"), target.cast("double").alias("y")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))


def smoothed(rows: list[tuple[int, int, float]]) -> list[float]:
    """Probability for each key 0..100 from (bin, n, mean)."""
    n, mean = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for b, c, m in rows:
        n[b + 1], mean[b + 1] = c, m
    around = n[:-2] + n[1:-1] + n[2:]
    mass = (n * mean)[:-2] + (n * mean)[1:-1] + (n * mean)[2:]
    weighted = np.divide(mass, around, out=np.zeros(BINS), where=around > 0)
    keys = np.append(np.repeat(weighted, 100 // BINS), weighted[-1])
    half = SMOOTH // 2
    return [float(keys[max(0, k - half) : k + half + 1].mean()) for k in range(101)]


def probability(score: Column, table: list[float]) -> Column:
    key = F.least(F.greatest((score * 100).cast("int"), F.lit(0)), F.lit(100))
    return F.element_at(F.array(*[F.lit(p) for p in table]), key + 1)
