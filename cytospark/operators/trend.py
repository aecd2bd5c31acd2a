"""Trends over bins: Gaussian kernel smoothing, monotonic channels, Spearman's rank correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Bandwidths beyond which a weight (under 1e-14) counts as nothing.
REACH = 8


def kernel_weighted(at: np.ndarray, value: np.ndarray, bandwidth: float) -> np.ndarray:
    """Means weighted by exp(-((i - j) / bw)^2 / 2) over positions at (ascending), without those out of reach."""
    start, end = np.searchsorted(at, at - REACH * bandwidth), np.searchsorted(at, at + REACH * bandwidth, "right")
    out = np.empty(len(at))
    for i, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        w = np.exp(-0.5 * ((at[s:e] - at[i]) / bandwidth) ** 2)
        out[i] = (value[s:e] * w).sum() / w.sum()
    return out


def kernel_smooth(bins: DataFrame, value: str = "median", bandwidth: float = 50.0, *by: str) -> DataFrame:
    """by, bin, smooth: Gaussian kernel over a file's bins, in one pass; work grows with bins times bandwidth."""
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("bin").to_numpy())
        t = t.take(pa.array(order))
        smooth = kernel_weighted(t.column("bin").to_numpy().astype(float), t.column(value).to_numpy().astype(float), bandwidth)
        return t.select([*by, "bin"]).append_column("smooth", pa.array(smooth))

    ship(bins.sparkSession)
    types = dict(bins.dtypes)
    return bins.select(*by, "bin", value).groupBy(*by).applyInArrow(run, "".join(f"`{k}` {types[k]}, " for k in by) + f"bin {types['bin']}, smooth double")


def monotonic(smooth: DataFrame, threshold: float = 0.75, *by: str) -> DataFrame:
    """by, rising and falling bins, trend: increasing if more than threshold of the points equal the running maximum,
    else decreasing by the running minimum, else none."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    up = F.abs(F.max("smooth").over(w) - F.col("smooth")) < 1e-10
    down = F.abs(F.min("smooth").over(w) - F.col("smooth")) < 1e-10
    x = smooth.select(*by, up.alias("up"), down.alias("down"))
    n = F.count(F.lit(1))
    trend = F.when(F.count_if("up") > threshold * n, "increasing").when(F.count_if("down") > threshold * n, "decreasing").otherwise("none")
    return x.groupBy(*by).agg(F.count_if("up").alias("rising"), F.count_if("down").alias("falling"), n.alias("n"), trend.alias("trend"))


def average_rank(df: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2)


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) with average ranks."""
    x = average_rank(average_rank(df, a, "ra_", *by), b, "rb_", *by)
    n = F.count(F.lit(1))
    return x.groupBy(*by).agg((1 - 6 * F.sum(F.pow(F.col("ra_") - F.col("rb_"), 2)) / (n * (n * n - 1))).alias("rho"))
