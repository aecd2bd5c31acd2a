"""Outlying bins: isolation tree by gain in standard deviation, smoothed trajectories beyond MAD, margins, doublets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QcError
from ..session import beside, grouped, ship
from .stats import median_mad

EULER = 0.5772156649
MAD_SCALE = 1.4826


def average_path_length(n: Column) -> Column:
    """2 (ln(n - 1) + gamma) - 2 (n - 1) / n; 0 for one row or none, 1 for two."""
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.ln(n - 1) + F.lit(EULER)) - 2 * (n - 1) / n)


def best_split(values: np.ndarray, limit: float) -> tuple[float, float] | None:
    """(gain, split value) of the last cut whose gain reaches the limit and every earlier one; sample deviations."""
    v = np.sort(values)
    n = len(v)
    if n < 2 or not (base := v.std(ddof=1)):
        return None
    v0 = v - v.mean()  # prefix sums of centred values keep their digits
    k = np.arange(1, n)
    s, q = np.cumsum(v0)[:-1], np.cumsum(v0 * v0)[:-1]
    ts, tq = v0.sum(), (v0 * v0).sum()
    var = lambda s, q, m: np.where(m > 1, np.maximum(q - s * s / np.maximum(m, 1), 0) / np.maximum(m - 1, 1), 0.0)
    gain = (base - (np.sqrt(var(s, q, k)) + np.sqrt(var(ts - s, tq - q, n - k))) / 2) / base
    top = gain.max()
    if not top >= limit:
        return None
    return float(top), float(v[np.flatnonzero(gain >= top)[-1]])


def isolation_tree(x: np.ndarray, limit: float = 0.6) -> np.ndarray:
    """Which rows are in the largest leaf (the last on ties). Each accepted gain is the limit of all later splits."""
    n = len(x)
    depth_limit = math.ceil(math.log2(max(n, 2)))
    stack, leaves, number = [(np.arange(n), 0, 0)], [], 1
    while stack:
        rows, depth, ident = stack.pop()
        found = None
        if len(rows) > 3 and depth < depth_limit:
            splits = [(c, s) for c in range(x.shape[1]) if (s := best_split(x[rows, c], limit))]
            if splits:
                found = max(enumerate(splits), key=lambda e: (e[1][1][0], e[0]))[1]
        left = x[rows, found[0]] <= found[1][1] if found else None
        if found is None or left.all() or not left.any():
            leaves.append((len(rows), ident, rows))
            continue
        limit = found[1][0]
        stack += [(rows[left], depth + 1, number), (rows[~left], depth + 1, number + 1)]
        number += 2
    best = max(leaves, key=lambda leaf: leaf[:2])[2]
    out = np.zeros(n, bool)
    out[best] = True
    return out


def smoothing_spline(y: np.ndarray, spar: float = 0.5, x: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Cubic smoothing spline that minimises p sum w (y - f)^2 + (1 - p) integral f''^2, p = 1 - spar in [0, 1], at x
    (1..n unless given, in any order). Equal x are one point: their mean, weighing as much as all of them; under three
    points nothing is smoothed."""
    if x is None:
        if weights is None:
            return _spline(np.asarray(y, float), spar)
        x = np.arange(len(y), dtype=float)
    y, x = np.asarray(y, float), np.asarray(x, float)
    if len(x) != len(y):
        raise QcError(f"{len(x)} places for {len(y)} values")
    w = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    order = np.argsort(x, kind="stable")
    new = np.append(True, np.diff(x[order]) >= 1e-10)
    point = np.cumsum(new) - 1
    total = np.bincount(point, w[order])
    mean = np.bincount(point, (w * y)[order]) / total
    if len(total) < 3:
        return y.copy()
    out = np.empty(len(y))
    out[order] = _spline(mean, spar, np.diff(x[order][new]), total)[point]
    return out


def _spline(y: np.ndarray, spar: float, h: np.ndarray | None = None, w: np.ndarray | None = None) -> np.ndarray:
    """The spline at points h apart, by weights w (both 1 unless given)."""
    n = len(y)
    p = 1.0 if spar <= 0 else 0.0 if spar >= 1 else 1 - spar
    if n < 3 or p == 1:
        return y.copy()
    h, w = np.ones(n - 1) if h is None else h, np.ones(n) if w is None else w
    if p == 0:
        x = np.append(0, np.cumsum(h))
        return np.polyval(np.polyfit(x, y, 1, w=np.sqrt(w)), x)
    lam = (1 - p) / p
    # (R + lam Q' W^-1 Q) g = Q'y is banded with two off-diagonals: solved by banded Cholesky in O(n)
    m = n - 2
    q0, q2 = 1 / h[:-1], 1 / h[1:]
    q1 = -q0 - q2
    d = np.zeros((3, m))
    d[0] = (h[:-1] + h[1:]) / 3 + lam * (q0**2 / w[:-2] + q1**2 / w[1:-1] + q2**2 / w[2:])
    d[1, 1:] = h[1:-1] / 6 + lam * (q1[:-1] * q0[1:] / w[1:-2] + q2[:-1] * q1[1:] / w[2:-1])
    d[2, 2:] = lam * q2[:-2] * q0[2:] / w[2:-2]
    rhs = q0 * y[:-2] + q1 * y[1:-1] + q2 * y[2:]
    low = np.zeros((3, m))
    z = np.zeros(m)
    for i in range(m):
        b = d[2, i] / low[0, i - 2] if i > 1 else 0.0
        a = (d[1, i] - (b * low[1, i - 1] if i > 1 else 0.0)) / low[0, i - 1] if i else 0.0
        low[0, i], low[1, i], low[2, i] = math.sqrt(d[0, i] - a * a - b * b), a, b
        z[i] = (rhs[i] - (a * z[i - 1] if i else 0) - (b * z[i - 2] if i > 1 else 0)) / low[0, i]
    g = np.zeros(m)
    for i in range(m - 1, -1, -1):
        t = z[i] - (low[1, i + 1] * g[i + 1] if i + 1 < m else 0) - (low[2, i + 2] * g[i + 2] if i + 2 < m else 0)
        g[i] = t / low[0, i]
    bent = np.zeros(n)
    bent[:-2] += q0 * g
    bent[1:-1] += q1 * g
    bent[2:] += q2 * g
    return y - lam * bent / w


def mad_outliers(y: np.ndarray, threshold: float = 6.0, spar: float = 0.5) -> np.ndarray:
    """Whether smoothed values are beyond median +- threshold scaled MADs; none for under three values or MAD 0."""
    if len(y) < 3:
        return np.zeros(len(y), bool)
    s = smoothing_spline(y, spar)
    med = np.median(s)
    mad = MAD_SCALE * np.median(np.abs(s - med))
    return np.zeros(len(y), bool) if mad == 0 else (s > med + threshold * mad) | (s < med - threshold * mad)


def tree_bins(features: DataFrame, limit: float = 0.6, force: int = 150, *by: str) -> DataFrame:
    """by, bin, bad: bins outside the largest leaf. Groups of under force bins have none bad (``tree_skipped`` names them:
    the tree says nothing there), and groups without peaks have no features. features: by, bin, channel,
    cluster, value. A file's matrix is bins by clusters (at most about a thousand by a hundred)."""
    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="bin", columns=["channel", "cluster"], values="value").sort_index().sort_index(axis=1)
        good = isolation_tree(wide.to_numpy(), limit) if len(wide) >= force else np.ones(len(wide), bool)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "bin": wide.index.astype("int32"), "bad": ~good})

    ship(features.sparkSession)
    types = dict(features.dtypes)
    return features.groupBy(*keys).applyInPandas(run, "".join(f"`{k}` {types[k]}, " for k in keys) + "bin int, bad boolean")


def tree_skipped(n_bins: DataFrame, features: DataFrame, force: int = 150, *by: str) -> DataFrame:
    """by, reason: the files that the tree cannot judge: "bins" (under force), "peaks" (no features). n_bins: by, n_bins."""
    some = features.select(*by).distinct() if by else features.limit(1).select(F.lit(True).alias("some_"))
    few = F.when(F.col("n_bins") < force, "bins")
    if by:
        seen = n_bins.join(some.withColumn("some_", F.lit(True)), list(by), "left")
    else:
        seen = n_bins.join(some, F.lit(True), "left")  # one row
    return seen.select(*by, F.when(F.col("some_").isNull(), "peaks").otherwise(few).alias("reason")).where("reason is not null")


def smoothed(features: DataFrame, spar: float = 0.5, *by: str) -> DataFrame:
    """features with smooth: each trajectory (by, channel, cluster) over its bins."""
    keys = [*by, "channel", "cluster"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        return pdf.assign(smooth=smoothing_spline(pdf["value"].to_numpy(), spar))

    ship(features.sparkSession)
    return features.groupBy(*keys).applyInPandas(run, ", ".join(f"`{n}` {t}" for n, t in features.dtypes) + ", smooth double")


def mad_bins(smooth: DataFrame, threshold: float = 6.0, *by: str) -> DataFrame:
    """by, channel, cluster, bin, bad, from smoothed trajectories; exact medians in groups of bins."""
    keys = [*by, "channel", "cluster"]
    med = smooth.groupBy(*keys).agg(F.median("smooth").alias("med"), F.count(F.lit(1)).alias("n"))
    x = smooth.join(med, keys)
    mad = x.groupBy(*keys).agg((F.median(F.abs(F.col("smooth") - F.col("med"))) * F.lit(MAD_SCALE)).alias("mad"))
    x = x.join(mad, keys)
    far = F.abs(F.col("smooth") - F.col("med")) > threshold * F.col("mad")
    return x.select(*keys, "bin", ((F.col("n") >= 3) & (F.col("mad") > 0) & far).alias("bad"))


def margins(df: DataFrame, ranges: dict[str, tuple[float, float] | None], *by: str, low=None, high=None) -> tuple[DataFrame, list[Column]]:
    """(df with in_margin, aggregates counting (min_removed, max_removed) by channel).

    A value at or under max(min(low, 0), data min), or over min(high, data max), is in the margin. A channel without a
    range has (min(data min, 0), max(data max, 262144)). One aggregation gives all channels' extremes, of each file
    (by) its own.
    """
    channels = list(ranges)
    ext = df.groupBy(*by).agg(*(f(F.col(f"`{c}`")).alias(f"{n}_{i}_") for i, c in enumerate(channels) for n, f in (("lo", F.min), ("hi", F.max))))
    x = beside(df, grouped(ext, "extremes", *by), *by)
    gone, counts = F.lit(False), []
    for i, c in enumerate(channels):
        v, lo, hi = F.col(f"`{c}`"), F.col(f"lo_{i}_"), F.col(f"hi_{i}_")
        a, b = (F.least(lo, F.lit(0.0)), F.greatest(hi, F.lit(262144.0))) if ranges[c] is None else (F.lit(float(ranges[c][0])), F.lit(float(ranges[c][1])))
        under = v <= F.greatest(F.least(a, F.lit(0.0)), lo) if low is None or c in low else F.lit(False)
        over = v > F.least(b, hi) if high is None or c in high else F.lit(False)
        counts += [F.count_if(under).alias(f"{c}_min_removed"), F.count_if(over & ~under & ~gone).alias(f"{c}_max_removed")]
        gone = gone | under | over
    return x.withColumn("in_margin", F.coalesce(gone, F.lit(False))), counts


def doublets(df: DataFrame, area: str, height: str, *by: str, nmad: float = 4.0, b: float = 0.0) -> DataFrame:
    """df with ratio = A / (1e-10 + H + b) and single: ratio below its file's (by) median + nmad scaled MADs."""
    x = df.withColumn("ratio", F.col(f"`{area}`") / (F.lit(1e-10) + F.col(f"`{height}`") + F.lit(b)))
    spread = median_mad(x.select(*by, "ratio"), "ratio", *by).select(*by, F.col("median").alias("med_"), (F.col("mad") * F.lit(MAD_SCALE)).alias("mad_"))
    return beside(x, grouped(spread, "spreads", *by), *by).select(*df.columns, "ratio", (F.col("ratio") < F.col("med_") + nmad * F.col("mad_")).alias("single"))
