"""Density peaks of bins: kernel density on a grid, local maxima, clusters of peaks over bins, feature matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

GRID = 512


def bandwidth(v: np.ndarray, adjust: float = 1.0) -> float:
    """0.9 min(population sd, IQR / 1.34) n^-0.2; v is sorted."""
    n = len(v)
    iqr = v[3 * n // 4] - v[n // 4] if n >= 4 else v[-1] - v[0]
    return 0.9 * min(v.std(), iqr / 1.34) * n**-0.2 * adjust


def density(v: np.ndarray, adjust: float = 1.0) -> tuple[np.ndarray, np.ndarray] | None:
    """Grid and density: counts of cells, convolved with a Gaussian half a cell off. None for under three finite values."""
    v = np.sort(v[np.isfinite(v)])
    n = len(v)
    if n < 3:
        return None
    bw = bandwidth(v, adjust)
    low, high = v[0] - 3 * bw, v[-1] + 3 * bw
    d = (high - low) / (GRID - 1)
    grid = low + np.arange(GRID) * d
    if bw == 0:
        return grid, np.full(GRID, np.nan)
    count = np.bincount(np.minimum(np.floor((v - low) / d).astype(int), GRID - 1), minlength=GRID)
    kernel = np.exp(-0.5 * ((np.arange(1 - GRID, GRID) + 0.5) * d / bw) ** 2) / np.sqrt(2 * np.pi)
    return grid, np.convolve(count, kernel)[GRID - 1 : 2 * GRID - 1] / (n * bw)


def local_peaks(grid: np.ndarray, y: np.ndarray, removal: float = 1 / 3) -> np.ndarray:
    """Strict interior maxima above removal times the largest; without one, the last largest; without a density, the last."""
    if np.isnan(y).all():
        return grid[-1:]
    inner = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:]) & (y[1:-1] > removal * y.max())) + 1
    return grid[inner] if len(inner) else grid[[len(y) - 1 - int(np.argmax(y[::-1]))]]


def _grouped(df: DataFrame, by: tuple[str, ...], body, schema: str) -> DataFrame:
    """body(values in no order) of each group: values are gathered in the JVM, a group has one bin's, and many groups
    cross to Python in one Arrow batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                values = part.column(len(by))
                at, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False).astype(float)
                outs = [body(flat[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                take = pa.array(np.repeat(np.arange(len(outs)), [len(o[0]) for o in outs]))
                cols = [pa.array(np.concatenate(c)) for c in zip(*outs, strict=True)]
                yield pa.record_batch([*(part.column(k).take(take) for k in range(len(by))), *cols], names=[*by, *names])

    ship(df.sparkSession)
    types = dict(df.dtypes)
    values = df.groupBy(*by).agg(F.collect_list("value").alias("values"))
    return values.select(*by, "values").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in by) + ", " + schema)


def densities(df: DataFrame, *by: str) -> DataFrame:
    """by, i, x, density of each group's column value."""
    def body(v):
        got = density(v)
        return (np.zeros(0, np.int32), np.zeros(0), np.zeros(0)) if got is None else (np.arange(GRID, dtype=np.int32), got[0], got[1])

    return _grouped(df, by, body, "i int, x double, density double")


def bin_peaks(df: DataFrame, *by: str, removal: float = 1 / 3, remove_zeros: bool = False) -> DataFrame:
    """by, peak_value: the peaks of each group, ascending."""
    def body(v):
        v = v[v != 0] if remove_zeros else v
        got = density(v)
        return (local_peaks(*got, removal) if got else np.zeros(0),)

    return _grouped(df, by, body, "peak_value double")


def clusters(bins: np.ndarray, peaks: np.ndarray, n_bins: int, least_percent: float = 10.0, share: float = 0.5) -> np.ndarray:
    """Cluster (from 1) of each peak, 0 for those of clusters that too few bins have; rows are sorted by bin, then peak.

    The reference count is the largest number of peaks that at least least_percent of the bins have (1 if none); its
    bins' k-th peaks give cluster medians; each peak goes to the nearest, the first on ties. A cluster stays if at least
    share of the bins have it.
    """
    _, at, per = np.unique(bins, return_inverse=True, return_counts=True)
    place = np.arange(len(bins)) - (np.cumsum(per) - per)[at]
    freq = np.bincount(per)
    freq[0] = n_bins - len(per)
    enough = np.flatnonzero((freq > 0) & (freq >= math.ceil(least_percent / 100.0 * n_bins)))
    ref = int(enough[-1]) if len(enough) else 1
    typical = per[at] == ref
    medians = np.array([np.median(peaks[typical & (place == k)]) for k in range(ref if typical.any() else 0)])
    cluster = np.abs(peaks[:, None] - medians[None]).argmin(1) + 1 if len(medians) else np.ones(len(bins), int)
    for c in np.unique(cluster):
        if len(np.unique(bins[cluster == c])) < math.ceil(n_bins * share):
            cluster[cluster == c] = 0
    return cluster


def _clustered(peaks: DataFrame, n_bins: DataFrame, body, schema: str, least_percent: float, share: float, by: tuple[str, ...], file: tuple[str, ...]) -> DataFrame:
    """body(bins, peaks, cluster, number of bins) of each group of bins of a file's channel (by), a few rows a bin."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bin", "ascending"), ("peak_value", "ascending")])
        bins, values, n = t.column("bin").to_numpy(), t.column("peak_value").to_numpy(), t.column("n_bins")[0].as_py()
        cluster = clusters(bins, values, n, least_percent, share)
        kept = cluster > 0
        out = body(bins[kept], values[kept], cluster[kept], n)
        keys = [pa.array([t.column(k)[0].as_py()] * len(out[0]), t.schema.field(k).type) for k in by]
        return pa.table([*keys, *map(pa.array, out)], names=[*by, *names])

    ship(peaks.sparkSession)
    types = dict(peaks.dtypes)
    x = peaks.join(n_bins, list(file)) if file else peaks.crossJoin(F.broadcast(n_bins))  # one row
    return x.groupBy(*by).applyInArrow(run, "".join(f"`{k}` {types[k]}, " for k in by) + schema)


def cluster_peaks(peaks: DataFrame, n_bins: DataFrame, least_percent: float = 10.0, share: float = 0.5, channel: str = "channel", *by: str) -> DataFrame:
    """by, channel, bin, peak_value, cluster of the peaks in clusters that stay. n_bins: by, n_bins."""
    return _clustered(peaks, n_bins, lambda b, v, c, _: (b, v, c.astype(np.int32)), "bin int, peak_value double, cluster int", least_percent, share, (*by, channel), by)


def features(peaks: DataFrame, n_bins: DataFrame, least_percent: float = 10.0, share: float = 0.5, channel: str = "channel", *by: str) -> DataFrame:
    """by, channel, cluster, bin, value of every bin: its largest peak of the cluster, or the cluster's median."""
    def body(bins, values, cluster, n):
        names = np.unique(cluster)
        grid = np.empty((len(names), n))
        for i, c in enumerate(names):
            mine = cluster == c
            grid[i] = np.median(values[mine])
            grid[i, bins[mine]] = values[mine]  # ascending within a bin: the largest is last
        return np.repeat(names, n).astype(np.int32), np.tile(np.arange(n, dtype=np.int32), len(names)), grid.ravel()

    return _clustered(peaks, n_bins, body, "cluster int, bin int, value double", least_percent, share, (*by, channel), by)
