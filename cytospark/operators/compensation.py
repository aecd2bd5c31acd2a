"""Spillover compensation and spectral unmixing: linear combinations of columns, coefficients folded on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ChannelError
from ..functions.transforms import PREPROCESS_COFACTOR, Arcsinh, Biexponential, fluorescence_channels
from ..session import beside, grouped, ship
from ..sources import keywords as K


def invert(matrix) -> np.ndarray:
    m = np.asarray(matrix, dtype=float)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ChannelError(f"not a square matrix: {m.shape}")
    return np.linalg.inv(m)


def is_identity(matrix, tolerance: float = 1e-6) -> bool:
    m = np.asarray(matrix, dtype=float)
    return bool(np.all(np.abs(m - np.eye(len(m))) < tolerance))


def combine(weights, columns: list[Column]) -> Column:
    """Sum of weight * column, without the terms of weight zero."""
    terms = [F.lit(float(w)) * c for w, c in zip(weights, columns, strict=True) if w != 0]
    out = terms[0] if terms else F.lit(0.0)
    for t in terms[1:]:
        out = out + t
    return out


def compensate(df: DataFrame, matrix, channels: list[str], only: list[str] | None = None, transpose: bool = False) -> DataFrame:
    """x'_i = sum_j inv(S)[i, j] x_j on the channels (those in only); transpose for matrices whose rows are dyes."""
    if missing := [c for c in channels if c not in df.columns]:
        raise ChannelError(f"missing channels: {missing}")
    if len(channels) != len(matrix):
        raise ChannelError(f"{len(channels)} channels, matrix of {len(matrix)}")
    if is_identity(matrix):
        return df
    inverse = invert(matrix)
    inverse = inverse.T if transpose else inverse
    cols = [F.col(f"`{c}`").cast("double") for c in channels]
    return df.withColumns({c: combine(inverse[i], cols) for i, c in enumerate(channels) if only is None or c in only})


def inverses(keywords: DataFrame, channels: list[str]) -> DataFrame:
    """file_id, inverse: of each file's spillover matrix over the channels, by rows; keywords: file_id, key, value.

    Channels that a file's matrix does not name stay as they are; a file without a matrix has no row; a matrix that is
    malformed or singular, or names a channel that is not among the channels, is an error.
    """
    def run(batches):
        for b in batches:
            ids, out = [], []
            for ident, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = K.spillover({x["key"]: x["value"] for x in found})
                if unknown := set(m["names"]) - set(channels):
                    raise ChannelError(f"{ident}: matrix of other channels: {sorted(unknown)}")
                full = np.eye(len(channels))
                at = [channels.index(c) for c in m["names"]]
                full[np.ix_(at, at)] = np.reshape(m["values"], (m["n"], m["n"]))
                ids.append(ident)
                out.append(invert(full).ravel())
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.float64()))], names=["file_id", "inverse"])

    ship(keywords.sparkSession)
    found = keywords.where(F.col("key").isin("$SPILLOVER", "$SPILL", "$COMP")).groupBy("file_id").agg(F.collect_list(F.struct("key", "value")).alias("found"))
    return found.mapInArrow(run, "file_id string, inverse array<double>")


def compensate_files(df: DataFrame, keywords: DataFrame, channels: list[str]) -> DataFrame:
    """Each file's events by its own matrix, joined by file_id; files without one stay as they are."""
    if missing := [c for c in channels if c not in df.columns]:
        raise ChannelError(f"missing channels: {missing}")
    n = len(channels)
    raw = [F.col(f"`{c}`").cast("double") for c in channels]
    x = beside(df, grouped(inverses(keywords, channels).withColumnRenamed("inverse", "inverse_"), "inverses", "file_id"), "file_id", how="left")
    row = lambda i: sum((F.get("inverse_", F.lit(i * n + j)) * raw[j] for j in range(1, n)), F.get("inverse_", F.lit(i * n)) * raw[0])
    return x.withColumns({c: F.when(F.col("inverse_").isNull(), raw[i]).otherwise(row(i)) for i, c in enumerate(channels)}).select(*df.columns)


def default_biexponential(df: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """The given channels, or all fluorescence ones, on the biexponential scale with default parameters."""
    scale = Biexponential()
    return df.withColumns({c: scale.forward(F.col(f"`{c}`")) for c in channels or fluorescence_channels([c for c in df.columns if c not in ("file_id", "event_idx")])})


def unmix(df: DataFrame, matrix, channels: list[str], cofactor: float = 200.0) -> DataFrame:
    """From arcsinh space to raw, compensated, and back."""
    scale = Arcsinh(cofactor)
    raw = df.withColumns({c: scale.inverse(F.col(f"`{c}`")) for c in channels})
    return compensate(raw, matrix, channels).withColumns({c: scale.forward(F.col(f"`{c}`")) for c in channels})


def matvec(matrix, array: Column) -> Column:
    """matrix @ array for an array column."""
    rows = [F.array(*(F.lit(float(v)) for v in r)) for r in np.asarray(matrix, dtype=float)]
    dot = lambda r: F.aggregate(F.zip_with(r, array, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(*rows), dot)


def preprocess(df: DataFrame, matrix=None, channels: list[str] | None = None, cofactor: float = PREPROCESS_COFACTOR, scaled: list[str] | None = None) -> DataFrame:
    """Compensate the channels and scale biexponentially where there is a matrix, else arcsinh.

    What is scaled: the given columns, or the fluorescence channels among the channels or all numeric columns.
    """
    numeric = [c for c, t in df.dtypes if t in ("float", "double", "int", "bigint") and not c.endswith("_idx")]
    named = scaled or [c for c in fluorescence_channels(channels or numeric)]
    if matrix is not None:
        df, scale = compensate(df, matrix, channels), Biexponential()
    else:
        scale = Arcsinh(cofactor)
    return df.withColumns({c: scale.forward(F.col(f"`{c}`")) for c in named})
