"""Gates and rolling statistics over event streams (an extension: batch operators on Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gates import GateSet


def gated(stream: DataFrame, gates: GateSet, *ids: str) -> DataFrame:
    """Events in all the gates: stateless, so any stream."""
    return stream.where(gates.chain(ids))


def windowed(stream: DataFrame, time: str, value: str, width: str = "1 minute", late: str = "5 minutes", *by: str) -> DataFrame:
    """Count, mean, min and max by event-time window; state older than the watermark is dropped."""
    w = F.window(time, width)
    agg = stream.withWatermark(time, late).groupBy(w.alias("w"), *by)
    out = agg.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "mean", "min", "max")
