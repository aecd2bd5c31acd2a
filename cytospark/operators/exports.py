"""Quality-control exports and reports as DataFrames, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flags(events: DataFrame, good: str = "good", name: str = "good", yes: int = 1, no: int = 0) -> DataFrame:
    """file_id (if any), event_idx and one column: yes for good events, no for bad (1 and 0, or 2000 and 6000 in the
    numeric form)."""
    ids = [c for c in ("file_id",) if c in events.columns]
    return events.select(*ids, "event_idx", F.when(F.col(good), yes).otherwise(no).alias(name))


def write_flags(table: DataFrame, path: str) -> None:
    """A CSV a file in event order, in folders by file_id where there are several; files are written side by side."""
    if "file_id" in table.columns:
        sorted_ = table.repartition("file_id").sortWithinPartitions("file_id", "event_idx").drop("event_idx")
        sorted_.write.mode("overwrite").partitionBy("file_id").option("header", True).csv(path)
    else:
        table.orderBy("event_idx").drop("event_idx").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def with_quality(events: DataFrame, name: str = "QC", only_good: bool = False) -> DataFrame:
    """Events for the FCS writer with a 0/1 channel of their verdicts, or the good ones alone."""
    kept = events.where("good") if only_good else events
    return kept.withColumn(name, F.col("good").cast("float")).drop("good")


def report(events: DataFrame, n_bins: int, per_bin: int, channels: list[str], *by: str) -> DataFrame:
    """Counts and percentages of a masked event table, one row a file."""
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("good"))
    return events.groupBy(*by).agg(
        n.alias("n_events_before"), (n - bad).alias("n_events_after"), bad.alias("n_events_removed"),
        (bad / n * 100).alias("percentage_removed"),
    ).withColumns({"n_bins": F.lit(n_bins), "events_per_bin": F.lit(per_bin), "channels": F.array(*map(F.lit, channels))})


def as_json(table: DataFrame, *keep: str) -> DataFrame:
    return table.select(*keep, F.to_json(F.struct(*table.columns)).alias("json"))


def roll_up(reports: DataFrame) -> DataFrame:
    """files: status and seconds -> processed, successful, failed, mean seconds."""
    ok = F.col("error").isNull()
    return reports.agg(F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.avg("seconds").alias("mean_seconds"))
