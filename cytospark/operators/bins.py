"""Count-based bins over a file's events, half overlapping or not; event rates; runs of bins and events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QcError
from .events import dense_index


def events_per_bin(n: int, min_cells: int = 150, max_bins: int = 500, step: int = 500) -> int:
    return max(min_cells, (math.ceil(2 * n / max_bins) // step) * step + step)


def bin_sizes(n: Column, min_cells: int = 150, max_bins: int = 500, step: int = 500) -> Column:
    """events_per_bin of a column of event counts."""
    return F.greatest(F.lit(min_cells), F.floor(F.ceil(2 * n / max_bins) / step) * step + step).cast("long")


def bin_step(per_bin: int | Column) -> int | Column:
    if isinstance(per_bin, Column):
        return per_bin - F.floor((per_bin + 1) / 2)
    if per_bin <= 1:
        raise QcError("bins need two events")
    return per_bin - (per_bin + 1) // 2


def bin_count(n: int, per_bin: int) -> int:
    return -(-n // bin_step(per_bin))


def breaks(n: int, per_bin: int) -> list[tuple[int, int]]:
    step = bin_step(per_bin)
    return [(s, min(s + per_bin, n)) for s in range(0, n, step)]


def covering(index: Column, per_bin: int | Column) -> Column:
    """The array of overlapping bins that cover an event: arithmetic instead of a range join."""
    step = bin_step(per_bin)
    first = F.greatest(F.lit(0), F.ceil((index - per_bin + 1) / step)).cast("int")
    return F.sequence(first, F.floor(index / step).cast("int"))


def assign(df: DataFrame, per_bin: int | Column, index: str = "event_idx") -> DataFrame:
    return df.withColumn("bin", F.explode(covering(F.col(index), per_bin)))


def bin_medians(df: DataFrame, value: str, per_bin: int, index: str = "event_idx", *by: str) -> DataFrame:
    """Medians of bins that do not overlap."""
    return df.groupBy(*by, F.floor(F.col(index) / per_bin).cast("int").alias("bin")).agg(F.median(value).alias("median"))


def bin_rates(df: DataFrame, time: str, bin_: str = "bin", index: str = "event_idx", *by: str) -> DataFrame:
    """Events by time between a bin's first and last event, and the middle time; 0 where that span is not positive."""
    agg = df.groupBy(*by, bin_).agg(F.count(F.lit(1)).alias("n"), F.min_by(time, index).alias("t0"), F.max_by(time, index).alias("t1"))
    span = F.col("t1") - F.col("t0")
    return agg.withColumns({"rate": F.when((span > 0) & (F.col("n") >= 2), F.col("n") / span).otherwise(F.lit(0.0)), "mid": (F.col("t0") + F.col("t1")) / 2})


def islands(df: DataFrame, flag: str, order: str, *by: str) -> DataFrame:
    """Numbers maximal runs of equal flags: run_ and the run's length and ends."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)
    return df.withColumn("change_", change).withColumn("run_", F.sum("change_").over(w)).drop("change_")


def remove_short_runs(bins: DataFrame, flag: str = "bad", order: str = "bin", least: int = 5, *by: str) -> DataFrame:
    """Good runs under least bins that touch neither end become bad."""
    runs = islands(bins, flag, order, *by)
    run, all_ = Window.partitionBy(*by, "run_"), Window.partitionBy(*by)
    inner = (F.min(order).over(run) > F.min(order).over(all_)) & (F.max(order).over(run) < F.max(order).over(all_))
    short = ~F.col(flag) & (F.count(F.lit(1)).over(run) < least) & inner
    return runs.withColumn("short_", short).withColumn(flag, F.col(flag) | F.col("short_")).drop("short_", "run_")


def event_mask(events: DataFrame, bad_bins: DataFrame, per_bin: int | Column, index: str = "event_idx", *by: str) -> DataFrame:
    """good is false for events that any bad bin covers. A column per_bin is one of events.

    A verdict holds for a whole step between bins' starts: bin b covers steps b and b + 1 and, where bins hold an odd
    number of events, the first event of step b + 2. So events look up one row of a table of steps, as small as that of
    bins, and are neither multiplied nor joined with themselves.
    """
    step = bin_step(per_bin)
    i, odd = F.col(index), F.pmod(per_bin if isinstance(per_bin, Column) else F.lit(per_bin), F.lit(2)) == 1
    part = lambda k, first: F.struct((F.col("bin").cast("long") + k).alias("step_"), F.lit(first).alias("first_"))
    steps = bad_bins.select(*by, F.explode(F.array(part(0, False), part(1, False), part(2, True))).alias("p_"))
    steps = steps.groupBy(*by, "p_.step_").agg((~F.bool_and("p_.first_")).alias("all_"))
    marked = events.withColumn("step_", F.floor(i / step)).join(steps, [*by, "step_"], "left")
    bad = F.col("all_").isNotNull() & (F.col("all_") | (odd & (i % step == 0)))
    return marked.select(*events.columns, (~bad).alias("good"))


def unstable_regions(events: DataFrame, good: str = "good", order: str = "event_idx", *by: str) -> DataFrame:
    """First and last event of maximal runs of bad events: bad events whose index less their rank is equal."""
    ranks = dense_index(events.where(~F.col(good)).select(*by, F.col(order).alias("at_")), "at_", *by)
    grouped = ranks.select(*by, F.col("at_").alias(order), (F.col("at_") - F.col("event_idx")).alias("g_"))
    return grouped.groupBy(*by, "g_").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n")).drop("g_")
