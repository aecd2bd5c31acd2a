"""Quality control of many files: margins, doublets, preprocessing, bins; masks, cleaned events and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.transforms import fluorescence_channels
from ..operators import bins as B
from ..operators import compensation as C
from ..operators import events as E
from ..operators import exports as X
from ..operators import outliers as O
from ..session import written
from .control import Config, bin_verdicts, quality_control, sized


@dataclass(frozen=True)
class Job:
    channels: tuple[str, ...] | None = None  # fluorescence channels where not given
    remove_margins: bool = False
    ranges: dict[str, tuple[float, float] | None] | None = None
    doublets: tuple[str, str] | None = None  # area and height channels
    doublet_mads: float = 4.0
    matrix: list[list[float]] | None = None
    matrix_channels: tuple[str, ...] | None = None
    cofactor: float = C.PREPROCESS_COFACTOR
    mode: str = "all"
    per_bin: int | None = None
    mad: float = 6.0
    tree_limit: float = 0.6
    consecutive: int = 5


def clean(events: DataFrame, job: Job) -> DataFrame:
    """Events of all files (file_id, event_idx, channels) with good; margins and doublets are left out before bins.

    Files share one plan: extremes, medians, bins, peaks, trees and masks are grouped by file_id, so that a file's result
    does not depend on those beside it, and indices are made dense again after rows have left, since bins count the events
    that remain.
    """
    channels = tuple(job.channels or fluorescence_channels([c for c in events.columns if c not in ("file_id", "event_idx")]))
    if not channels:
        raise EngineError("no channels to work on")
    df = events
    if job.remove_margins:
        df, _ = O.margins(df, job.ranges or {c: None for c in channels}, "file_id")
        df = df.where("not in_margin").select(*events.columns)
    if job.doublets:
        df = O.doublets(df, *job.doublets, "file_id", nmad=job.doublet_mads).where("single").select(*events.columns)
    if df is not events:
        df = E.dense_index(df.withColumnRenamed("event_idx", "old_idx"), "old_idx", "file_id")
    df = C.preprocess(df, job.matrix, list(job.matrix_channels or channels), job.cofactor, list(channels))
    config = Config(channels, job.mode, job.per_bin, mad=job.mad, tree_limit=job.tree_limit, consecutive=job.consecutive, by=("file_id",))
    return quality_control(df, config)


def summary(events: DataFrame, config: Config) -> DataFrame:
    """One row a file: bins, share of tree bins, of tree or MAD bins, of events removed, and the difference of the last
    two (what the run filter and overlaps add; it may be negative)."""
    bins, sizes = bin_verdicts(events, config)
    events, per_bin = sized(events, sizes, config)
    by = list(config.by)
    n = F.count(F.lit(1))
    shares = bins.groupBy(*by).agg(n.alias("n_bins"), (F.count_if("tree") / n * 100).alias("tree_percent"), (F.count_if(F.col("tree") | F.col("mad")) / n * 100).alias("mad_percent"))
    masked = B.event_mask(events, bins.where("bad"), per_bin, "event_idx", *by)
    removed = masked.groupBy(*by).agg(n.alias("n_events"), (F.count_if(~F.col("good")) / n * 100).alias("removed_percent"))
    out = shares.join(removed, by) if by else shares.crossJoin(F.broadcast(removed))  # one row
    sizes = sizes.select(*by, F.col("per_bin_").alias("events_per_bin"))
    out = out.join(sizes, by) if by else out.crossJoin(F.broadcast(sizes))  # one row
    return out.withColumns({"events_per_bin": F.col("events_per_bin").cast("int"), "consecutive_percent": F.col("removed_percent") - F.col("mad_percent")})


def mad_contribution(bad: DataFrame, *by: str) -> DataFrame:
    """Percent of bins each channel's clusters mark, added over clusters; bad: by, channel, cluster, bin, bad."""
    per = bad.groupBy(*by, "channel", "cluster").agg((F.count_if("bad") / F.count(F.lit(1)) * 100).alias("percent"))
    return per.groupBy(*by, "channel").agg(F.sum("percent").alias("percent"))


def bin_report(events: DataFrame, bins: DataFrame, per_bin: int, time: str | None = None, *by: str) -> DataFrame:
    """One row a bin: its first event and the one after its last, time span and rate where there is a time, which steps
    flagged it, and whether it is an outlier. bins: by, bin, tree, mad, bad."""
    x = B.assign(events, per_bin)
    span = x.groupBy(*by, "bin").agg(F.min("event_idx").alias("start"), (F.max("event_idx") + 1).alias("end"), *([F.min_by(time, "event_idx").alias("start_time"), F.max_by(time, "event_idx").alias("end_time")] if time else []))
    n = F.col("end") - F.col("start")
    out = span.join(bins.select(*by, "bin", "tree", "mad", "bad"), [*by, "bin"])
    rate = {"rate": F.when((n >= 2) & (F.col("end_time") > F.col("start_time")), n / (F.col("end_time") - F.col("start_time")))} if time else {}
    return out.withColumns({"n": n, **rate, "consecutive": F.col("bad") & ~F.col("tree") & ~F.col("mad")}).withColumnRenamed("bad", "outlier")


def rate_correlation(report: DataFrame, *by: str) -> DataFrame:
    """by, r: correlation of a bin's rate with its being an outlier; null where either does not vary."""
    return report.where("rate is not null").groupBy(*by).agg(F.corr("rate", F.col("outlier").cast("double")).alias("r"))


def metadata(summary_: DataFrame, config: Config) -> DataFrame:
    """The summary's rows as reports: counts, percentages by step, channels and configuration (null steps: not run)."""
    c = config
    steps = {"tree_percent": c.mode in ("all", "tree"), "mad_percent": c.mode in ("all", "mad")}
    removed = F.round(F.col("n_events") * F.col("removed_percent") / 100).cast("long")
    used = F.struct(F.lit(c.mode).alias("qc_mode"), F.lit(float(c.mad)).alias("mad"), F.lit(float(c.tree_limit)).alias("it_limit"), F.lit(c.consecutive).alias("consecutive_bins"), F.lit(c.remove_zeros).alias("remove_zeros"))
    return summary_.select(
        *config.by, F.col("n_events").alias("n_events_before"), (F.col("n_events") - removed).alias("n_events_after"), removed.alias("n_events_removed"),
        F.col("removed_percent").alias("percentage_removed"), *(F.when(F.lit(on), F.col(k)).alias({"tree_percent": "it_percentage"}.get(k, "mad_percentage")) for k, on in steps.items()),
        F.col("consecutive_percent").alias("consecutive_percentage"), "n_bins", "events_per_bin", F.array(*map(F.lit, c.channels)).alias("channels_analyzed"), used.alias("config"),
    )


def write_reports(reports: DataFrame, path: str, per_file: bool = True) -> None:
    """JSON: a folder for each file (file_id=...), or one document with totals and all files' reports."""
    if per_file:
        X.as_json(reports, "file_id").write.mode("overwrite").partitionBy("file_id").text(path)
        return
    failed = F.count_if(F.col("error").isNotNull()) if "error" in reports.columns else F.lit(0).cast("long")
    n = F.count(F.lit(1))
    whole = reports.agg(n.alias("total_files"), (n - failed).alias("successful"), failed.alias("failed"), F.sort_array(F.collect_list(F.struct(*reports.columns))).alias("results"))  # a row a file
    X.as_json(whole).write.mode("overwrite").text(path)


def report(cleaned: DataFrame, job: Job, n_bins: int, per_bin: int) -> DataFrame:
    return X.report(cleaned, n_bins, per_bin, list(job.channels or ()), "file_id")


def grid(n: int) -> tuple[int, int]:
    """Rows and columns of a sheet of n panels, grown in turn from 1 x 1, rows first."""
    rows = cols = 1
    while rows * cols < n:
        if rows == cols:
            rows += 1
        else:
            cols += 1
    return rows, cols


def time_panel(events: DataFrame, time: str, per_bin: int, *by: str) -> DataFrame:
    """Panel of event rates: by, bin, mid (time), rate, and whether all the bin's events are good (events: with good)."""
    x = B.assign(events, per_bin)
    rates = B.bin_rates(x, time, "bin", "event_idx", *by)
    good = x.groupBy(*by, "bin").agg(F.bool_and("good").alias("good"))
    return rates.join(good, [*by, "bin"]).select(*by, "bin", "mid", "rate", "good")


def channel_panel(features: DataFrame, threshold: float = 6.0, *by: str) -> DataFrame:
    """Panels of channels: each trajectory's value and spline by bin, its median and the band of threshold scaled MADs."""
    keys = [*by, "channel", "cluster"]
    smooth = written(O.smoothed(features, 0.5, *by), "panel")
    med = smooth.groupBy(*keys).agg(F.median("smooth").alias("median"))
    x = smooth.join(med, keys)
    mad = x.groupBy(*keys).agg((F.median(F.abs(F.col("smooth") - F.col("median"))) * F.lit(O.MAD_SCALE)).alias("mad"))
    low, high = F.col("median") - threshold * F.col("mad"), F.col("median") + threshold * F.col("mad")
    return x.join(mad, keys).select(*keys, "bin", "value", "smooth", "median", low.alias("low"), high.alias("high"))
