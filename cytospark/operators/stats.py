"""Statistics of channels and gated populations, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import beside, grouped


def channel_summary(df: DataFrame, channel: str, *by: str) -> DataFrame:
    """min, max, mean, sample standard deviation."""
    c = F.col(f"`{channel}`")
    return df.groupBy(*by).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))


def min_max(df: DataFrame, channel: str, *by: str) -> DataFrame:
    """by, min, max of the groups of more than one value."""
    c = F.col(f"`{channel}`")
    return df.groupBy(*by).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")


def shape(df: DataFrame, channels: int, *by: str) -> DataFrame:
    """by, rows, columns."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(channels))


def parameter_aggregates(v: Column, prefix: str = "") -> list[Column]:
    """mean, geometric mean (null unless all are positive), median, quartiles, population std, cv, min, max."""
    mean, sd = F.avg(v), F.stddev_pop(v)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    geo = F.when(F.min(v) > 0, F.exp(F.avg(F.when(v > 0, F.ln(v)))))
    cv = F.when(mean != 0, sd / F.abs(mean) * 100)
    named = {"mean": mean, "geometric_mean": geo, "q1": q[0], "median": q[1], "q3": q[2], "std": sd, "cv": cv, "min": F.min(v), "max": F.max(v)}
    return [c.alias(prefix + n) for n, c in named.items()]


def gate_aggregates(cond: Column, x: Column, y: Column) -> list[Column]:
    """count, percent of all events, centroid; zeros where nothing is in the gate."""
    n = F.count_if(cond)
    return [
        n.alias("count"), (n / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100).alias("percent"),
        F.coalesce(F.avg(F.when(cond, x)), F.lit(0.0)).alias("centroid_x"), F.coalesce(F.avg(F.when(cond, y)), F.lit(0.0)).alias("centroid_y"),
    ]


def gate_statistics(df: DataFrame, cond: Column, x: str, y: str, *by: str) -> DataFrame:
    cx, cy = F.col(f"`{x}`"), F.col(f"`{y}`")
    df = df.withColumn("in_", cond)
    inside = lambda c: F.when(F.col("in_"), c)
    return df.groupBy(*by).agg(*gate_aggregates(F.col("in_"), cx, cy), *parameter_aggregates(inside(cx), "x_"), *parameter_aggregates(inside(cy), "y_"))


#: Groups up to so many values are ranked whole; of larger ones about a thousandth around each rank is.
ACCURACY = 10_000


def order_statistics(df: DataFrame, value: str, ranks: dict[str, tuple[float, object]], *by: str, accuracy: int = ACCURACY) -> DataFrame:
    """by, n_, min_, max_, and for each name the exact value of a 0-based rank; ranks: name -> (about which share of the
    group, n -> rank). Nulls do not count.

    No group is sorted and none meets in one task: a first pass bounds each rank's value by approximate percentiles, whose
    error in rank is under n / accuracy; a second counts what is below, and ranks the distinct values in between. A rank
    outside its bounds would be an error, not another value.
    """
    v = F.col("v_")
    x = df.select(*by, F.col(f"`{value}`").cast("double").alias("v_")).where("v_ is not null")
    step = 4 / accuracy
    shares = sorted({s for s, _ in ranks.values()})
    ends = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-step, step)]
    first = x.groupBy(*by).agg(F.count(v).alias("n_"), F.min(v).alias("min_"), F.max(v).alias("max_"), F.percentile_approx(v, ends, accuracy).alias("ends_"))
    small = F.col("n_") <= accuracy
    bound = lambda i, end: F.when(small | F.lit(ends[i] in (0.0, 1.0)), F.col(end)).otherwise(F.get("ends_", F.lit(i)))
    spans = [F.struct(F.lit(i).alias("i"), bound(2 * i, "min_").alias("lo"), bound(2 * i + 1, "max_").alias("hi")) for i in range(len(shares))]
    first = first.select(*by, F.struct("n_", "min_", "max_").alias("all_"), F.array(*spans).alias("spans_"))
    both = beside(x, grouped(first, "bounds", *by), *by)
    if len(shares) == 1:
        near = both.select(*by, "v_", "all_", F.col("spans_")[0].alias("s_")).where(v <= F.col("s_.hi"))
    else:
        near = both.select(*by, "v_", "all_", F.explode(F.filter("spans_", lambda s: v <= s["hi"])).alias("s_"))
    # a row for each distinct value between the bounds, and one for all below
    inside = near.groupBy(*by, "all_", F.col("s_.i").alias("i"), F.when(v >= F.col("s_.lo"), v).alias("at")).agg(F.count(F.lit(1)).alias("k"))
    inside = inside.withColumn("upto", F.sum("k").over(Window.partitionBy(*by, "i").orderBy(F.asc_nulls_first("at"))))
    value_ = F.coalesce("at", F.raise_error(F.lit("a rank outside its bounds")))
    holds = lambda share, of: (F.col("i") == shares.index(share)) & (F.col("upto") > of(F.col("all_.n_"))) & (F.col("upto") - F.col("k") <= of(F.col("all_.n_")))
    picked = inside.groupBy(*by, "all_").agg(*(F.max(F.when(holds(*r), value_)).alias(name) for name, r in ranks.items()))
    return picked.select(*by, "all_.*", *ranks)


def exact_median(df: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """by, name: the mean of the two middle values."""
    mid = order_statistics(df, value, {"a_": (0.5, lambda n: F.floor((n - 1) / 2)), "b_": (0.5, lambda n: F.floor(n / 2))}, *by)
    return mid.select(*by, ((F.col("a_") + F.col("b_")) / 2).alias(name))


def median_mad(df: DataFrame, value: str, *by: str) -> DataFrame:
    """median, raw MAD and MAD times 1.4826, exact; no group's values meet in one task."""
    med = grouped(exact_median(df, value, "median", *by), "medians", *by)
    far = beside(df, med, *by).select(*by, F.abs(F.col(f"`{value}`") - F.col("median")).alias("far_"))
    mad = exact_median(far, "far_", "mad", *by)
    return (med.join(mad, list(by)) if by else med.crossJoin(F.broadcast(mad))).withColumn("mad_scaled", F.col("mad") * F.lit(1.4826))


def index_iqr(df: DataFrame, value: str, *by: str) -> DataFrame:
    """sorted[3n div 4] - sorted[n div 4]; the range where n < 4."""
    r = order_statistics(df, value, {"a_": (0.25, lambda n: F.floor(n / 4)), "b_": (0.75, lambda n: F.floor(3 * n / 4))}, *by)
    return r.select(*by, F.when(F.col("n_") < 4, F.col("max_") - F.col("min_")).otherwise(F.col("b_") - F.col("a_")).alias("iqr"))


def percentile_bounds(df: DataFrame, value: str, low: float, high: float, *by: str) -> DataFrame:
    """sorted[floor(low n)] and sorted[ceil(high n)], within the array."""
    within = lambda n, i: F.greatest(F.lit(0), F.least(n - 1, i))
    return order_statistics(df, value, {"low": (low, lambda n: within(n, F.floor(n * low))), "high": (high, lambda n: within(n, F.ceil(n * high)))}, *by).select(*by, "low", "high")
