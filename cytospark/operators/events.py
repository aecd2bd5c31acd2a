"""Event tables: columns by name, added columns, dense indices, concatenation, plot options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ChannelError
from ..functions.transforms import is_fluorescence


def find_channel(df: DataFrame, name: str) -> str:
    """The channel of that name in any case."""
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise ChannelError(f"no channel {name!r}")


def add_channel(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ChannelError(f"channel {name!r} exists")
    return df.withColumn(name, value)


def add_values(df: DataFrame, name: str, values: DataFrame, keys: list[str]) -> DataFrame:
    """Add a column of values joined by event; events without a value are an error when rows are read."""
    if name in df.columns:
        raise ChannelError(f"channel {name!r} exists")
    out = df.join(values.select(*keys, F.col("value").alias(name), F.lit(True).alias("has_")), keys, "left")
    return out.withColumn(name, F.when(F.col("has_"), F.col(name)).otherwise(F.raise_error(F.lit("fewer values than events")))).drop("has_")


def concatenate(frames: list[DataFrame]) -> DataFrame:
    """Union of files with the same channels in the same order."""
    if not frames:
        raise ChannelError("nothing to concatenate")
    if any(f.columns != frames[0].columns for f in frames):
        raise ChannelError("files have different channels")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def dense_index(df: DataFrame, order: str, *by: str, cell: int = 1 << 20) -> DataFrame:
    """event_idx: 0-based dense rank by order (a long) within by; ranks within cells plus the cells' running counts."""
    df = df.withColumn("cell_", F.floor(F.col(order) / cell))
    counts = df.groupBy(*by, "cell_").agg(F.count(F.lit(1)).alias("n_"))
    before = (F.sum("n_").over(Window.partitionBy(*by).orderBy("cell_")) - F.col("n_")).alias("before_")
    own = F.row_number().over(Window.partitionBy(*by, "cell_").orderBy(order)) - 1
    out = df.withColumn("own_", own).join(counts.select(*by, "cell_", before), [*by, "cell_"])
    return out.withColumn("event_idx", F.col("own_") + F.col("before_")).drop("own_", "before_", "cell_")


#: Label prefixes by processing state, and option ids.
PREFIXES = {"raw": "", "compensated": "Comp::", "unmixed": "Unmix::", "unmixed_compensated": "Comp+Unmix::"}
OPTIONS = ("transformed::", "comp_trans::", "unmix_trans::", "comp_unmix_trans::")


def display_label(name: Column, label: Column, state: Column) -> Column:
    prefix = F.lit("")
    for s, p in PREFIXES.items():
        prefix = F.when(state == s, p).otherwise(prefix)
    tail = F.when(label.isNotNull() & (label != "") & (label != name), F.concat(F.lit("::"), label)).otherwise("")
    return F.concat(prefix, name, tail)


def plot_options(parameters: DataFrame, include_compensated: bool) -> DataFrame:
    """One row an option: a transformed one (or all four states) for fluorescence, one raw for others."""
    fluor = F.array(*(F.concat(F.lit(o), F.col("name")) for o in (OPTIONS if include_compensated else OPTIONS[:1])))
    raw = F.array(F.concat(F.lit("raw::"), F.col("name")))
    return parameters.select("name", F.explode(F.when(is_fluorescence(F.col("name")), fluor).otherwise(raw)).alias("option"))
