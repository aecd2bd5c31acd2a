"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, a temporary one only where that is unset (local sessions)."""
    if place := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return place
    if not (place := getattr(spark, "_own_checkpoint_dir", None)):
        place = spark._own_checkpoint_dir = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return place


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: several readers share one computation, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grouped(groups: DataFrame, name: str, *by: str) -> DataFrame:
    """groups, a row for each by, to be joined beside rows: written, so that Spark knows their size before it plans the join.
    Without by they are one row and stay a plan."""
    return written(groups, name) if by else groups


def beside(df: DataFrame, groups: DataFrame, *by: str, how: str = "inner") -> DataFrame:
    """df with the columns of its row of groups (see ``grouped``); rows whose by holds a null have none.

    Few groups are broadcast, and no row of df is dealt out by a key of few values. Where they are too many for that, a
    group's rows may be most of df: the join's key is a struct, which is no key of what follows, so that Spark can split it.
    """
    if not by:
        return df.crossJoin(F.broadcast(groups))  # one row
    whole = F.when(reduce(Column.__and__, (F.col(k).isNotNull() for k in by)), F.struct(*by)).alias("by_")
    return df.select("*", whole).join(groups.select(whole, *(F.col(f"`{c}`") for c in groups.columns if c not in by)), "by_", how).drop("by_")


def ship(spark: SparkSession) -> None:
    """Give executors this package once a session, wherever their Python's path leads."""
    context = spark.sparkContext
    if not getattr(context, "_cytospark_shipped", False):
        package = Path(__file__).resolve().parent
        file = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(file, "w") as z:
            for x in package.rglob("*.py"):
                z.write(x, x.relative_to(package.parent))
        context.addPyFile(str(file))
        context._cytospark_shipped = True
