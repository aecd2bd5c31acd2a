"""Shared plumbing: reading tables, written intermediate tables, releasing shuffle files."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: White space of the word definition, as a Java character class. A word is a maximal run of anything else.
WS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set to a temporary one only where unset (tests)."""
    conf = spark.sparkContext.getConf()
    if not (place := conf.get("spark.checkpoint.dir", None)):
        if not (place := getattr(spark, "_own_checkpoint_dir", None)):
            place = spark._own_checkpoint_dir = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
            spark.sparkContext.setCheckpointDir(place)
    return place


class Stash:
    """Tables written to the shared folder to cut lineage: a lost executor costs a re-read, not a recomputation.

    Tables a result still reads lazily stay (the caller of a query consumes it after it returns); ``drop`` removes
    those no longer needed, and ``release`` at the end of a phase the shuffle files of its jobs, so that disk use is the
    largest phase, not the sum of all phases.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of plans nothing refers to any more.

        Twice, as plans reached from objects with finalisers outlive the first collection.
        """
        gc.collect()
        for _ in range(2):
            self.spark._jvm.System.gc()
            time.sleep(0.1)


def words(text: Column) -> Column:
    """The text's words as an array of strings; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building them: white-space runs of the padded text, less one."""
    t = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    return F.regexp_count(t, F.lit(WS + r"[^\x20\x09-\x0D]")).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]
