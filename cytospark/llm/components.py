"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash

#: Edges that one task takes; so few that are left are contracted in one.
EDGES_A_TASK = 100_000


def merged(least: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """least[i], the smallest place linked with i, after the links x[k], y[k] as well."""
    while True:
        a, b = least[x], least[y]
        new = a != b
        if not new.any():
            return least
        least = least.copy()
        np.minimum.at(least, np.maximum(a, b)[new], np.minimum(a, b)[new])
        while (least[least] != least).any():
            least = least[least]
        x, y = x[new], y[new]


def _whole(batches):
    """(id, to) of all ids of the edges (a, b) of one task: the smallest id linked."""
    found = [b for b in batches if b.num_rows]
    if found:
        t = pa.Table.from_batches(found)
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        least = merged(np.arange(len(names)), at[: len(a)], at[len(a) :])
        yield pa.record_batch([pa.array(names), pa.array(names[least])], names=["id", "to"])


def components(edges: DataFrame, stash: Stash, name: str = "cc") -> DataFrame:
    """(id, component) of every id in edges (a, b: long): the smallest id reachable.

    Each round points every id at the neighbour (or itself) of least random rank and renames both ends of every edge;
    loops and repeats vanish, so the edge table shrinks by a constant factor a round in expectation. Ranks are drawn
    anew each round, which makes chains and stars of any numbering shrink alike; once the edges left fit into one task, it
    contracts them all. A hub's edges meet only in joins that Spark can split and in partially aggregated minima. Nulls
    and self-loops in edges are ignored; an empty table gives an empty result.
    """
    spark = stash.spark
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = edges.where("a is not null and b is not null and a <> b").select(*pair(F.col("a"), F.col("b"))).distinct()
    edges = stash(edges, f"{name}-e0")
    steps, k = [], 0
    while n := edges.count():
        # what is left of the edges fits into so many tasks; more would only write empty files
        tasks = -(-n // EDGES_A_TASK)
        if tasks == 1:
            last = edges.select("a", "b").coalesce(1).mapInArrow(_whole, "id long, to long")
            if not steps:
                return stash(last.select("id", F.col("to").alias("component")), f"{name}-out")
            steps.append(stash(last, f"{name}-p{k}"))
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("r"), c.alias("id"))  # noqa: E731, B023
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        mine = rank(F.col("a"))
        to = low.select(F.col("a").alias("id"), F.when(F.col("m") < mine, F.col("m.id")).otherwise(F.col("a")).alias("to"))
        steps.append(stash(to.coalesce(tasks), f"{name}-p{k}"))
        p = steps[-1]
        moved = edges.join(p.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(p.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        moved = moved.where("x <> y").select(*pair(F.col("x"), F.col("y"))).distinct()
        edges = stash(moved.coalesce(tasks), f"{name}-e{k + 1}")
        stash.drop(f"{name}-e{k}")
        k += 1
    if not steps:
        return spark.createDataFrame([], "id long, component long")
    first = -(-steps[0].count() // EDGES_A_TASK)
    at = steps[0]
    for j, p in enumerate(steps[1:]):
        at = at.join(p.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        if j % 4 == 3:
            at = stash(at.coalesce(first), f"{name}-at{j}")
    at = stash(at.coalesce(first), f"{name}-at")
    least = stash(at.groupBy("to").agg(F.min("id").alias("component")).coalesce(first), f"{name}-least")
    return stash(at.join(least, "to").select("id", "component").coalesce(first), f"{name}-out")
