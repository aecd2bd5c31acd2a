"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into equal cells; every shard owns virtual nodes on cell borders, and a key belongs to the first
virtual node clockwise. Capacities are the rows divided evenly (counts at most one apart), so keys beyond a full
shard's capacity continue clockwise to the next shard with room. Only counts by cell come to the driver (at most
``cells`` rows), where the overflow is laid out as ranges of ranks; each row then finds its range by its rank in its
cell. No task sees more than a cell, and copies of a text spread over the ring by their ids.

Null texts count as empty; texts of any length are measured whole. Null ids hash to one place, as do rows of one id, whatever
their texts: cells beyond ``part_rows`` rows are ranked in parts, so no task holds more of them. Rows of one place take
ranks in order of text and size; equal rows in any. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, table

BITS = 60


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; a node owns the cells up to its own."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            k = 0
            while (c := int.from_bytes(hashlib.blake2b(f"{s}/{v}/{k}".encode(), digest_size=8).digest(), "big") % cells) in at:
                k += 1
            at[c] = s
    return sorted(at.items())


def layout(counts: dict[int, int], shards: int, nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, first slot): what overflows goes clockwise to the next with room."""
    whole, extra = divmod(sum(counts.values()), shards)
    room = [whole + (s < extra) for s in range(shards)]
    slots = [0] * shards
    ranges: list[tuple[int, int, int, int, int]] = []

    def put(cell: int, lo: int, n: int, s: int) -> int:
        if k := min(n, room[s]):
            ranges.append((cell, lo, lo + k, s, slots[s]))
            slots[s] += k
            room[s] -= k
        return k

    left, j = [], 0
    for cell in sorted(counts):
        while j < len(nodes) and nodes[j][0] < cell:
            j += 1
        own = j % len(nodes)
        if (k := put(cell, 0, counts[cell], nodes[own][1])) < counts[cell]:
            left.append((own, cell, k, counts[cell] - k))
    for own, cell, lo, n in left:
        i = own
        while n:
            i = (i + 1) % len(nodes)
            k = put(cell, lo, n, nodes[i][1])
            lo, n = lo + k, n - k
    return ranges


def by_part(ranges: list[tuple[int, int, int, int, int]], sizes: dict[tuple[int, int], int]) -> list[tuple]:
    """The ranges by (cell, part), with ranks within the part; a cell's parts follow one another."""
    parts: dict[int, list[tuple[int, int]]] = {}
    for (cell, part), n in sorted(sizes.items()):
        parts.setdefault(cell, []).append((part, n))
    out = []
    for cell, lo, hi, s, base in ranges:
        at = 0
        for part, n in parts[cell]:
            a, b = max(lo, at), min(hi, at + n)
            if a < b:
                out.append((cell, part, a - at, b - at, s, base + a - lo))
            at += n
    return out


def shard(docs: DataFrame, shards: int = 24, vnodes: int = 64, cells: int = 1 << 14, part_rows: int = 1 << 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 64 - BITS)
    cell = F.floor(place / F.lit((1 << BITS) // cells)).cast("int")
    counts = {r["cell"]: r["n"] for r in docs.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("place"), cell.alias("cell"))
    parts = {c: -(-n // part_rows) for c, n in counts.items() if n > part_rows}
    if parts:
        # cells of one repeated (or null) id: their rows are numbered once, and dealt to parts that are ranked one by one
        rows = Stash(spark)(rows.withColumn("number", F.monotonically_increasing_id()), "rows")
        of = F.create_map(*(F.lit(x) for c, n in parts.items() for x in (c, n)))[F.col("cell")]
        rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("number"), of).cast("int"), F.lit(0)))
        sizes = rows.where(F.col("cell").isin(*parts)).groupBy("cell", "part").agg(F.count("*").alias("n")).collect()  # the hot cells' parts
    else:
        rows, sizes = rows.withColumn("part", F.lit(0)), []
    dealt = {(c, 0): n for c, n in counts.items() if c not in parts} | {(r["cell"], r["part"]): r["n"] for r in sizes}
    ranges = spark.createDataFrame(by_part(layout(counts, shards, ring(shards, vnodes, cells)), dealt), "cell int, part int, lo long, hi long, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("place", "doc_id", "text_crc32", "size")) - 1
    # ranges has at most cells + shards * vnodes rows, and a row for each part_rows rows of hot cells
    out = rows.withColumn("rank", rank).alias("x").join(F.broadcast(ranges).alias("y"), F.expr("x.cell = y.cell and x.part = y.part and x.rank >= y.lo and x.rank < y.hi"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.expr("base + rank - lo").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
