"""Mixing sources to target weights by hash thresholds.

Targets are water-filled: shares by weight, none above ``most`` times its source's size, the excess reshared. A target
is a number of whole passes over the source and one partial pass; a document is in the partial pass if its hash is
below its source's threshold. Thresholds come from histograms: tokens summed by (source, hash bucket), the bucket where
the running sum crosses the budget found per source, and only that bucket divided again, until it holds one hash. No
row is sorted, sources never meet in one task, and equal hashes are taken or left together, so reruns agree.

Null text has size 0, a null source is a source of its own (last). Rows with equal ids share a hash, whatever their texts,
and are taken or left together; null ids share the least hash. Texts of any length are read whole. One row a source comes
to the driver: the number of source names, not of documents, must fit there. An empty table gives an empty result. Extra
columns of any names pass through ``mix`` and ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, n_words, table

BITS, STEP = 60, 10
WEIGHTS = (3, 1, 2)


def water_fill(sizes: list[int], weights: list[int], budget: float, most: float) -> list[float]:
    """Shares of the budget by weight, none above most times its size; the excess is reshared by weight."""
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = budget
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(most * sizes[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def plan(sized: DataFrame, stash: Stash, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """sized has source, size, h (hash of BITS bits). One row a source: source_size, target, passes, threshold."""
    spark = sized.sparkSession
    # one row a source comes to the driver: as many as there are names of sources
    sums = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted((s for s in sums if s is not None)) + [None] * (None in sums)
    sizes = [sums[s] for s in names]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), most)
    rows = [(s, n, t, int(t // n) if n else 0, int(t - (t // n) * n) if n else 0) for s, n, t in zip(names, sizes, targets, strict=True)]
    at = spark.createDataFrame(rows, "source string, source_size long, target double, passes int, budget long")
    # lo: hashes below it are taken; [lo, lo + 2^bits) holds the crossing; need: tokens still wanted from it
    at = at.withColumns({"lo": F.lit(0).cast("long"), "need": F.col("budget"), "bits": F.lit(BITS), "done": F.col("budget") == 0})
    for k in range(BITS // STEP):
        bits = BITS - STEP * (k + 1)
        open_ = at.where("not done").select("source", "lo")
        x = sized.alias("x").join(open_.alias("y"), F.expr(f"x.source <=> y.source and shiftright(x.h, {bits + STEP}) = shiftright(y.lo, {bits + STEP})"))
        hist = x.select("x.source", F.expr(f"shiftright(h, {bits})").alias("b"), "size", "h").groupBy("source", "b").agg(F.sum("size").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        w = Window.partitionBy("source").orderBy("b")
        run = hist.withColumn("before", F.sum("n").over(w) - F.col("n"))
        j = run.alias("r").join(at.alias("a"), F.expr("r.source <=> a.source and before <= need and before + n > need"))
        cross = j.select(F.col("a.source").alias("source"), F.expr(f"shiftleft(b, {bits})").alias("lo2"), F.expr("need - before").alias("need2"), "n", F.expr("h0 = h1").alias("one"), "h0")
        j = at.alias("a").join(cross.alias("c"), F.expr("a.source <=> c.source"), "left")
        # a bucket of one hash is taken if that comes nearer the target than leaving it
        whole = F.expr("one and n - need2 < need2")
        at = j.select(
            "a.source", "source_size", "target", "passes", "budget",
            F.when(F.col("lo2").isNull() | F.col("done"), F.col("lo")).when(F.col("one"), F.when(whole, F.col("h0") + 1).otherwise(F.col("h0"))).otherwise(F.col("lo2")).alias("lo"),
            F.when(F.col("lo2").isNull() | F.col("done"), F.col("need")).otherwise(F.col("need2")).alias("need"), "bits",
            (F.col("done") | F.coalesce("one", F.lit(True))).alias("done"),
        )
        at = stash(at, f"mix-{k}")
        if at.where("not done").isEmpty():
            break
    return at.select("source", "source_size", "target", "passes", F.col("lo").alias("threshold"))


def hashed(docs: DataFrame, *keep: Column) -> DataFrame:
    """keep, source, h (hash of the id), size (words)."""
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, BITS // 4), 16, 10).cast("long")
    return docs.select(*keep, "source", F.coalesce(h, F.lit(0).cast("long")).alias("h"), n_words(F.col("text")).alias("size"))


def mix(docs: DataFrame, stash: Stash) -> DataFrame:
    """row (the document's columns, of any names), size, copies, source_size, target of every document."""
    sized = stash(hashed(docs), "mix-sized")
    # the plan has one row a source; Spark broadcasts it while it is small, else joins by a shuffle it can split
    at = plan(sized, stash)
    out = hashed(docs, F.struct(*docs.columns).alias("row")).alias("x").join(at.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")), "left")
    copies = F.col("passes") + (F.col("h") < F.col("threshold")).cast("int")
    return out.select("row", "size", copies.alias("copies"), "source_size", "target")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(docs, Stash(spark))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def take(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it."""
    out = mix(docs, Stash(spark)).where("copies > 0")
    return out.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


#: The same by running sums in hash order: a document is in the partial pass if the sum up to its hash ends nearer the
#: budget with it than without.
ORACLE_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as h from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) nulls last) - 1 as i from d group by source),
w as (select *, case i % 3 when 0 then 3 when 1 then 1 else 2 end as weight, 1.5::double * sum(source_size) over () as budget from s),
r as (
  select *, 2.0 * source_size / weight as ratio from w where source_size > 0),
f as (
  select *, budget - coalesce(sum(2.0 * source_size) over (order by ratio, i rows between unbounded preceding and 1 preceding), 0) as room,
    sum(weight) over (order by ratio, i rows between current row and unbounded following) as rest from r),
cut as (select room, rest, ratio, i from f where room * weight / rest <= 2.0 * source_size order by ratio, i limit 1),
t as (
  select w.source, w.source_size,
    case when w.source_size = 0 then 0.0
         when cut.i is null or 2.0 * w.source_size / w.weight < cut.ratio or (2.0 * w.source_size / w.weight = cut.ratio and w.i < cut.i) then 2.0 * w.source_size
         else cut.room * w.weight / cut.rest end::double as target
  from w left join cut on true),
p as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as passes from t),
b as (select *, floor(target - passes * source_size)::bigint as part from p),
g as (select source, h, sum(size)::bigint as n from d group by source, h),
c as (
  select g.source, g.h, n, sum(n) over (partition by g.source order by h rows unbounded preceding) - n as before from g)
select d.doc_id, d.size, b.source_size, b.target,
  (d.size * (b.passes + case when c.before + c.n <= b.part or (c.before <= b.part and c.before + c.n - b.part < b.part - c.before) then 1 else 0 end))::bigint as taken
from d join b on d.source is not distinct from b.source join c on c.source is not distinct from d.source and c.h = d.h
"""
