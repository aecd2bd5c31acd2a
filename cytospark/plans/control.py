"""Acquisition quality control over a file's events, and the registered queries of its steps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QcError
from ..operators import bins as B
from ..operators import events as E
from ..operators import outliers as O
from ..operators import peaks as K
from ..operators import trend as T
from ..session import beside, grouped, ship, written
from .catalogue import EVENTS, ORACLE, QUERIES, events, query, rounded  # noqa: F401


@dataclass(frozen=True)
class Config:
    channels: tuple[str, ...]
    mode: str = "all"  # all, tree, mad or none
    per_bin: int | None = None
    min_cells: int = 150
    max_bins: int = 500
    force_tree: int = 150
    tree_limit: float = 0.6
    mad: float = 6.0
    consecutive: int = 5
    removal: float = 1 / 3
    least_percent: float = 10.0
    remove_zeros: bool = False
    by: tuple[str, ...] = field(default_factory=tuple)


def binned_long(df: DataFrame, channels, per_bin: int | Column, *by: str) -> DataFrame:
    """by, bin, channel, value: all channels in one table, so that one job finds all peaks."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"`{c}`").cast("double").alias("value")) for c in channels)))
    bins = B.covering(F.col("event_idx"), per_bin)
    x = df.select(*by, *(f"`{c}`" for c in channels), F.explode(bins).alias("bin"))
    return x.select(*by, "bin", pairs.alias("p")).select(*by, "bin", "p.*")


def found_peaks(long: DataFrame, config: Config, *by: str) -> DataFrame:
    return K.bin_peaks(long, *by, "bin", "channel", removal=config.removal, remove_zeros=config.remove_zeros)


def sized(df: DataFrame, sizes: DataFrame, config: Config) -> tuple[DataFrame, int | Column]:
    """df and the events a bin: the given number, or a column per_bin_, of sizes, of each file's own."""
    if config.per_bin:
        return df, config.per_bin
    return beside(df, sizes.select(*config.by, "per_bin_"), *config.by), F.col("per_bin_")


def bin_verdicts(df: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(by, bin, tree, mad, bad) of every bin, and (by, n, per_bin_) of every file: its events, and those a bin."""
    if not config.channels:
        raise QcError("no channels")
    by = list(config.by)
    sizes = grouped(df.groupBy(*by).agg((F.max("event_idx") + 1).alias("n")), "sizes", *by)
    if not sizes.agg(F.max("n")).first()[0]:
        raise QcError("no events")
    if config.per_bin:
        B.bin_step(config.per_bin)
    per_bin = F.lit(config.per_bin).cast("long") if config.per_bin else B.bin_sizes(F.col("n"), config.min_cells, config.max_bins)
    sizes = sizes.withColumn("per_bin_", per_bin)
    n_bins = sizes.select(*by, F.ceil(F.col("n") / B.bin_step(F.col("per_bin_"))).cast("long").alias("n_bins"))
    df, per_bin = sized(df, sizes, config)
    peaks = found_peaks(binned_long(df, config.channels, per_bin, *by), config, *by)
    # features and verdicts have a row a bin at most times clusters: written, as each is used several times
    feats = written(K.features(peaks, n_bins, config.least_percent, 0.5, "channel", *by), "features")
    bins = n_bins.select(*by, F.explode(F.sequence(F.lit(0), F.col("n_bins").cast("int") - 1)).alias("bin"))
    none = F.lit(False)
    tree = O.tree_bins(feats, config.tree_limit, config.force_tree, *by) if config.mode in ("all", "tree") else bins.withColumn("bad", none)
    bins = written(bins.join(tree.withColumnRenamed("bad", "tree"), [*by, "bin"], "left").fillna(False, ["tree"]), "tree")
    if config.mode in ("all", "mad"):
        kept = feats.join(bins.where("not tree").select(*by, "bin"), [*by, "bin"], "left_semi")
        far = O.mad_bins(written(O.smoothed(kept, 0.5, *by), "smoothed"), config.mad, *by).groupBy(*by, "bin").agg(F.bool_or("bad").alias("mad"))
        bins = bins.join(far, [*by, "bin"], "left").fillna(False, ["mad"])
    else:
        bins = bins.withColumn("mad", none)
    bins = bins.withColumn("bad", F.col("tree") | F.col("mad"))
    bins = bins if config.mode == "none" else B.remove_short_runs(bins, "bad", "bin", config.consecutive, *by)
    return written(bins, "bins"), sizes


def quality_control(df: DataFrame, config: Config) -> DataFrame:
    """df with good: events that no bad bin covers. df needs event_idx, dense from 0 within each file (config.by)."""
    bins, sizes = bin_verdicts(df, config)
    df, per_bin = sized(df, sizes, config)
    return B.event_mask(df, bins.where("bad"), per_bin, "event_idx", *config.by).drop("per_bin_")


# --- queries ----------------------------------------------------------------------------------------------------------

PER = 500


def bins_sql(per: int) -> str:
    """b: the bins of per events, half overlapping; x: events by bin."""
    step = per // 2
    return f"b as (select unnest(range(0, (select (count(*) + {step - 1}) // {step} from e))) as bin), x as (select bin, e.* from e join b on event_idx >= bin * {step} and event_idx < bin * {step} + {per})"


BINS = bins_sql(PER)
KDE = """s as (select bin, count(*) as n, min(value) as mn, max(value) as mx, stddev_pop(value) as sd from x group by bin),
  r as (select bin, value, row_number() over (partition by bin order by value) - 1 as k from x),
  q as (select r.bin, max(value) filter (k = 3 * n // 4) - max(value) filter (k = n // 4) as iqr from r join s using (bin) group by r.bin),
  w as (select s.*, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) as bw from s join q using (bin)),
  g as (select *, mn - 3 * bw as g0, ((mx + 3 * bw) - (mn - 3 * bw)) / 511 as dx from w),
  c as (select x.bin, floor((value - g0) / dx)::int as j, count(*) as cnt from x join g using (bin) group by 1, 2),
  y as (select g.bin, i, g0 + i * dx as gx, sum(cnt * exp(-0.5 * pow((i - j + 0.5) * dx / bw, 2))) / sqrt(2 * pi()) / (any_value(n) * any_value(bw)) as density
    from g, (select unnest(range(512)) as i) t join c on true where c.bin = g.bin group by g.bin, i, g0 + i * dx),
  l as (select *, lag(density) over v as a, lead(density) over v as z, max(density) over (partition by bin) as top from y window v as (partition by bin order by i)),
  pk as (select bin, gx as peak_value from l where density > a and density > z and density > top / 3),
  peaks as (select bin, peak_value from pk union all (select bin, max(gx) from l where density = top and bin not in (select bin from pk) group by bin))"""
CLUSTER = """per as (select bin, count(*) as k from peaks group by bin), nb as (select count(*) as n_bins from b),
  freq as (select k, count(*) as f from per group by k),
  ref as (select coalesce((select max(k) from freq, nb where f >= ceil(0.1 * n_bins)), 1) as ref),
  o as (select *, row_number() over (partition by bin order by peak_value) as pos from peaks),
  med as (select pos, median(peak_value) as m from o join per using (bin), ref where k = ref group by pos),
  near as (select bin, peak_value, pos, row_number() over (partition by bin, peak_value order by abs(peak_value - m), pos) as rk from peaks, med),
  cl as (select bin, peak_value, pos::int as cluster from near where rk = 1),
  big as (select cluster from cl, nb group by cluster, n_bins having count(distinct bin) >= ceil(n_bins * 0.5)),
  kept as (select * from cl where cluster in (select cluster from big))"""
FEATURES = """cm as (select cluster, median(peak_value) as med from kept group by cluster),
  feat as (select b.bin, cm.cluster, coalesce(max(kept.peak_value), any_value(med)) as value from b cross join cm left join kept on kept.bin = b.bin and kept.cluster = cm.cluster group by b.bin, cm.cluster)"""
CHAIN = f"with {EVENTS}, {BINS}, {KDE}, {CLUSTER}, {FEATURES}"
FINE = f"with recursive {EVENTS}, {bins_sql(100)}, {KDE}, {CLUSTER}, {FEATURES}"
#: The banded system of the spline (p = 1/2: penalty 1) solved by recursion: Cholesky downwards, then back upwards.
SPLINE = """tr as (select cluster, bin, value as y, row_number() over (partition by cluster order by bin) - 1 as i, count(*) over (partition by cluster) as n from feat),
  rh as (select a.cluster, a.i, a.n - 2 as m, a.y - 2 * b.y + c.y as r from tr a join tr b on b.cluster = a.cluster and b.i = a.i + 1 join tr c on c.cluster = a.cluster and c.i = a.i + 2),
  fw as (select cluster, i, m, sqrt(2.0 / 3 + 6)::double as l, 0::double as l1, 0::double as a, 0::double as b, r / sqrt(2.0 / 3 + 6)::double as z, 0::double as z1 from rh where i = 0
    union all select cluster, i, m, sqrt(2.0 / 3 + 6 - na * na - nb * nb), l, na, nb, (r - na * z - nb * z1) / sqrt(2.0 / 3 + 6 - na * na - nb * nb), z
    from (select rh.cluster, rh.i, rh.m, rh.r, fw.l, fw.z, fw.z1, case when rh.i > 1 then 1 / fw.l1 else 0 end as nb, (1.0 / 6 - 4 - case when rh.i > 1 then 1 / fw.l1 * fw.a else 0 end) / fw.l as na
      from fw join rh on rh.cluster = fw.cluster and rh.i = fw.i + 1)),
  bk as (select cluster, i, z / l as g, 0::double as g1 from fw where i = m - 1
    union all select f.cluster, f.i, (f.z - f1.a * bk.g - coalesce(f2.b, 0) * bk.g1) / f.l, bk.g from bk join fw f on f.cluster = bk.cluster and f.i = bk.i - 1
      join fw f1 on f1.cluster = f.cluster and f1.i = f.i + 1 left join fw f2 on f2.cluster = f.cluster and f2.i = f.i + 2),
  sp as (select tr.cluster, tr.bin, tr.n, tr.y - (coalesce(a.g, 0) - 2 * coalesce(b.g, 0) + coalesce(c.g, 0)) as smooth from tr left join bk a on a.cluster = tr.cluster and a.i = tr.i
    left join bk b on b.cluster = tr.cluster and b.i = tr.i - 1 left join bk c on c.cluster = tr.cluster and c.i = tr.i - 2)"""


def far_sql(threshold: float) -> str:
    return f"""md as (select cluster, median(smooth) as med, mad(smooth) * 1.4826 as dev from sp group by cluster),
  far as (select cluster, bin, n >= 3 and dev > 0 and abs(smooth - med) > {threshold} * dev as bad from sp join md using (cluster))"""


#: The isolation tree node by node: the open node of greatest number is cut where the gain is greatest (last cluster and
#: last cut on ties), if that reaches every gain accepted before; bins outside the largest leaf (last on ties) are bad.
TREE = """tree as (select 0 as it, bin, 0 as node, true as open, 0 as depth, 0.6::double as lim, 1 as number, (count(*) over ())::bigint as n from (select distinct bin from feat)
    union all
    select it + 1, bin, case when node = pick and ok then case when goes then number else number + 1 end else node end, case when node = pick then ok else open end, depth + (node = pick and ok)::int,
      case when ok then gain else lim end, case when ok then number + 2 else number end, n
    from (select p.*, side.goes, best.gain, coalesce(best.gain >= lim and best.m > 3 and best.gone < best.m and best.depth < ceil(log2(n)), false) as ok
      from (select *, max(case when open then node end) over () as pick from tree) p
      left join (select c.*, count(*) filter (f.value <= c.v) as gone from
          (select cluster, v, m, depth, (sd - (lo + hi) / 2) / sd as gain from
            (select f.cluster, f.value as v, q.depth, row_number() over o as k, count(*) over (partition by f.cluster) as m, stddev_samp(f.value) over (partition by f.cluster) as sd,
              coalesce(stddev_samp(f.value) over (o rows unbounded preceding), 0) as lo, coalesce(stddev_samp(f.value) over (o rows between 1 following and unbounded following), 0) as hi
              from (select *, max(case when open then node end) over () as pick from tree) q join feat f on f.bin = q.bin where q.node = q.pick window o as (partition by f.cluster order by f.value, f.bin))
            where k < m and sd > 0 order by round(gain, 12) desc, cluster desc, k desc limit 1) c
          join feat f on f.cluster = c.cluster join (select *, max(case when open then node end) over () as pick from tree) q on q.bin = f.bin and q.node = q.pick group by all) best on true
      left join (select bin, cluster, value from feat) fv on fv.bin = p.bin and fv.cluster = best.cluster
      left join lateral (select fv.value <= best.v as goes) side on true
      where p.pick is not null)),
  leaf as (select bin, node, n, count(*) over (partition by node) as size from tree where it = (select max(it) from tree)),
  tb as (select bin, n >= 150 and node <> (select node from leaf order by size desc, node desc limit 1) as bad from leaf)"""


def _long(spark, sf, per: int = PER) -> DataFrame:
    return binned_long(events(spark, sf).select("event_idx", "value"), ["value"], per)


def _n_bins(spark, sf, per: int = PER) -> DataFrame:
    return events(spark, sf).agg(F.ceil((F.max("event_idx") + 1) / B.bin_step(per)).cast("long").alias("n_bins"))


def _features(spark, sf, per: int = PER) -> DataFrame:
    return K.features(found_peaks(_long(spark, sf, per), Config(("value",))), _n_bins(spark, sf, per))


def _smoothed(spark, sf, per: int) -> DataFrame:
    return written(O.smoothed(_features(spark, sf, per)), "smoothed")


@query("select greatest(150, (ceil(2 * count(*) / 500.0)::bigint // 500) * 500 + 500) as per_bin from events")
def bin_size(spark, sf):
    n = events(spark, sf).count()
    return spark.createDataFrame([(B.events_per_bin(n),)], "per_bin long")


@query(f"with {EVENTS}, {BINS} select bin, count(*) as n, min(event_idx) as first, max(event_idx) as last from x group by bin")
def bins_assign(spark, sf):
    x = B.assign(events(spark, sf).select("event_idx"), PER)
    return x.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("event_idx").alias("first"), F.max("event_idx").alias("last"))


@query("select (event_id // 500)::int as bin, round(median(value), 6) as median from events group by 1")
def bin_medians(spark, sf):
    return rounded(B.bin_medians(events(spark, sf), "value", PER))


_rate = f"""with {EVENTS}, {BINS}, a as (select bin, count(*) as n, arg_min(time, event_idx) as t0, arg_max(time, event_idx) as t1 from x group by bin)"""


@query(f"{_rate} select bin, n, round(case when t1 > t0 and n >= 2 then n / (t1 - t0) else 0 end, 6) as rate, round((t0 + t1) / 2, 3) as mid from a")
def bin_rate(spark, sf):
    x = B.assign(events(spark, sf).select("event_idx", "time"), PER)
    return B.bin_rates(x, "time").select(F.col("bin").cast("long").alias("bin"), "n", F.round("rate", 6).alias("rate"), F.round("mid", 3).alias("mid"))


def _flagged(spark, sf, per: int = PER) -> DataFrame:
    """Bins whose number follows a fixed rule, as verdicts."""
    n = _n_bins(spark, sf, per)
    return n.select(F.explode(F.sequence(F.lit(0), F.col("n_bins").cast("int") - 1)).alias("bin")).withColumn("bad", F.expr("bin % 11 = 3 or bin % 17 in (5, 6)"))


_flags = f"with {EVENTS}, {BINS}, f as (select bin, bin % 11 = 3 or bin % 17 in (5, 6) as bad from b)"
_runs = f"""{_flags}, ch as (select *, case when lag(bad) over (order by bin) is not distinct from bad then 0 else 1 end as c from f),
  ru as (select *, sum(c) over (order by bin) as run from ch), le as (select *, count(*) over (partition by run) as len, min(bin) over (partition by run) as b0, max(bin) over (partition by run) as b1,
    min(bin) over () as m0, max(bin) over () as m1 from ru),
  sr as (select bin, bad or (not bad and len < 5 and b0 > m0 and b1 < m1) as bad from le)"""


@query(f"{_runs} select bin, bad from sr")
def short_runs(spark, sf):
    return B.remove_short_runs(_flagged(spark, sf)).select(F.col("bin").cast("long").alias("bin"), "bad")


@query(f"{_flags} select event_idx, not bool_or(bad) as good from x join f using (bin) group by event_idx")
def bins_to_events(spark, sf):
    return B.event_mask(events(spark, sf).select("event_idx"), _flagged(spark, sf).where("bad"), PER).select("event_idx", "good")


@query(f"""{_flags}, ev as (select event_idx, bool_or(bad) as bad from x join f using (bin) group by event_idx),
  isl as (select event_idx, event_idx - row_number() over (order by event_idx) as g from ev where bad) select min(event_idx) as start, max(event_idx) as "end", count(*) as n from isl group by g""")
def unstable_regions(spark, sf):
    return B.unstable_regions(bins_to_events(spark, sf))


@query(f"{_rate}, f as (select bin, bin % 11 = 3 or bin % 17 in (5, 6) as bad from b) select bad, count(*) as bins, round(avg(case when t1 > t0 and n >= 2 then n / (t1 - t0) else 0 end), 6) as rate, sum(n)::bigint as n from a join f using (bin) group by bad")
def bin_debug(spark, sf):
    x = B.bin_rates(B.assign(events(spark, sf).select("event_idx", "time"), PER), "time").join(_flagged(spark, sf), "bin")
    return x.groupBy("bad").agg(F.count(F.lit(1)).alias("bins"), F.round(F.avg("rate"), 6).alias("rate"), F.sum("n").alias("n"))


@query(f"with {EVENTS}, {BINS}, {KDE} select bin, i, round(gx, 6) as x, round(density, 9) as density from y")
def kde_density(spark, sf):
    d = K.densities(_long(spark, sf), "bin")
    return d.select(F.col("bin").cast("long").alias("bin"), F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query(f"with {EVENTS}, {BINS}, {KDE} select bin, round(peak_value, 6) as peak_value from peaks")
def kde_peaks(spark, sf):
    return K.bin_peaks(_long(spark, sf), "bin").select(F.col("bin").cast("long").alias("bin"), F.round("peak_value", 6).alias("peak_value"))


@query(f"{CHAIN} select bin, round(peak_value, 6) as peak_value, cluster from kept")
def peak_clusters(spark, sf):
    p = K.cluster_peaks(found_peaks(_long(spark, sf), Config(("value",))), _n_bins(spark, sf))
    return p.select(F.col("bin").cast("long").alias("bin"), F.round("peak_value", 6).alias("peak_value"), "cluster")


@query(f"{CHAIN} select bin, cluster, round(value, 6) as value from feat")
def peak_features(spark, sf):
    return _features(spark, sf).select(F.col("bin").cast("long").alias("bin"), "cluster", F.round("value", 6).alias("value"))


@query(f"""with m as (select (event_id // 500)::int as bin, round(median(value), 6) as v from events group by 1),
  w as (select v, row_number() over (order by v, bin) as k, count(*) over () as n, stddev_samp(v) over () as sd,
    coalesce(stddev_samp(v) over (order by v, bin rows unbounded preceding), 0) as l,
    coalesce(stddev_samp(v) over (order by v, bin rows between 1 following and unbounded following), 0) as r from m),
  g as (select v, k, (sd - (l + r) / 2) / sd as gain from w where k < n)
  select v as split, round(gain, 6) as gain from g order by g.gain desc, k desc limit 1""")
def tree_best_split(spark, sf):
    m = B.bin_medians(events(spark, sf), "value", PER).select(F.round("median", 6).alias("value"))

    ship(spark)

    def run(frames):
        import pandas as pd

        v = pd.concat(list(frames))["value"].to_numpy()
        got = O.best_split(v, 0.0) if len(v) else None
        if got:
            yield pd.DataFrame({"split": [got[1]], "gain": [round(got[0], 6)]})

    return m.coalesce(1).mapInPandas(run, "split double, gain double")  # medians of one file's bins


@query("select n, round(case when n <= 1 then 0 when n = 2 then 1 else 2 * (ln(n - 1) + 0.5772156649) - 2 * (n - 1) / n end, 6) as length from (select distinct p_size as n from part)")
def avg_path_len(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").alias("n")).distinct()
    return p.select("n", F.round(O.average_path_length(F.col("n")), 6).alias("length"))


@query(f"{FINE}, {TREE} select bin::int as bin, bad from tb")
def iso_tree_bins(spark, sf):
    return O.tree_bins(_features(spark, sf, 100), force=150)


@query(f"{FINE}, {SPLINE} select bin, cluster, round(smooth, 6) as smooth from sp")
def spline_smooth(spark, sf):
    return _smoothed(spark, sf, 100).select(F.col("bin").cast("long").alias("bin"), "cluster", F.round("smooth", 6).alias("smooth"))


@query(f"{FINE}, {SPLINE}, {far_sql(2.0)} select bin, cluster, bad from far")
def mad_bins(spark, sf):
    return O.mad_bins(_smoothed(spark, sf, 100), 2.0).select(F.col("bin").cast("long").alias("bin"), "cluster", "bad")


#: Verdicts of bins: by the tree, beyond MAD in any cluster of the others, then short runs of good ones.
VERDICTS = f"""{FINE}, {TREE}, kf as (select feat.* from feat join tb using (bin) where not bad), {SPLINE.replace("from feat", "from kf")}, {far_sql(6.0)},
  f as (select b.bin, coalesce(any_value(tb.bad), false) as tree, coalesce(bool_or(far.bad), false) as mad from b left join tb on tb.bin = b.bin left join far on far.bin = b.bin group by b.bin),
  ch as (select *, case when lag(tree or mad) over (order by bin) is not distinct from (tree or mad) then 0 else 1 end as c from f), ru as (select *, sum(c) over (order by bin) as run from ch),
  le as (select *, count(*) over (partition by run) as len, min(bin) over (partition by run) as b0, max(bin) over (partition by run) as b1, min(bin) over () as m0, max(bin) over () as m1 from ru),
  sr as (select bin, tree, mad, tree or mad or (len < 5 and b0 > m0 and b1 < m1) as bad from le), ev as (select event_idx, not bool_or(sr.bad) as good from x join sr using (bin) group by event_idx)"""


@query(f"{VERDICTS} select event_idx, good from ev")
def qc_full(spark, sf):
    df = events(spark, sf).select("event_idx", "value", F.col("time").cast("double").alias("time"))
    return quality_control(df, Config(("value",), per_bin=100)).select("event_idx", "good")


_meds = "m as (select (event_id // 500)::int as bin, median(value) as v from events group by 1)"


@query(f"""with {_meds}, s as (select a.bin, sum(b.v * exp(-0.5 * pow((a.bin - b.bin) / 50.0, 2))) / sum(exp(-0.5 * pow((a.bin - b.bin) / 50.0, 2))) as smooth from m a, m b group by a.bin),
  u as (select abs(max(smooth) over w - smooth) < 1e-10 as up, abs(min(smooth) over w - smooth) < 1e-10 as down from s window w as (order by bin rows unbounded preceding))
  select count(*) filter (up) as rising, count(*) filter (down) as falling, count(*) as n,
    case when count(*) filter (up) > 0.75 * count(*) then 'increasing' when count(*) filter (down) > 0.75 * count(*) then 'decreasing' else 'none' end as trend from u""")
def monotonic(spark, sf):
    return T.monotonic(T.kernel_smooth(B.bin_medians(events(spark, sf), "value", PER)))


@query(f"""with {_meds}, a as (select rank() over (order by bin) + (count(*) over (partition by bin) - 1) / 2.0 as ra, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as rb from m)
  select round(1 - 6 * sum(pow(ra - rb, 2)) / (count(*) * (count(*) * count(*) - 1)), 6) as rho from a""")
def spearman(spark, sf):
    return rounded(T.spearman(B.bin_medians(events(spark, sf), "value", PER), "bin", "median"))


@query(f"""{VERDICTS}, pc as (select count(*) as n_bins, count(*) filter (tree) * 100.0 / count(*) as tree_percent, count(*) filter (tree or mad) * 100.0 / count(*) as mad_percent from sr),
  rm as (select count(*) as n_events, count(*) filter (not good) * 100.0 / count(*) as removed_percent from ev)
  select n_bins, round(tree_percent, 6) as tree_percent, round(mad_percent, 6) as mad_percent, n_events, round(removed_percent, 6) as removed_percent, 100 as events_per_bin,
    round(removed_percent - mad_percent, 6) as consecutive_percent from pc, rm""")
def qc_summary(spark, sf):
    from .batch import summary

    return rounded(summary(events(spark, sf).select("event_idx", "value"), Config(("value",), per_bin=100)))


@query(f"""with {EVENTS}, s as (select file, max(event_idx) + 1 as n from (select file, row_number() over (partition by file order by event_idx) - 1 as event_idx from e) group by file),
  p as (select *, greatest(150, (ceil(2 * n / 500.0)::bigint // 500) * 500 + 500) as per from s) select file, n, per as events_per_bin, ceil(n / (per // 2))::bigint as n_bins from p""")
def bin_size_by_file(spark, sf):
    """Every file has the bins of its own events."""
    e = E.dense_index(events(spark, sf).select(F.col("event_idx").alias("old"), "file"), "old", "file", cell=4096)
    n = e.groupBy("file").agg((F.max("event_idx") + 1).alias("n")).withColumn("events_per_bin", B.bin_sizes(F.col("n")))
    return n.withColumn("n_bins", F.ceil(F.col("n") / B.bin_step(F.col("events_per_bin"))).cast("long"))


@query(f"{FINE}, {SPLINE}, {far_sql(2.0)}, pr as (select cluster, count(*) filter (bad) * 100.0 / count(*) as percent from far group by cluster) select 'value' as channel, round(sum(percent), 6) as percent from pr")
def mad_contribution(spark, sf):
    from .batch import mad_contribution as contribution

    return rounded(contribution(O.mad_bins(_smoothed(spark, sf, 100), 2.0)))
