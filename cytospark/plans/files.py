"""Registered queries over files, keywords, gate documents, hierarchies in memory, streams and plots."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.transforms import from_name
from ..operators import bins as B
from ..operators import compensation as C
from ..operators import events as E
from ..operators import gates as G
from ..operators import hierarchy as H
from ..operators import raster as R
from ..session import shared_dir, ship
from ..sources import fcs, gatingml
from ..sources import keywords as KW
from ..streaming.gating import gated
from .catalogue import CONCAVE, EVENTS, ITEMS, K, events, items, query, read, rounded

# --- FCS files --------------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/fcs-{uuid.uuid4().hex}"


def _written(spark, sf) -> str:
    """The events as a file a type, in two folders, written by the FCS sink."""
    fcs.register(spark)
    e = E.dense_index(events(spark, sf).select(F.col("event_idx").alias("old"), F.concat(F.substring("file", 1, 1), F.lit("/"), "file").alias("file_id"), "value"), "old", "file_id", cell=4096)
    path = _folder(spark)
    df = e.select("file_id", "event_idx", F.col("value").cast("float").alias("VALUE-A"), (F.col("old") % 1000).cast("float").alias("FSC-A"))
    fcs.by_file(df).write.format("fcs").mode("append").save(path)
    return path


_files = f"with {EVENTS}, w as (select file[1] || '/' || file as file_id, event_idx as old, row_number() over (partition by file order by event_idx) - 1 as event_idx, value from e)"


@query(f"{_files} select file_id, event_idx, value::float::double as value, (old % 1000)::double as scatter from w")
def fcs_round_trip(spark, sf):
    """Written, found in folders, headers parsed, data decoded."""
    back = spark.read.format("fcs").load(_written(spark, sf))
    return back.select("file_id", "event_idx", F.col("VALUE-A").cast("double").alias("value"), F.col("FSC-A").cast("double").alias("scatter"))


@query(f"""{_files}, n as (select file_id, count(*) as n from w group by 1)
    select file_id, key, kind, value from n, (values ('$PAR', 'int', '2'), ('$DATATYPE', 'byte', 'F'), ('$BYTEORD', 'byte', '1,2,3,4'), ('$MODE', 'string', 'L'), ('$P1N', 'string', 'VALUE-A'),
      ('$P2N', 'string', 'FSC-A'), ('$P1B', 'int', '32'), ('$P2R', 'int', '262144'), ('$P1E', 'mixed', '0,0')) v(key, kind, value) union all select file_id, '$TOT', 'int', n::varchar from n""")
def fcs_keywords(spark, sf):
    kw, _ = fcs.catalogue(spark, _written(spark, sf))
    return kw.where(F.col("key").isin("$PAR", "$TOT", "$DATATYPE", "$BYTEORD", "$MODE", "$P1N", "$P2N", "$P1B", "$P2R", "$P1E"))


@query(f"{_files} select distinct file_id, number, name, label, transform, 262144.0::double as most from w, (values (1, 'VALUE-A', 'VALUE-A', 'arcsinh'), (2, 'FSC-A', 'FSC-A', 'linear')) v(number, name, label, transform)")
def fcs_parameters(spark, sf):
    _, p = fcs.catalogue(spark, _written(spark, sf))
    return p.select("file_id", "number", "name", "label", "transform", F.col("range").alias("most"))


WIDTHS = (("u2", "<"), ("u4", ">"), ("f4", "<"), ("f8", ">"))


@query("""select kind || case when big then '>' else '<' end as type, (s_suppkey % 60000)::double as a, (s_suppkey % 100)::double as b from supplier,
    (values ('u2', false), ('u4', true), ('f4', false), ('f8', true)) v(kind, big)""")
def fcs_decode(spark, sf):
    """Rows of two parameters of different widths and byte orders, decoded from binary rows."""
    ship(spark)
    keys = F.array(*(F.lit(k + o) for k, o in WIDTHS))
    raw = read(spark, sf, "supplier").select(F.explode(keys).alias("type"), (F.col("s_suppkey") % 60000).alias("a"), (F.col("s_suppkey") % 100).alias("b"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            types, x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for t in np.unique(types):
                at = types == t
                row = np.dtype([("p1", t[-1] + t[:2]), ("p2", t[-1] + "u2")])
                data = np.zeros(at.sum(), row)
                data["p1"], data["p2"] = x[at], y[at]
                cols = fcs.decode(data.tobytes(), row)
                yield pa.record_batch([pa.array([t] * len(data)), *(pa.array(c.astype(float)) for c in cols)], names=["type", "a", "b"])

    return raw.mapInArrow(run, "type string, a double, b double")


VERSIONS = {"FCS1.0": 0, "FCS2.0": 5, "FCS3.0": 12, "FCS3.1": 12, "FCS3.2": 8, "FCS4.0": 11}


@query("select * from (values " + ", ".join(f"('{v}', {n})" for v, n in VERSIONS.items()) + ") v(version, required)")
def fcs_versions(spark, sf):
    return spark.createDataFrame([(v, len(KW.missing(v, {}))) for v in KW.REQUIRED], "version string, required int")


@query("select n_nationkey, n_name as name, 'n' || n_nationkey as id from nation")
def fcs_text(spark, sf):
    """TEXT segments written and read back, and as JSON; names may hold the delimiter."""
    def there(key, name):
        text = "|" + "".join(f"{k}|{v.replace('|', '||')}|" for k, v in (("$FIL", name), ("$SMNO", f"n{key}")))
        return json.loads(KW.as_json(KW.tokenize(text)))

    rows = [(r["n_nationkey"], there(r["n_nationkey"], r["n_name"])) for r in read(spark, sf, "nation").select("n_nationkey", "n_name").collect()]  # 25 nations
    return spark.createDataFrame([(k, t["$FIL"], t["$SMNO"]) for k, t in rows], "n_nationkey int, name string, id string")


# --- compensation by file, scales -------------------------------------------------------------------------------------

SPILLS = {"A": "2,q,p,1,0.0001,25,1", "N": "2,p,q,1,30,0,1"}


@query(f"""with {ITEMS} select file, round(case file when 'A' then (q - 0.0001 * p) / (1 - 0.0001 * 25) when 'N' then q else q end, 6) as q,
    round(case file when 'A' then (p - 25 * q) / (1 - 0.0001 * 25) when 'N' then p - 30 * q else p end, 4) as p from i""")
def comp_by_file(spark, sf):
    """Each file's matrix from its own keywords; a file without one stays."""
    kw = spark.createDataFrame([(f, "$SPILLOVER", v) for f, v in SPILLS.items()], "file_id string, key string, value string")
    df = C.compensate_files(items(spark, sf).select(F.col("file").alias("file_id"), "q", "p"), kw, ["q", "p"])
    return df.select(F.col("file_id").alias("file"), F.round("q", 6).alias("q"), F.round("p", 4).alias("p"))


@query(f"select round(asinh(l_extendedprice * {K!r}), 6) as y from lineitem")
def t_default_biex(spark, sf):
    return rounded(C.default_biexponential(items(spark, sf).select(F.col("p").alias("FL1-A")), ["FL1-A"]).select(F.col("FL1-A").alias("y")))


@query(f"select round(p_size::double, 6) as linear, round(asinh(p_size / 200.0), 6) as arcsinh, round(asinh(p_size * {K!r}), 6) as logicle, round(asinh(p_size / 200.0), 6) as other from part")
def t_by_name(spark, sf):
    x = F.col("p_size").cast("double")
    return rounded(read(spark, sf, "part").select(from_name("Linear").forward(x).alias("linear"), from_name("arcsinh").forward(x).alias("arcsinh"), from_name(" LOGICLE ").forward(x).alias("logicle"), from_name("?").forward(x).alias("other")))


# --- gate documents ---------------------------------------------------------------------------------------------------

XML = """<g:Gating-ML xmlns:g="http://x/gating" xmlns:d="http://x/data">
  <g:RectangleGate g:id="r"><g:dimension g:min="5" g:max="40"><d:parameter d:name="q"/></g:dimension><g:dimension g:min="1000" g:max="60000"><d:parameter d:name="p"/></g:dimension></g:RectangleGate>
  <g:BooleanGate g:id="out"><g:not><g:gateReference g:ref="r"/></g:not></g:BooleanGate></g:Gating-ML>"""
_in = "q >= 5 and q < 40 and p >= 1000 and p < 60000"


@query(f"with {ITEMS} select 'r' as gate, count(*) filter ({_in}) as n from i union all select 'out', count(*) filter (not ({_in})) from i")
def gatingml_counts(spark, sf):
    """Gates of a document: upper sides are outside."""
    gates = G.GateSet(gatingml.read(XML))
    row = items(spark, sf).agg(*(F.count_if(gates.condition(g)).alias(g) for g in ("r", "out")))
    return row.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("n")) for g in ("r", "out")))).alias("x")).select("x.*")


SHAPES = (G.Gate("e", G.Ellipse((25.0, 30000.0), 15.0, 20000.0, 0.0), "q", "p"), G.Gate("c", G.Polygon(CONCAVE), "q", "p"), G.Gate("b", G.Boolean("and", ("e", "n"))), G.Gate("n", G.Boolean("not", ("h",))), G.Gate("h", G.Rectangle((10.5, 0.5), (20.5, 99999.5)), "q", "p"))


@query(f"with {ITEMS}, t as (select *, pow((q - 25) / 15, 2) + pow((p - 30000) / 20000, 2) <= 1 as e, q between 10.5 and 20.5 and p between 0.5 and 99999.5 as h from i) select count(*) filter (e) as e, count(*) filter (e and not h) as b, count(*) filter (h) as h from t")
def gate_json(spark, sf):
    """Gates as JSON and back."""
    gates = G.GateSet([G.from_dict(json.loads(json.dumps(G.to_dict(g)))) for g in SHAPES])
    return items(spark, sf).agg(*(F.count_if(gates.condition(g)).alias(g) for g in ("e", "b", "h")))


@query(f"with {ITEMS} select count(*) filter (q between 5 and 30 and p between 2000 and 50000) as rectangle, count(*) filter (pow((q - 20) / 10, 2) + pow((p - 30000) / 20000, 2) <= 1) as ellipse from i")
def gate_constructors(spark, sf):
    """A rectangle from two corners in any order; an ellipse in the box of two points."""
    gates = G.GateSet([G.Gate("r", G.rectangle_of([(30.0, 2000.0), (5.0, 50000.0)]), "q", "p"), G.Gate("e", G.ellipse_of([(10.0, 10000.0), (30.0, 50000.0)]), "q", "p")])
    return items(spark, sf).agg(F.count_if(gates.condition("r")).alias("rectangle"), F.count_if(gates.condition("e")).alias("ellipse"))


# --- hierarchies in memory --------------------------------------------------------------------------------------------


def _forest(spark, sf) -> H.Hierarchy:
    """Regions over nations: 25 edges."""
    rows = read(spark, sf, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()
    return H.Hierarchy((f"r{r['n_regionkey']}", f"n{r['n_nationkey']}") for r in rows)


@query("""with e as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child, n_regionkey as r, n_nationkey as n from nation),
  m as (select case when r = 1 then 'r0' else parent end as parent, child from e where r <> 2 and not (r = 3)), c as (select 'x' || parent as parent, 'x' || child as child from e where r = 4)
  select parent, child from m union all select parent, child from c""")
def hier_edit(spark, sf):
    """One region's nations move to another, one region is removed, one subtree deleted, one copied."""
    h = _forest(spark, sf)
    for n in h.children("r1"):
        h.reparent("r0", n)
    h.remove("r2")
    h.remove_subtree("r3")
    h.clone_subtree("r4", lambda g: "x" + g)
    h.validate()
    return spark.createDataFrame(h.edges(), "parent string, child string")


@query("""select 'r' || n_regionkey as gate, 0 as depth, min(('r' || n_regionkey)) over () as first from nation group by n_regionkey union all select 'n' || n_nationkey, 1, (select min('r' || n_regionkey) from nation) from nation""")
def hier_order(spark, sf):
    """Parents before children, by depth and depth first."""
    h = _forest(spark, sf)
    order = h.topological()
    assert sorted(order) == sorted(h.depth_first()) and all(order.index(p) < order.index(c) for p, c in h.edges())
    return spark.createDataFrame([(g, h.depth(g), h.depth_first()[0]) for g in order], "gate string, depth int, first string")


# --- streams, plots, panels -------------------------------------------------------------------------------------------


@query("select event_id, value from events where value between 10 and 60 and event_id % 100 between 5 and 50")
def stream_gated(spark, sf):
    """A gate over a stream of the events' file, run until what is there is read."""
    source = spark.readStream.schema(read(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    gates = G.GateSet([G.Gate("g", G.Rectangle((10.0, 5.0), (60.0, 50.0)), "value", "place")])
    path = _folder(spark)
    kept = gated(source.withColumn("place", (F.col("event_id") % 100).cast("double")), gates, "g").select("event_id", "value")
    kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(path)


_jet = R.COLOUR_MAPS["jet"]
_at = lambda i: "list_value(" + ", ".join(str(c[i]) for c in _jet) + ")"
_step = lambda i: f"round({_at(i)}[k + 1] * (1 - (v * 8 - k)) + {_at(i)}[k + 2] * (v * 8 - k))::int"


@query(f"with d as (select p_partkey, p_size / 50.0 as v, least(7, floor(p_size / 50.0 * 8))::int as k from part) select p_partkey, {_step(0)} as r, {_step(1)} as g, {_step(2)} as b from d")
def colour_map(spark, sf):
    rgb = R.colour(F.col("p_size") / 50.0, "jet")
    return read(spark, sf, "part").select("p_partkey", rgb.alias("c")).select("p_partkey", F.col("c")[0].alias("r"), F.col("c")[1].alias("g"), F.col("c")[2].alias("b"))


@query(f"""with {ITEMS}, c as (select greatest(0, least(329, floor(q * (330 / 50.0))))::int as px, greatest(0, least(329, floor(p * (330 / 80000.0))))::int as py, count(*) as n from i group by 1, 2),
    m as (select greatest(1.0, max(log10(n + 1))) as top from c) select px, py, n, round(log10(n + 1) / top, 6) as density from c, m""")
def plot_drawn(spark, sf):
    """A plot's pixels over its drawing area."""
    out = R.Plot("q", "p", (0.0, 50.0), (0.0, 80000.0)).draw(items(spark, sf))
    return out.select("px", "py", "n", F.round("density", 6).alias("density"))


@query(f"""with {EVENTS}, b as (select unnest(range(0, (select (count(*) + 249) // 250 from e))) as bin), x as (select bin, e.* from e join b on event_idx >= bin * 250 and event_idx < bin * 250 + 500),
    a as (select bin, count(*) as n, arg_min(time, event_idx) as t0, arg_max(time, event_idx) as t1, bool_and(value > 0.01) as good from x group by bin)
    select bin, round((t0 + t1) / 2, 3) as mid, round(case when t1 > t0 and n >= 2 then n / (t1 - t0) else 0 end, 6) as rate, good from a""")
def time_panel(spark, sf):
    from .batch import time_panel as panel

    df = panel(events(spark, sf).select("event_idx", "time", (F.col("value") > 0.01).alias("good")), "time", 500)
    return df.select(F.col("bin").cast("long").alias("bin"), F.round("mid", 3).alias("mid"), F.round("rate", 6).alias("rate"), "good")


@query(f"""with {EVENTS}, b as (select unnest(range(0, (select (count(*) + 249) // 250 from e))) as bin), x as (select bin, e.* from e join b on event_idx >= bin * 250 and event_idx < bin * 250 + 500),
    a as (select bin, min(event_idx) as start, max(event_idx) + 1 as "end", count(*) as n, bin % 11 = 3 as tree, bin % 17 = 5 as mad from x group by bin)
    select bin, start, "end", n, tree, mad, tree or mad or bin % 7 = 0 as outlier, bin % 7 = 0 and not tree and not mad as consecutive from a""")
def bin_report(spark, sf):
    """Which steps flagged each bin."""
    from .batch import bin_report as told

    e = events(spark, sf).select("event_idx")
    flags = B.assign(e, 500).select("bin").distinct().selectExpr("bin", "bin % 11 = 3 as tree", "bin % 17 = 5 as mad", "bin % 11 = 3 or bin % 17 = 5 or bin % 7 = 0 as bad")
    out = told(e, flags, 500)
    return out.select(F.col("bin").cast("long").alias("bin"), "start", "end", "n", "tree", "mad", "outlier", "consecutive")
