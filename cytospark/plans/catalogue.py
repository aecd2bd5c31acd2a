"""Registered queries over scalar, gate, hierarchy, statistics and raster operators, each with its SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.transforms import Arcsinh, Area, Biexponential, Linear, apply, from_pixel, is_fluorescence, nice_number, short_exponent, to_pixel
from ..operators import compensation as C
from ..operators import events as E
from ..operators import exports as X
from ..operators import gates as G
from ..operators import hierarchy as H
from ..operators import outliers as O
from ..operators import raster as R
from ..operators import stats as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark, sf) -> DataFrame:
    """lineitem as a file of four detectors."""
    return read(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("file"))


def events(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_id").alias("event_idx"), F.col("value"), F.col("event_type").alias("file"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6).alias("time"))


ITEMS = "i as (select l_quantity q, l_extendedprice p, l_discount d, l_tax t, l_returnflag file from lineitem)"
EVENTS = "e as (select event_id as event_idx, value, event_type as file, epoch_us(ts) / 1e6 as time from events)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("double", "float")})


# --- transforms -------------------------------------------------------------------------------------------------------

K = math.sinh(4.5 * math.log(10)) / 262144.0


@query("select l_extendedprice as y from lineitem")
def t_linear(spark, sf):
    return items(spark, sf).select(Linear().forward(F.col("p")).alias("y"))


@query("select round(asinh(l_extendedprice / 200), 6) as y, round(asinh(l_quantity / 5), 6) as z from lineitem")
def t_arcsinh(spark, sf):
    df = apply(items(spark, sf), {"p": Arcsinh(200), "q": Arcsinh(5)})
    return rounded(df.select(F.col("p").alias("y"), F.col("q").alias("z")))


@query("select round(sinh(l_discount * 10) * 200, 6) as y from lineitem")
def t_arcsinh_inverse(spark, sf):
    return rounded(items(spark, sf).select(Arcsinh(200).inverse(F.col("d") * 10).alias("y")))


@query(f"select round(asinh(l_extendedprice * {K!r}), 6) as y from lineitem")
def t_biex(spark, sf):
    return rounded(items(spark, sf).select(Biexponential().forward(F.col("p")).alias("y")))


@query(f"select round({1 / K!r} * sinh(l_discount * 50), 6) as y from lineitem")
def t_biex_inverse(spark, sf):
    return rounded(items(spark, sf).select(Biexponential().inverse(F.col("d") * 50).alias("y")))


@query(r"""select regexp_replace(regexp_replace(printf('%.1e', l_extendedprice + 0.001), 'e\+0*(\d+)$', 'e\1'), 'e-0*(\d+)$', 'e-\1') as label,
    count(*) as n from lineitem group by 1""")
def t_format(spark, sf):
    return items(spark, sf).groupBy(short_exponent(F.col("p") + 0.001).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""select file, round(avg(asinh(p / 2000)), 6) as p, round(avg(asinh(q / 2000)), 8) as q from (select l_extendedprice p, l_quantity q, l_returnflag file from lineitem) group by file""")
def t_default_arcsinh(spark, sf):
    df = C.preprocess(items(spark, sf).select("p", "q", "file"), channels=["p", "q"])
    return df.groupBy("file").agg(F.round(F.avg("p"), 6).alias("p"), F.round(F.avg("q"), 8).alias("q"))


# --- compensation -----------------------------------------------------------------------------------------------------

S2 = [[1.0, 0.1], [0.05, 1.0]]
S4 = [[1.0, 0.02, 0.0, 0.0], [0.1, 1.0, 0.05, 0.0], [0.0, 0.03, 1.0, 0.2], [0.01, 0.0, 0.04, 1.0]]


def _linear(matrix, names) -> list[str]:
    return [" + ".join(f"{v!r} * {n}" for v, n in zip(row, names, strict=True)) for row in np.linalg.inv(np.array(matrix)).tolist()]


_two, _four = _linear(S2, "qp"), _linear(S4, "qpdt")


@query(f"with {ITEMS} select round({_two[0]}, 6) as q, round({_two[1]}, 6) as p from i")
def comp_2x2(spark, sf):
    return rounded(C.compensate(items(spark, sf), S2, ["q", "p"]).select("q", "p"))


@query(f"with {ITEMS} select " + ", ".join(f"round({e}, 6) as {n}" for e, n in zip(_four, "qpdt", strict=True)) + " from i")
def comp_4x4(spark, sf):
    return rounded(C.compensate(items(spark, sf), S4, list("qpdt")).select(*"qpdt"))


@query(f"with {ITEMS} select round({_four[2]}, 6) as d, t from i")
def comp_partial(spark, sf):
    return rounded(C.compensate(items(spark, sf), S4, list("qpdt"), only=["d"]).select("d", "t"))


@query(f"""with {ITEMS}, r as (select sinh(q / 10) * 200 as q, sinh(d * 5) * 200 as p from i)
    select round(asinh(({_two[0]}) / 200), 6) as q, round(asinh(({_two[1]}) / 200), 6) as d from r""")
def unmix(spark, sf):
    df = items(spark, sf).select((F.col("q") / 10).alias("q"), (F.col("d") * 5).alias("d"))
    return rounded(C.unmix(df, S2, ["q", "d"]))


@query("""select vec_id, k, round(0.75 * embedding[k + 1]::double + 0.25 * embedding[(k + 1) % 64 + 1]::double, 6) as v
    from embeddings, (select unnest(range(64)) as k)""")
def comp_array64(spark, sf):
    m = 0.75 * np.eye(64) + 0.25 * np.roll(np.eye(64), 1, axis=1)
    out = C.matvec(m, F.col("embedding"))
    df = read(spark, sf, "embeddings").select("vec_id", F.posexplode(out).alias("k", "v"))
    return df.select("vec_id", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


@query(f"with {ITEMS} select round(asinh(({_two[0]}) * {K!r}), 6) as q, round(asinh(({_two[1]}) * {K!r}), 6) as p from i")
def preprocess_comp(spark, sf):
    return rounded(C.preprocess(items(spark, sf).select("q", "p"), S2, ["q", "p"]))


@query("select round(asinh(l_quantity / 150), 6) as q, round(asinh(l_extendedprice / 150), 6) as p from lineitem")
def preprocess_nocomp(spark, sf):
    return rounded(C.preprocess(items(spark, sf).select("q", "p"), cofactor=150.0))


# --- pixels, nice numbers ---------------------------------------------------------------------------------------------

AREA = Area()


@query("""select round(60.0 + (asinh(l_extendedprice / 200) - 0.0) / 7.0 * 330.0, 6) as px,
    round(10.0 + (50.0 - l_quantity) / 50.0 * 330.0, 6) as py from lineitem""")
def px_raw_to_pixel(spark, sf):
    df = items(spark, sf)
    return rounded(df.select(to_pixel(F.col("p"), Arcsinh(), 0.0, 7.0, AREA.x_range).alias("px"), to_pixel(F.col("q"), Linear(), 0.0, 50.0, AREA.y_range, flip=True).alias("py")))


@query("""select round(sinh(greatest(0.0, least(1.0, (l_quantity * 10 - 60.0) / 330.0)) * 7.0) * 200, 4) as x,
    round(greatest(0.0, least(1.0, (340.0 - l_quantity * 10) / 330.0)) * 50.0, 6) as y from lineitem""")
def px_pixel_to_raw(spark, sf):
    p = F.col("q") * 10
    df = items(spark, sf).select(from_pixel(p, Arcsinh(), 0.0, 7.0, AREA.x_range).alias("x"), from_pixel(p, Linear(), 0.0, 50.0, AREA.y_range, flip=True).alias("y"))
    return df.select(F.round("x", 4).alias("x"), F.round("y", 6).alias("y"))


@query("""with v as (select l_extendedprice - 30000.5 as x from lineitem),
    m as (select x, pow(10.0, floor(log10(abs(x)))) as f, abs(x) / pow(10.0, floor(log10(abs(x)))) as m from v)
    select sign(x) * f * case when m <= 1 then 1 when m <= 2 then 2 when m <= 5 then 5 else 10 end as up,
      sign(x) * f * case when m >= 5 then 5 when m >= 2 then 2 when m >= 1 then 1 else 0.5 end as down, count(*) as n from m group by 1, 2""")
def nice_number_(spark, sf):
    x = F.col("p") - 30000.5
    return items(spark, sf).groupBy(nice_number(x).alias("up"), nice_number(x, up=False).alias("down")).agg(F.count(F.lit(1)).alias("n"))


# --- projections ------------------------------------------------------------------------------------------------------


@query("select l_quantity as x, l_extendedprice as y from lineitem")
def proj_xy(spark, sf):
    df = items(spark, sf)
    return df.select(F.col(E.find_channel(df, "Q")).alias("x"), F.col(E.find_channel(df, "P")).alias("y"))


@query("""select p_partkey, case p_size % 4 when 1 then 'Comp::' when 2 then 'Unmix::' when 3 then 'Comp+Unmix::' else '' end || p_brand
    || case when p_type <> '' and p_type <> p_brand then '::' || p_type else '' end as label from part""")
def proj_labels(spark, sf):
    state = F.element_at(F.array(*map(F.lit, E.PREFIXES)), F.col("p_size") % 4 + 1)
    return read(spark, sf, "part").select("p_partkey", E.display_label(F.col("p_brand"), F.col("p_type"), state).alias("label"))


PARAMETERS = ("FSC-A", "SSC-A", "Time", "FL1-A", "UV379-A", "fsc-h")


@query(f"""with n as (select unnest({list(PARAMETERS)!r}) as name)
    select name, unnest(case when regexp_matches(upper(name), 'FSC|SSC|TIME') then ['raw::' || name]
      else ['transformed::' || name, 'comp_trans::' || name, 'unmix_trans::' || name, 'comp_unmix_trans::' || name] end) as option from n""")
def proj_plot_options(spark, sf):
    return E.plot_options(spark.createDataFrame([(n,) for n in PARAMETERS], "name string"), True)


@query("select p_name, not regexp_matches(upper(p_name), 'FSC|SSC|TIME') as fluorescence from part")
def proj_fluor(spark, sf):
    return read(spark, sf, "part").select("p_name", is_fluorescence(F.col("p_name")).alias("fluorescence"))


@query("select event_id as event_idx, value, value * 2 as twice from events")
def add_column(spark, sf):
    return E.add_channel(events(spark, sf).select("event_idx", "value"), "twice", F.col("value") * 2)


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def keyword_lookup(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select file, count(*) as n, count(*) filter (value is null) as nulls from (select event_type as file, value from events) group by file")
def shape(spark, sf):
    return events(spark, sf).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"))


# --- gates ------------------------------------------------------------------------------------------------------------

TRIANGLE = ((5.3, 1000.7), (45.1, 20000.3), (10.9, 80000.9))
CONCAVE = ((2.5, 950.5), (48.5, 950.5), (48.5, 90000.5), (25.3, 30000.7), (2.5, 90000.5))
GATES = G.GateSet([
    G.Gate("rect", G.Rectangle((10.5, 5000.5), (30.5, 60000.5)), "q", "p"),
    G.Gate("half", G.Rectangle((10.0, 5000.5), (30.0, 60000.5), half_open=True), "q", "p"),
    G.Gate("tri", G.Polygon(TRIANGLE), "q", "p"),
    G.Gate("concave", G.Polygon(CONCAVE), "q", "p"),
    G.Gate("open", G.Polygon(TRIANGLE, closed=False), "q", "p"),
    G.Gate("round", G.Ellipse((25.2, 30000.4), 10.3, 20000.6), "q", "p"),
    G.Gate("tilted", G.Ellipse((0.05, 0.04), 0.041, 0.017, 0.6), "d", "t"),
    G.Gate("both", G.Boolean("and", ("rect", "tri"))),
    G.Gate("any", G.Boolean("or", ("rect", "tilted"))),
    G.Gate("no", G.Boolean("not", ("rect",))),
    G.Gate("deep", G.Boolean("and", ("any", "no", "concave"))),
])


def _poly(nodes, x="q", y="p") -> str:
    """Crossings counted as 0 or 1 and added: an odd sum is inside."""
    edges = zip((nodes[-1], *nodes[:-1]), nodes, strict=True)
    return "(" + " + ".join(f"case when (({a[1]} > {y}) <> ({b[1]} > {y})) and {x} < ({b[0]} - {a[0]}) * ({y} - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} then 1 else 0 end" for a, b in edges if a[1] != b[1]) + ") % 2 = 1"


_c, _s = math.cos(0.6), math.sin(0.6)
SQL = {
    "rect": "q >= 10.5 and q <= 30.5 and p >= 5000.5 and p <= 60000.5",
    "half": "q >= 10 and q < 30 and p >= 5000.5 and p < 60000.5",
    "tri": _poly(TRIANGLE), "concave": _poly(CONCAVE), "open": "false",
    "round": "pow((q - 25.2) / 10.3, 2) + pow((p - 30000.4) / 20000.6, 2) <= 1",
    "tilted": f"pow(((d - 0.05) * {_c!r} + (t - 0.04) * {_s!r}) / 0.041, 2) + pow(((t - 0.04) * {_c!r} - (d - 0.05) * {_s!r}) / 0.017, 2) <= 1",
}


def _inside(gate):
    return lambda spark, sf: G.filter_events(items(spark, sf), GATES, gate).select("q", "p", "d", "t")


for _name, _gate in (("gate_rect", "rect"), ("gate_rect_halfopen", "half"), ("gate_poly", "tri"), ("gate_poly_concave", "concave"), ("gate_poly_open", "open"), ("gate_ellipse", "round"), ("gate_ellipse_rot", "tilted")):
    query(f"with {ITEMS} select q, p, d, t from i where {SQL[_gate]}", _name)(_inside(_gate))

_all = "with i as (select row_number() over () as k, l_quantity q, l_extendedprice p, l_discount d, l_tax t from lineitem)"
_of = {g: f"select k from i where {SQL[g]}" for g in SQL}
for _name, _gate, _keys in (
    ("gate_and", "both", f"{_of['rect']} intersect {_of['tri']}"),
    ("gate_or", "any", f"{_of['rect']} union {_of['tilted']}"),
    ("gate_not", "no", f"select k from i except {_of['rect']}"),
    ("gate_nested", "deep", f"(({_of['rect']} union {_of['tilted']}) except {_of['rect']}) intersect {_of['concave']}"),
):
    query(f"{_all}, s as ({_keys}) select q, p, d, t from i join s using (k)", _name)(_inside(_gate))


@query(f"{_all}, s as ({_of['concave']} intersect {_of['rect']} intersect {_of['round']}) select q, p, d, t from i join s using (k)")
def gate_chain(spark, sf):
    return G.filter_events(items(spark, sf), GATES, "concave", "rect", "round").select("q", "p", "d", "t")


SCOPES = [("g1", "value", "time", None), ("g2", "value", "time", ["click", "view"]), ("g3", "value", "time", ["purchase"]), ("g4", "value", "other", None)]
_scope_sql = "g(id, x, y, files) as (values " + ", ".join(f"('{i}', '{x}', '{y}', {'null' if f is None else repr(f)}::varchar[])" for i, x, y, f in SCOPES) + ")"


def _gates(spark):
    return spark.createDataFrame(SCOPES, "id string, x string, y string, files array<string>")


@query(f"""with {_scope_sql} select id, file, count(*) as n from (select event_type as file from events) e join g on files is null or list_contains(files, file) group by id, file""")
def gate_scope(spark, sf):
    files = events(spark, sf).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return files.join(F.broadcast(_gates(spark)), F.col("files").isNull() | F.array_contains("files", F.col("file"))).select("id", "file", "n")


@query(f"with {_scope_sql} select id from g where x = 'value' and y = 'time' and files is null")
def gate_by_params(spark, sf):
    return _gates(spark).where("x = 'value' and y = 'time' and files is null").select("id")


@query("""select id, round(cx, 6) as cx, round(cy, 6) as cy, x0, y0, x1, y1 from (
    select 'tri' as id, avg(x) cx, avg(y) cy, min(x) x0, min(y) y0, max(x) x1, max(y) y1 from (values """ + ", ".join(f"({x}, {y})" for x, y in TRIANGLE) + """) v(x, y)
    union all select 'concave', avg(x), avg(y), min(x), min(y), max(x), max(y) from (values """ + ", ".join(f"({x}, {y})" for x, y in CONCAVE) + ") v(x, y))")
def poly_bbox_center(spark, sf):
    rows = [(g, *GATES.gates[g].geometry.center(), *GATES.gates[g].geometry.bounds()) for g in ("tri", "concave")]
    return rounded(spark.createDataFrame(rows, "id string, cx double, cy double, x0 double, y0 double, x1 double, y1 double"))


_edges = "edges as (select 'r' || r_regionkey as parent, 'n' || n_nationkey as child from nation join region on n_regionkey = r_regionkey union all select 'n' || c_nationkey, 'c' || c_custkey from customer)"


def _edge_view(spark, sf) -> DataFrame:
    n, r, c = (read(spark, sf, x) for x in ("nation", "region", "customer"))
    a = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("r"), "r_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    return a.unionAll(c.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))


@query(f"""with recursive {_edges}, up as (select child as gate, parent as ancestor, 1 as depth from edges
    union all select up.gate, e.parent, depth + 1 from up join edges e on e.child = up.ancestor) select gate, ancestor, depth from up""")
def hier_ancestors(spark, sf):
    return H.ancestor_table(_edge_view(spark, sf))


@query(f"""with recursive {_edges}, down as (select parent as gate, child as descendant from edges
    union all select down.gate, e.child from down join edges e on e.parent = down.descendant) select gate, count(*) as descendants from down group by gate""")
def hier_descendants(spark, sf):
    return hier_ancestors(spark, sf).groupBy(F.col("ancestor").alias("gate")).agg(F.count(F.lit(1)).alias("descendants"))


@query("select n_nationkey, r_regionkey from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0 and r_regionkey in (0, 1, 2)")
def hier_filter(spark, sf):
    n = read(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), "n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    keep = n.where("n_nationkey % 2 = 0").select(F.col("child").alias("gate")).unionAll(read(spark, sf, "region").where("r_regionkey in (0, 1, 2)").select(F.concat(F.lit("r"), "r_regionkey")))
    return H.restricted_table(n, keep).join(n, ["parent", "child"]).select("n_nationkey", "r_regionkey")


@query("select c_nationkey as target, count(*) as links from customer group by c_nationkey")
def link_counts(spark, sf):
    return H.link_table(read(spark, sf, "customer").select(F.col("c_nationkey").alias("target"), F.col("c_custkey").alias("source")))


@query("select event_id as event_idx, value from events where event_type = 'click' or value > 50")
def mask_filter(spark, sf):
    e = events(spark, sf)
    mask = e.select("event_idx", ((F.col("file") == "click") | (F.col("value") > 50)).alias("keep"))
    return G.filter_mask(e.select("event_idx", "value"), mask, ["event_idx"])


@query("select event_type as file, value from events where event_type in ('click', 'view') union all select event_type, value from events where event_type = 'purchase'")
def concat_files(spark, sf):
    e = events(spark, sf).select("file", "value")
    return E.concatenate([e.where("file in ('click', 'view')"), e.where("file = 'purchase'")])


@query(f"with {EVENTS} select event_idx as old, row_number() over (partition by file order by event_idx) - 1 as event_idx, file from e where value > 20")
def dense_index(spark, sf):
    e = events(spark, sf).where("value > 20").select(F.col("event_idx").alias("old"), "file")
    return E.dense_index(e, "old", "file", cell=4096).select("old", "event_idx", "file")


# --- statistics -------------------------------------------------------------------------------------------------------


@query("select l_returnflag as file, min(l_extendedprice) as min, max(l_extendedprice) as max, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std from lineitem group by 1")
def stats_channel(spark, sf):
    return rounded(S.channel_summary(items(spark, sf), "p", "file"), 4)


@query("select l_returnflag as file, min(l_tax) as min, max(l_tax) as max from lineitem group by 1 having count(*) > 1")
def stats_minmax(spark, sf):
    return S.min_max(items(spark, sf), "t", "file")


def _stat_sql(v: str, prefix: str) -> str:
    return f"""round(avg({v}), 4) as {prefix}mean, round(case when min({v}) > 0 then geomean(case when {v} > 0 then {v} end) end, 4) as {prefix}geometric_mean,
      round(quantile_cont({v}, 0.25), 4) as {prefix}q1, round(quantile_cont({v}, 0.5), 4) as {prefix}median, round(quantile_cont({v}, 0.75), 4) as {prefix}q3,
      round(stddev_pop({v}), 4) as {prefix}std, round(case when avg({v}) <> 0 then stddev_pop({v}) / abs(avg({v})) * 100 end, 4) as {prefix}cv, min({v}) as {prefix}min, max({v}) as {prefix}max"""


@query(f"""with {ITEMS}, c as (select {_two[0]} as q, {_two[1]} as p, file from i), g as (select *, q >= 2.5 and q <= 40.5 and p >= 3000.5 and p <= 70000.5 and {_poly(CONCAVE)} as inside from c),
    k as (select file, count(*) filter (inside) as count, round(count(*) filter (inside) * 100.0 / count(*), 4) as percent,
      round(coalesce(avg(q) filter (inside), 0), 4) as centroid_x, round(coalesce(avg(p) filter (inside), 0), 4) as centroid_y from g group by file),
    s as (select file, {_stat_sql('q', 'x_')}, {_stat_sql('p', 'y_')} from g where inside group by file)
    select * exclude (x_min, x_max, y_min, y_max), round(x_min, 4) as x_min, round(x_max, 4) as x_max, round(y_min, 4) as y_min, round(y_max, 4) as y_max from k left join s using (file)""")
def stats_gate(spark, sf):
    """Flagship: compensation, a rectangle and a polygon, and the population's statistics, in one scan and shuffle."""
    gates = G.GateSet([G.Gate("r", G.Rectangle((2.5, 3000.5), (40.5, 70000.5)), "q", "p"), G.Gate("c", G.Polygon(CONCAVE), "q", "p")])
    df = C.compensate(items(spark, sf).select("q", "p", "file"), S2, ["q", "p"])
    return rounded(S.gate_statistics(df, gates.chain(["r", "c"]), "q", "p", "file"), 4)


@query(f"select l_returnflag as file, {_stat_sql('l_extendedprice', '')} from lineitem group by 1")
def stats_param(spark, sf):
    return rounded(items(spark, sf).groupBy("file").agg(*S.parameter_aggregates(F.col("p"))), 4)


@query("""select file, round(median(value), 6) as median, round(mad(value), 6) as mad, round(mad(value) * 1.4826, 6) as mad_scaled
    from (select event_type as file, value from events) group by file""")
def median_mad(spark, sf):
    return rounded(S.median_mad(events(spark, sf).select("file", "value"), "value", "file"))


_ranked = f"with {EVENTS}, r as (select file, value, row_number() over (partition by file order by value) - 1 as k, count(*) over (partition by file) as n from e)"


@query(f"""{_ranked} select file, round(case when max(n) < 4 then max(value) - min(value)
    else max(value) filter (k = 3 * n // 4) - max(value) filter (k = n // 4) end, 6) as iqr from r group by file""")
def iqr_index(spark, sf):
    return rounded(S.index_iqr(events(spark, sf).select("file", "value"), "value", "file"))


@query(f"""{_ranked} select file, max(value) filter (k = least(n - 1, floor(n * 0.01))) as low, max(value) filter (k = least(n - 1, ceil(n * 0.99))) as high from r group by file""")
def pct_bounds(spark, sf):
    return S.percentile_bounds(events(spark, sf).select("file", "value"), "value", 0.01, 0.99, "file")


# --- margins, doublets ------------------------------------------------------------------------------------------------

RANGES = {"q": (0.0, 45.0), "p": (-100.0, 90000.0), "d": None}
_margin = """x as (select *, min(q) over () q0, max(q) over () q1, min(p) over () p0, max(p) over () p1, min(d) over () d0, max(d) over () d1 from i),
    m as (select *, q <= greatest(least(0.0, 0), q0) as qa, q > least(45.0, q1) as qb, p <= greatest(least(-100.0, 0), p0) as pa, p > least(90000.0, p1) as pb,
      d <= greatest(least(least(d0, 0), 0), d0) as da, d > least(greatest(d1, 262144), d1) as db from x)"""


@query(f"with {ITEMS}, {_margin} select q, p, d, t from m where not (qa or qb or pa or pb or da or db)")
def margins(spark, sf):
    df, _ = O.margins(items(spark, sf), RANGES)
    return df.where("not in_margin").select("q", "p", "d", "t")


@query(f"""with {ITEMS}, {_margin} select count(*) filter (qa) as q_min_removed, count(*) filter (qb and not qa) as q_max_removed,
    count(*) filter (pa) as p_min_removed, count(*) filter (pb and not pa and not (qa or qb)) as p_max_removed,
    count(*) filter (da) as d_min_removed, count(*) filter (db and not da and not (qa or qb or pa or pb)) as d_max_removed from m""")
def margin_counts(spark, sf):
    df, counts = O.margins(items(spark, sf), RANGES)
    return df.agg(*counts)


@query(f"""with {ITEMS}, r as (select *, p / (1e-10 + q + 0) as ratio from i), s as (select median(ratio) as mid, mad(ratio) as dev from r)
    select file, count(*) as n, round(max(ratio), 4) as top from r, s where ratio < mid + 1.5 * 1.4826 * dev group by file""")
def doublets(spark, sf):
    df = O.doublets(items(spark, sf), "p", "q", nmad=1.5)
    return df.where("single").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("ratio"), 4).alias("top"))


_by_file = _margin.replace("over ()", "over (partition by file)")


@query(f"with {ITEMS}, {_by_file} select file, q, p, d, t from m where not (qa or qb or pa or pb or da or db)")
def margins_by_file(spark, sf):
    df, _ = O.margins(items(spark, sf), RANGES, "file")
    return df.where("not in_margin").select("file", "q", "p", "d", "t")


@query(f"""with {ITEMS}, r as (select *, p / (1e-10 + q + 0) as ratio from i), s as (select file, median(ratio) as mid, mad(ratio) as dev from r group by file)
    select file, count(*) as n, round(max(ratio), 4) as top from r join s using (file) where ratio < mid + 1.5 * 1.4826 * dev group by file""")
def doublets_by_file(spark, sf):
    df = O.doublets(items(spark, sf), "p", "q", "file", nmad=1.5)
    return df.where("single").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("ratio"), 4).alias("top"))


@query("""with b as (select event_type as file, min(value) as lo, max(value) as hi from events group by 1), s as (select *, pow(10.0, floor(log10(hi - lo))) as step from b)
    select file, case when hi = lo then lo - 0.5 else floor(lo / step) * step end as low, case when hi = lo then hi + 0.5 else ceil(hi / step) * step end as high from s""")
def axis_specs(spark, sf):
    b = S.min_max(events(spark, sf), "value", "file")
    low, high = R.axis_spec(Linear(), F.col("min"), F.col("max"))
    return b.select("file", low.alias("low"), high.alias("high"))


# --- rasters ----------------------------------------------------------------------------------------------------------

XR, YR = (0.0, 50.0), (0.0, 80000.0)
_px = "greatest(0, least(399, floor((q - 0.0) * (400 / 50.0))))::int as px, greatest(0, least(399, floor((p - 0.0) * (400 / 80000.0))))::int as py"


@query(f"with {ITEMS} select {_px}, count(*) as n from i group by 1, 2")
def raster_counts(spark, sf):
    return R.counts(items(spark, sf), "q", "p", XR, YR)


@query(f"""with {ITEMS}, c as (select {_px}, count(*) as n from i group by 1, 2), m as (select greatest(1.0, max(log10(n + 1))) as top from c)
    select px, py, round(log10(n + 1) / top, 6) as density, px / 8.0 as x, py / 0.005 as y from c, m""")
def raster_log(spark, sf):
    df = R.data_coordinates(R.log_density(R.counts(items(spark, sf), "q", "p", XR, YR)), XR, YR)
    return df.select("px", "py", F.round("density", 6).alias("density"), "x", "y")


@query(f"""with {ITEMS}, c as (select file, {_px}, count(*) as n from i group by 1, 2, 3), m as (select file, greatest(1.0, max(log10(n + 1))) as top from c group by file)
    select file, px, py, round(log10(n + 1) / top, 6) as density from c join m using (file)""")
def raster_batch(spark, sf):
    """Several plots at once: the plot is one more grouping key."""
    df = R.log_density(R.counts(items(spark, sf), "q", "p", XR, YR, 400, 400, "file"), "file")
    return df.select("file", "px", "py", F.round("density", 6).alias("density"))


@query(f"""{_ranked}, b as (select file, max(value) filter (k = least(n - 1, floor(n * 0.01))) as lo, max(value) filter (k = least(n - 1, ceil(n * 0.99))) as hi from r group by file),
    m as (select file, lo, hi, pow(10.0, floor(log10(abs(lo)))) as fl, pow(10.0, floor(log10(abs(hi)))) as fh from b)
    select file, case when lo = 0 then 0 else sign(lo) * fl * case when abs(lo) / fl >= 5 then 5 when abs(lo) / fl >= 2 then 2 when abs(lo) / fl >= 1 then 1 else 0.5 end end as low,
      case when hi = 0 then 0 else sign(hi) * fh * case when abs(hi) / fh <= 1 then 1 when abs(hi) / fh <= 2 then 2 when abs(hi) / fh <= 5 then 5 else 10 end end as high from m""")
def axis_range(spark, sf):
    b = S.percentile_bounds(events(spark, sf).select("file", "value"), "value", 0.01, 0.99, "file")
    low, high = R.axis_range("value", (F.col("low"), F.col("high")), F.col("high"))
    return b.select("file", low.alias("low"), high.alias("high"))


_corner = lambda i: "list_value(" + ", ".join(f"{c[i]}" for c in R.GRADIENT) + ")"
_mix = lambda i: f"round({_corner(i)}[k + 1] * (1 - (v * 4 - k)) + {_corner(i)}[k + 2] * (v * 4 - k))::int"


@query(f"""with {ITEMS}, c as (select file, {_px}, count(*) as n from i group by 1, 2, 3), m as (select file, greatest(1.0, max(log10(n + 1))) as top from c group by file),
    d as (select file, px, py, log10(n + 1) / top as v, least(3, floor(log10(n + 1) / top * 4))::int as k from c join m using (file)),
    h as (select file, px, py, printf('%02X%02X%02X', {_mix(0)}, {_mix(1)}, {_mix(2)}) as rgb from d),
    b as (select file, min(px) as x0, min(py) as y0, max(px) as x1, max(py) as y1 from c group by file),
    g as (select file, x, y from (select *, unnest(range(y0, y1 + 1)) as y from (select *, unnest(range(x0, x1 + 1)) as x from b))),
    t as (select g.file, string_agg(coalesce(rgb, '000000'), '' order by y, x) as body from g left join h on g.file = h.file and x = px and y = py group by g.file)
    select file, printf('%02X%02X0000%02X%02X0000%02X%02X0000%02X%02X0000', (x0 % 256)::int, (x0 // 256)::int, (y0 % 256)::int, (y0 // 256)::int, (x1 % 256)::int, (x1 // 256)::int, (y1 % 256)::int, (y1 // 256)::int) || body as chunk
    from t join b using (file)""")
def raster_chunks(spark, sf):
    df = R.log_density(R.counts(items(spark, sf), "q", "p", XR, YR, 400, 400, "file"), "file")
    return R.packed(df.withColumn("rgb", R.colour(F.col("density"))), "file").select("file", F.hex("chunk").alias("chunk"))


# --- parsing ----------------------------------------------------------------------------------------------------------

TEXTS = ("1,5", "2.25", "x", " 7 ", "-3,75", "")


@query(f"with s as (select unnest({list(TEXTS)!r}) as s) select s, try_cast(replace(trim(s), ',', '.') as double) as v from s")
def parse_decimal_comma(spark, sf):
    return spark.createDataFrame([(t,) for t in TEXTS], "s string").select("s", P.decimal(F.col("s")).alias("v"))


PAIRS = ("0,0", "4.5,1", "1,5,2,5", "1", "a,b", "1,2,3")


@query(f"""with s as (select unnest({list(PAIRS)!r}) as s), p as (select s, string_split(s, ',') as p from s),
    v as (select s, case len(p) when 2 then try_cast(p[1] as double) when 4 then try_cast(p[1] || '.' || p[2] as double) end as a,
      case len(p) when 2 then try_cast(p[2] as double) when 4 then try_cast(p[3] || '.' || p[4] as double) end as b from p)
    select s, case when a is not null and b is not null then a end as a, case when a is not null and b is not null then b end as b from v""")
def parse_tuple(spark, sf):
    return spark.createDataFrame([(t,) for t in PAIRS], "s string").withColumn("p", P.pair(F.col("s"))).select("s", "p.a", "p.b")


SPILLS = ("2,FL1-A,FL2-A,1,0.1,0.15,1", "3,a,b,c,1,0,0,0,1,0,0,0,1", "2,a,b,1,0", "x,1")


@query(f"""with s as (select unnest({list(SPILLS)!r}) as s), p as (select s, string_split(s, ',') as p, try_cast(string_split(s, ',')[1] as int) as n from s)
    select s, n, p[k + 1] as name, try_cast(p[1 + n + (k - 1) * n + k] as double) as diagonal from p, (select unnest([1, 2, 3]) as k) where n is not null and len(p) = 1 + n + n * n and k <= n""")
def parse_spillover(spark, sf):
    df = spark.createDataFrame([(t,) for t in SPILLS], "s string").withColumn("m", P.spillover(F.col("s"))).where("m is not null")
    df = df.select("s", F.col("m.n").alias("n"), "m.values", F.posexplode("m.names").alias("k", "name"))
    return df.select("s", "n", "name", F.get("values", F.col("k") * F.col("n") + F.col("k")).alias("diagonal"))


KEYS = ("$PAR", "$P1N", "$P12S", "$p3r", "GUID", "$G1F", "$R2W", "CUSTOM", "$BYTEORD", "P5B")


@query(f"""with s as (select unnest({list(KEYS)!r}) as key)
    select key, case when regexp_matches(upper(key), '^\\$P[0-9]+[A-Z]') then 'parameter' when regexp_matches(upper(key), '^\\$G[0-9]+[A-Z]') then 'gate'
      when regexp_matches(upper(key), '^\\$R[0-9]+[A-Z]') then 'region' when starts_with(key, '$') or upper(key) = 'GUID' then 'fixed' else 'other' end as kind,
      try_cast(regexp_extract(key, '^\\$?[PGRpgr]([0-9]+)', 1) as int) as number, upper(regexp_extract(key, '^\\$?[PGRpgr][0-9]+(.+)$', 1)) as suffix from s""")
def parse_keyword_kind(spark, sf):
    k = F.col("key")
    return spark.createDataFrame([(t,) for t in KEYS], "key string").select("key", P.keyword_kind(k).alias("kind"), P.keyword_number(k).alias("number"), P.keyword_suffix(k).alias("suffix"))


@query("select k, count(*) as n from (select cast(json_extract_string(props, '$.k') as bigint) as k from events) group by k")
def json_map(spark, sf):
    props = F.from_json("props", "map<string,bigint>")
    return read(spark, sf, "events").groupBy(F.element_at(props, "k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, p_size, cast(ceil(p_size / 8.0) as int) as bytes from part")
def bits_to_bytes(spark, sf):
    return read(spark, sf, "part").select("p_partkey", "p_size", P.bytes_of_bits(F.col("p_size")).alias("bytes"))


# --- exports ----------------------------------------------------------------------------------------------------------


def _masked(spark, sf):
    return events(spark, sf).withColumn("good", (F.col("value") > 10) & (F.col("event_idx") % 7 != 3))


_mask = f"with {EVENTS}, m as (select *, value > 10 and event_idx % 7 <> 3 as good from e)"


@query(f"{_mask} select event_idx, case when good then 1 else 0 end as good from m")
def export_bool(spark, sf):
    return X.flags(_masked(spark, sf))


@query(f"{_mask} select event_idx, case when good then 2000 else 6000 end as good from m")
def export_numeric(spark, sf):
    return X.flags(_masked(spark, sf), yes=2000, no=6000)


@query(f"""{_mask} select file, count(*) as n_events_before, count(*) filter (good) as n_events_after, count(*) filter (not good) as n_events_removed,
    round(count(*) filter (not good) * 100.0 / count(*), 6) as percentage_removed, 40 as n_bins, 500 as events_per_bin from m group by file""")
def export_json(spark, sf):
    r = X.report(_masked(spark, sf), 40, 500, ["value"], "file")
    j = X.as_json(r).select(F.from_json("json", r.schema).alias("r")).select("r.*")
    return j.drop("channels").withColumn("percentage_removed", F.round("percentage_removed", 6))


@query(f"""with {EVENTS}, r as (select file, count(*) / 1000.0 as seconds, case when min(value) < 0.01 then 'low' end as error from e group by file)
    select count(*) as processed, count(*) filter (error is null) as successful, count(*) filter (error is not null) as failed, round(avg(seconds), 6) as mean_seconds from r""")
def report_rollup(spark, sf):
    r = events(spark, sf).groupBy("file").agg((F.count(F.lit(1)) / 1000).alias("seconds"), F.when(F.min("value") < 0.01, "low").alias("error"))
    return rounded(X.roll_up(r))


QUERIES["nice_number"] = QUERIES.pop("nice_number_")
ORACLE["nice_number"] = ORACLE.pop("nice_number_")
