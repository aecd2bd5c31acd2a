"""Operators against plain Python on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytospark.errors import ChannelError, GateError, QcError
from cytospark.functions import transforms as T
from cytospark.operators import bins as B
from cytospark.operators import compensation as C
from cytospark.operators import events as E
from cytospark.operators import gates as G
from cytospark.operators import outliers as O
from cytospark.operators import peaks as K
from cytospark.operators.hierarchy import Hierarchy, Links
from cytospark.plans.control import Config, quality_control
from cytospark.streaming.gating import gated, windowed


def inside(nodes, x, y):
    odd, j = False, len(nodes) - 1
    for i in range(len(nodes)):
        (x1, y1), (x2, y2) = nodes[j], nodes[i]
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
        j = i
    return odd


@pytest.mark.parametrize("n", [3, 12, 150])
def test_polygon(spark, n):
    rng = random.Random(n)
    nodes = tuple((50 + (20 + 25 * rng.random()) * math.cos(2 * math.pi * k / n), 50 + (20 + 25 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n))
    points = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(500)]
    df = spark.createDataFrame(points, "x double, y double")
    got = {tuple(r) for r in df.where(G.Polygon(nodes).test(F.col("x"), F.col("y"))).collect()}
    assert got == {p for p in points if inside(nodes, *p)}


def test_grid_and_nulls(spark):
    df = spark.createDataFrame([(float(i % 10), float(i // 10)) for i in range(100)] + [(None, 3.0)], "x double, y double")
    s = G.GateSet([G.Gate("r", G.Rectangle((2, 2), (5, 5)), "x", "y"), G.Gate("h", G.Rectangle((2, 2), (5, 5), half_open=True), "x", "y"), G.Gate("n", G.Boolean("not", ("r",))), G.Gate("o", G.Polygon(((0, 0), (5, 0), (2, 5)), closed=False), "x", "y")])
    assert [G.filter_events(df, s, g).count() for g in "rhno"] == [16, 9, 85, 0]
    assert G.filter_events(df, s).count() == 101


def test_geometry():
    e = G.Ellipse((1.0, 2.0), 3.0, 1.0, math.pi / 2)
    assert np.allclose(e.bounds(), (0, -1, 2, 5)) and e.center() == (1.0, 2.0) and e.valid()
    assert G.Polygon(((0, 0), (2, 0), (1, 3))).center() == (1.0, 1.0) and G.Polygon(((0, 0), (1, 0), (2, 0))).bounds() is None
    assert G.rectangle_of([(3, 1), (0, 2)]) == G.Rectangle((0, 1), (3, 2))
    assert G.ellipse_of([(0, 0), (2, 0), (0, 1), (-2, 0), (0, -1)]) == G.Ellipse((0, 0), 2.0, 1.0, 0.0)
    for bad in (lambda: G.polygon_of([(0, 0)]), lambda: G.rectangle_of([(0, 0)]), lambda: G.rectangle_of([(0, math.nan), (1, 1)]), lambda: G.ellipse_of([])):
        with pytest.raises(GateError):
            bad()


def test_hierarchy():
    h = Hierarchy([("a", "b"), ("b", "c"), ("a", "d"), ("x", "y")])
    assert h.chain("c") == ["a", "b", "c"] and h.descendants("a") == ["b", "d", "c"] and h.roots() == ["a", "x"] and h.leaves() == ["c", "d", "y"]
    assert h.depth_first() == ["a", "b", "c", "d", "x", "y"] and h.depth("c") == 2
    for edge in (("c", "a"), ("a", "a")):
        with pytest.raises(GateError):
            h.add(*edge)
    h.clone_subtree("b", lambda g: g + "2")
    assert h.children("b2") == ["c2"]
    h.reparent("x", "b")
    assert h.ancestors("c") == ["b", "x"]
    h.remove_keep_children("b")
    assert h.parent("c") == "x" and h.remove_subtree("x") == ["x", "y", "c"]
    links = Links()
    links.add("t", "s")
    links.add("t", "s")
    links.remove("t", "s")
    assert links.count("t") == 1 and links.is_linked("t") and links.counts() == {"t": 1}


def test_compensation(spark):
    df = spark.createDataFrame([(100.0, 50.0), (200.0, 150.0)], "a double, b double")
    s = np.array([[1, 0.1], [0.05, 1]])
    got = np.array(C.compensate(df, s, ["a", "b"]).collect())
    np.testing.assert_allclose(got, np.array(df.collect()) @ np.linalg.inv(s).T)
    np.testing.assert_allclose(np.array(C.compensate(df, s, ["a", "b"], transpose=True).collect()), np.array(df.collect()) @ np.linalg.inv(s))
    assert C.compensate(df, np.eye(2), ["a", "b"]) is df
    with pytest.raises(ChannelError):
        C.compensate(df, s, ["a", "zz"])


def test_transforms(spark):
    df = spark.createDataFrame([(1.0,), (-250.0,), (1e5,), (0.0,)], "x double")
    for scale in (T.Arcsinh(200), T.Biexponential(), T.Biexponential(a=1.0), T.from_name("logicle"), T.from_name("?")):
        back = [r[0] for r in df.select(scale.inverse(scale.forward(F.col("x")))).collect()]
        np.testing.assert_allclose(back, [1.0, -250.0, 1e5, 0.0], rtol=1e-9, atol=1e-9)
    assert [r[0] for r in df.select(T.short_exponent(F.col("x"))).collect()] == ["1.0e0", "-2.5e2", "1.0e5", "0.0e0"]
    with pytest.raises(ChannelError):
        E.add_channel(df, "x", F.lit(1))


def test_bins():
    assert B.breaks(10_000, 1000)[:2] == [(0, 1000), (500, 1500)] and B.breaks(10_000, 1000)[-1][1] == 10_000
    assert B.events_per_bin(10_000) == 500 and B.bin_count(10_000, 500) == 40
    with pytest.raises(QcError):
        B.breaks(10, 1)


def test_density_peaks():
    rng = np.random.default_rng(0)
    p = K.local_peaks(*K.density(np.concatenate([rng.normal(0, 1, 500), rng.normal(10, 1, 500)])))
    assert len(p) == 2 and abs(p[0]) < 2 and abs(p[1] - 10) < 2
    assert list(K.local_peaks(*K.density(np.full(10, 3.0)))) == [3.0] and K.density(np.array([1.0, np.nan, 2.0])) is None


def test_spline_limits():
    y = np.random.default_rng(1).normal(size=40)
    np.testing.assert_allclose(O.smoothing_spline(y, 0.0), y)
    line = O.smoothing_spline(y, 1.0)
    np.testing.assert_allclose(np.diff(line, 2), 0, atol=1e-9)
    np.testing.assert_allclose(O.smoothing_spline(y, 0.999999), line, atol=1e-2)
    n, lam = len(y), 1.0
    q = np.zeros((n, n - 2))
    for i in range(n - 2):
        q[i : i + 3, i] = 1, -2, 1
    r = np.diag(np.full(n - 2, 2 / 3)) + np.diag(np.full(n - 3, 1 / 6), 1) + np.diag(np.full(n - 3, 1 / 6), -1)
    np.testing.assert_allclose(O.smoothing_spline(y, 0.5), y - lam * q @ np.linalg.solve(r + lam * q.T @ q, q.T @ y))


def test_best_split_and_tree():
    v = np.array([1.0, 1.1, 0.9, 1.0, 9.0, 9.1])
    gain, at = O.best_split(v, 0.1)
    assert at == 1.1 and gain > 0.9 and O.best_split(np.ones(5), 0.0) is None
    x = np.concatenate([np.random.default_rng(2).normal(0, 1, (180, 2)), np.random.default_rng(3).normal(30, 1, (20, 2))])
    good = O.isolation_tree(x, 0.6)
    assert good[:180].all() and not good[180:].any()


def test_mad():
    y = np.sin(np.arange(60) / 9) * 0.1
    y[30:33] += 50
    bad = O.mad_outliers(y, 6.0)
    assert bad[30:33].all() and not bad[:20].any() and not O.mad_outliers(np.ones(9)).any()


def test_short_runs(spark):
    bad = [0, 0, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0]
    df = spark.createDataFrame([(i, bool(b)) for i, b in enumerate(bad)], "bin int, bad boolean")
    got = [r["bad"] for r in B.remove_short_runs(df).orderBy("bin").collect()]
    assert got == [False, False, True, True, True, True, True, False, False, False, False, False, True, False]


def test_quality_control(spark):
    i = np.arange(20_000)  # evenly spread sums: one peak in every bin
    v = 100 + 10 * ((i * 0.6180339887) % 1 + (i * 0.7548776662) % 1)
    v[9000:11_000] += 80
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "event_idx long, v double")
    got = np.array([r["good"] for r in quality_control(df, Config(("v",), per_bin=200)).orderBy("event_idx").collect()])
    assert not got[9200:10_800].any() and got[:8500].mean() > 0.9 and got[11_500:].mean() > 0.9
    assert quality_control(df, Config(("v",), mode="none", per_bin=200)).where("not good").count() == 0


def test_dense_index_after_filter(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("old"), (F.col("id") % 3).alias("file")).where("old % 7 <> 0")
    got = E.dense_index(df, "old", "file", cell=64).collect()
    for f in range(3):
        assert [r["event_idx"] for r in sorted((r for r in got if r["file"] == f), key=lambda r: r["old"])] == list(range(sum(r["file"] == f for r in got)))


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", float(i)) for i in range(100)], "event_idx long, ts string, v double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("event_idx long, ts string, v double").parquet(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))
    gates = G.GateSet([G.Gate("g", G.Rectangle((10, 10), (59, 59)), "v", "v")])
    q = windowed(gated(s, gates, "g"), "ts", "v", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["n"] for r in spark.table("w").collect()} == {10} and spark.table("w").count() == 5


def test_spline_of_weights_and_repeated_places():
    from cytospark.operators.outliers import smoothing_spline

    rng = np.random.default_rng(1)
    y = rng.normal(size=40)
    np.testing.assert_allclose(smoothing_spline(y, 0.5, np.arange(40) * 1.0), smoothing_spline(y))
    # against the dense normal equations
    x, w = np.sort(rng.random(25)) * 20, rng.random(25) + 0.5
    h = np.diff(x)
    q, r = np.zeros((25, 23)), np.zeros((23, 23))
    for i in range(23):
        q[i : i + 3, i] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        r[i, i] = (h[i] + h[i + 1]) / 3
        if i < 22:
            r[i, i + 1] = r[i + 1, i] = h[i + 1] / 6
    for spar in (0.2, 0.5, 0.9):
        lam = spar / (1 - spar)
        want = np.linalg.solve(np.diag(w) + lam * q @ np.linalg.solve(r, q.T), w * y[:25])
        np.testing.assert_allclose(smoothing_spline(y[:25], spar, x, w), want, atol=1e-9)
    # two values at one place weigh as their mean twice; order does not matter
    a = smoothing_spline(np.array([1.0, 3.0, 5.0, 2.0, 4.0]), 0.5, np.array([0.0, 1.0, 1.0, 2.0, 3.0]))
    b = smoothing_spline(np.array([1.0, 4.0, 2.0, 4.0]), 0.5, np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 2.0, 1.0, 1.0]))
    np.testing.assert_allclose(a, b[[0, 1, 1, 2, 3]])
    np.testing.assert_allclose(smoothing_spline(y[[2, 0, 1]], 0.5, np.array([2.0, 0.0, 1.0])), smoothing_spline(y[:3])[[2, 0, 1]])
    assert list(smoothing_spline(np.array([1.0, 2.0, 3.0]), 0.5, np.array([0.0, 0.0, 1.0]))) == [1, 2, 3]


def test_hierarchy_tables(spark):
    from cytospark.errors import GateError
    from cytospark.operators import hierarchy as H

    h = H.Hierarchy([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "f")])
    h.validate()
    got = sorted(map(tuple, H.ancestor_table(spark.createDataFrame(h.edges(), "parent string, child string")).collect()))
    assert got == sorted((g, a, k) for g in h.nodes() for k, a in enumerate(h.ancestors(g), 1))
    with pytest.raises(GateError):
        H.ancestor_table(spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"))
    assert H.ancestor_table(spark.createDataFrame([], "parent string, child string")).count() == 0
    h.down["a"].append("c")
    with pytest.raises(GateError):
        h.validate()


def test_plots(spark):
    from cytospark.errors import EngineError
    from cytospark.operators import raster as R

    df = spark.createDataFrame([(0.5, 0.5), (1.0, 1.0), (1.0, 1.0)], "x double, y double")
    told, plot = [], R.Plot("x", "y", (0.0, 2.0), (0.0, 2.0), colours="jet")
    out = {(r["px"], r["py"]): tuple(r["rgb"]) for r in plot.draw(df, progress=lambda *a: told.append(a)).collect()}
    assert len(out) == 2 and told == [("counts", 1 / 3), ("density", 2 / 3), ("colour", 1.0)]
    for n, rgb in zip((1, 2), [out[k] for k in sorted(out)], strict=True):
        assert rgb == tuple(round(np.interp(math.log10(n + 1), np.linspace(0, 1, 9), [c[i] for c in R.COLOUR_MAPS["jet"]])) for i in range(3))
    assert plot.draw(df, cancelled=lambda: True) is None and len(R.COLOUR_MAPS) == 17
    assert tuple(spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(R.Plot("x", "y", (3.0, 87.0), (5.0, 5.0)).axes()))).first()) == (0, 90, 4.5, 5.5)
    with pytest.raises(EngineError):
        R.colour(df["x"], "none")


def test_masks_of_odd_bins(spark):
    """Bins of an odd number of events overlap a third one's first event."""
    from cytospark.operators import bins as B

    for per in (5, 6, 7):
        df = spark.range(40).withColumnRenamed("id", "event_idx")
        bad = {2, 5, 6}
        got = {r["event_idx"] for r in B.event_mask(df, spark.createDataFrame([(b,) for b in bad], "bin int"), per).where("not good").collect()}
        assert got == {i for b in bad for i in range(*B.breaks(40, per)[b])}


def test_order_statistics(spark):
    """Groups ranked whole, groups ranked between bounds, ties, nulls, empty tables."""
    from cytospark.operators import stats as S

    rng = np.random.default_rng(12)
    groups = {"a": rng.normal(size=30_000), "b": np.round(rng.normal(size=12_000), 1), "c": np.array([3.0, 1.0, 2.0]), "d": np.full(20_000, 7.0)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None)] * 5, "g string, v double").repartition(5)
    ranks = {"p": (0.25, lambda n: F.floor(n / 4)), "q": (0.99, lambda n: F.floor(n * 0.99)), "z": (0.0, lambda n: F.lit(0))}
    for accuracy in (10_000, 1000):
        got = {r["g"]: (r["n_"], r["p"], r["q"], r["z"]) for r in S.order_statistics(df, "v", ranks, "g", accuracy=accuracy).collect()}
        for g, v in groups.items():
            s = np.sort(v)
            assert got[g] == (len(s), s[len(s) // 4], s[math.floor(len(s) * 0.99)], s[0])
    for r in S.median_mad(df, "v", "g").collect():
        v = groups[r["g"]]
        assert math.isclose(r["median"], np.median(v), abs_tol=1e-12) and math.isclose(r["mad"], np.median(np.abs(v - np.median(v))), abs_tol=1e-12)
    assert math.isclose(S.exact_median(df, "v", "m").first()["m"], np.median(np.concatenate(list(groups.values()))))
    assert S.index_iqr(df.where("g = 'c'"), "v").first()["iqr"] == 2.0 and S.order_statistics(df.where("false"), "v", ranks, "g").count() == 0


def test_few_files_are_broadcast(spark):
    """Rows of few large files meet their file's values where they are: no task reads a file's rows."""
    from cytospark.operators import stats as S

    v = F.col("id") * 7919 % 1000
    df = spark.range(0, 2_000_000, 1, 5).select((F.col("id") % 3).cast("string").alias("file"), v.cast("double").alias("a"), (v % 7 + 1).cast("double").alias("h"))
    for got in (S.median_mad(df, "a", "file"), S.index_iqr(df, "a", "file"), S.percentile_bounds(df, "a", 0.01, 0.99, "file"), O.doublets(df, "a", "h", "file"), O.margins(df, {"a": None}, "file")[0]):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    values = [np.arange(f, 2_000_000, 3) * 7919 % 1000 for f in range(3)]
    assert {tuple(r) for r in S.median_mad(df, "a", "file").select("file", "median", "mad").collect()} == {(str(f), m := np.median(x), np.median(np.abs(x - m))) for f, x in enumerate(values)}


def test_many_files_with_a_large_one(spark):
    """Where files are too many to broadcast, Spark splits the large one; rows without a file have no values."""
    from cytospark.operators import stats as S

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    i = F.col("id")
    df = spark.range(0, 50_000, 1, 5).select(F.when(i % 10 == 0, i % 7000).when(i % 10 < 9, F.lit(-1)).alias("file"), (i * 7919 % 50_000).cast("double").alias("a"), F.lit(1.0).alias("h"))
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        got = {r["file"]: (r["median"], r["mad"]) for r in S.median_mad(df, "a", "file").collect()}
        single = O.doublets(df, "a", "h", "file", nmad=1.0).groupBy("file").agg(F.count_if("single").alias("n"))
        counts = {r["file"]: r["n"] for r in single.collect()}
        plan = single._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x) if x is not None else spark.conf.unset(k)
    pdf = df.toPandas().dropna()
    want = {f: (m := np.median(a), np.median(np.abs(a - m))) for f, a in ((f, g["a"].to_numpy()) for f, g in pdf.groupby("file"))}
    assert got == want and "skew=true" in plan
    ratio = pdf["a"] / (1e-10 + pdf["h"])
    far = pdf["file"].map(ratio.groupby(pdf["file"]).median())
    mad = pdf["file"].map((ratio - far).abs().groupby(pdf["file"]).median()) * O.MAD_SCALE
    assert counts == (ratio < far + mad).groupby(pdf["file"]).sum().to_dict()
