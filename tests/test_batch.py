"""Gates as JSON, quality control of many files, sheets."""

import json

import numpy as np
import pytest

from cytospark.errors import GateError
from cytospark.operators import gates as G
from cytospark.operators.bins import bin_count, events_per_bin
from cytospark.operators.exports import flags, with_quality, write_flags
from cytospark.operators.outliers import doublets, margins
from cytospark.plans.batch import Job, bin_report, channel_panel, clean, grid, metadata, rate_correlation, summary, time_panel, write_reports
from cytospark.plans.control import Config, bin_verdicts, quality_control


def test_gates_as_json():
    gates = [
        G.Gate("a", G.Polygon(((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))), "x", "y", "A"), G.Gate("b", G.Rectangle((0.0, 1.0), (2.0, 3.0)), "x", "y", "B", G.Mode(("f",))),
        G.Gate("c", G.Ellipse((1.0, 1.0), 2.0, 1.0, 0.5), "x", "y", "C", G.Mode(("f", "g"))), G.Gate("d", G.Boolean("or", ("a", "b")), "", "", "D"),
    ]
    assert [G.from_dict(json.loads(json.dumps(G.to_dict(g)))) for g in gates] == gates
    with pytest.raises(GateError):
        G.from_dict({"id": "z", "geometry": {"type": "Star"}, "mode": {"name": "Global"}, "parameters": ["x", "y"], "name": ""})
    m = G.with_file(G.Mode(("f",)), "g")
    assert m.applies_to("g") and not G.without_file(m, "f").applies_to("f") and G.with_file(G.Mode(), "g") == G.Mode()


def test_scope():
    s = G.GateSet([G.Gate("all", G.Rectangle((0, 0), (1, 1)), "x", "y"), G.Gate("one", G.Rectangle((0, 0), (1, 1)), "x", "y", "", G.Mode(("f",))), G.Gate("z", G.Rectangle((0, 0), (1, 1)), "x", "z")])
    ids = lambda *a: [g.id for g in s.by_channels("x", "y", *a)]
    assert ids() == ["all"] and ids("f") == ["all", "one"] and ids("g") == ["all"]


def test_many_files(spark):
    i = np.arange(8000)
    rows = []
    for f in ("one", "two"):
        v = 500 + 50 * ((i * 0.6180339887) % 1 + (i * 0.7548776662) % 1)
        if f == "two":
            v[3000:4500] += 4000
        rows += [(f, int(k), float(100 + k % 7), float(100 + k % 7 if k % 50 else 20), float(x)) for k, x in zip(i, v)]
    df = spark.createDataFrame(rows, "file_id string, event_idx long, `FSC-A` double, `FSC-H` double, `FL1-A` double")
    out = clean(df, Job(doublets=("FSC-A", "FSC-H"), per_bin=200)).toPandas()
    assert len(out) == 2 * 7840 and set(out["event_idx"][out["file_id"] == "one"]) == set(range(7840))
    good = out.groupby("file_id")["good"].mean()
    middle = out[(out["file_id"] == "two") & out["old_idx"].between(3300, 4200)]
    assert good["one"] > 0.95 and not middle["good"].any()


def test_files_of_unlike_gain(spark):
    """Margins and doublets of a file do not depend on the files beside it."""
    rows = []
    for f, gain in (("one", 1.0), ("two", 3.0)):
        for k in range(2000):
            ratio = gain * (1 + 0.02 * ((k * 0.618) % 1)) * (2 if k % 50 == 7 else 1)
            rows.append((f, k, 100.0 * ratio, 100.0, gain * (k % 100)))
    df = spark.createDataFrame(rows, "file_id string, event_idx long, `FSC-A` double, `FSC-H` double, `FL1-A` double")
    single = lambda d: {(r["file_id"], r["event_idx"]) for r in doublets(d, "FSC-A", "FSC-H", "file_id").where("single").collect()}
    both, alone = single(df), [single(df.where(f"file_id = '{f}'")) for f in ("one", "two")]
    assert both == alone[0] | alone[1] and len(both) == 2 * 1960
    ranges = {"FL1-A": (0.0, 50.0), "FSC-A": None}
    inner = lambda d: {(r["file_id"], r["event_idx"]) for r in margins(d, ranges, "file_id")[0].where("not in_margin").collect()}
    both, alone = inner(df), [inner(df.where(f"file_id = '{f}'")) for f in ("one", "two")]
    assert both == alone[0] | alone[1] and alone[0] and alone[1]


def test_reports_and_panels(spark, tmp_path):
    i = np.arange(6000)
    v = 500 + 50 * ((i * 0.6180339887) % 1 + (i * 0.7548776662) % 1)
    v[2000:2600] += 4000
    rows = [(f, int(k), float(k) / 100, float(x)) for f in ("a/x", "b/x") for k, x in zip(i, v if f == "a/x" else 500 + 0 * v + (i * 0.618 % 1))]
    df = spark.createDataFrame(rows, "file_id string, event_idx long, time double, `FL1-A` double").coalesce(2)
    config = Config(("FL1-A",), per_bin=200, mode="mad", by=("file_id",))
    reports = metadata(summary(df, config), config)
    got = {r["file_id"]: r for r in reports.collect()}
    assert got["a/x"]["n_events_before"] == 6000 and got["a/x"]["it_percentage"] is None and got["a/x"]["config"]["qc_mode"] == "mad" and got["a/x"]["channels_analyzed"] == ["FL1-A"]
    assert got["a/x"]["n_events_removed"] >= 600 > got["b/x"]["n_events_removed"]
    write_reports(reports, str(tmp_path / "each"))
    assert {json.loads(r["value"])["n_bins"] for r in spark.read.text(str(tmp_path / "each")).collect()} == {60}
    write_reports(reports, str(tmp_path / "all"), per_file=False)
    whole = json.loads(spark.read.text(str(tmp_path / "all")).first()["value"])
    assert whole["total_files"] == whole["successful"] == 2 and [r["file_id"] for r in whole["results"]] == ["a/x", "b/x"]
    cleaned = quality_control(df, config)
    panel = time_panel(cleaned, "time", 200, "file_id").where("file_id = 'a/x'").toPandas()
    assert len(panel) == 60 and (panel["rate"] > 90).all() and 0 < (~panel["good"]).sum() < 25
    bins, _ = bin_verdicts(df, config)
    told = bin_report(df, bins, 200, "time", "file_id")
    row = told.where("file_id = 'a/x' and bin = 22").first()
    assert (row["start"], row["end"], row["n"], row["outlier"], row["mad"]) == (2200, 2400, 200, True, True)
    assert rate_correlation(told, "file_id").count() == 2
    flat = write_flags(flags(cleaned), str(tmp_path / "flags")) or spark.read.option("header", True).csv(str(tmp_path / "flags"))
    assert flat.count() == 12000 and set(flat.columns) == {"good", "file_id"}
    assert set(with_quality(cleaned, "QC").columns) == {"file_id", "event_idx", "time", "FL1-A", "QC"}
    feats = spark.createDataFrame([("f", b, "c", 1, 10.0 + (b % 3) + 100 * (b == 30)) for b in range(60)], "file_id string, bin int, channel string, cluster int, value double")
    band = channel_panel(feats, 6.0, "file_id").toPandas().set_index("bin")
    assert len(band) == 60 and band.loc[30, "smooth"] > band.loc[30, "high"] and (band["smooth"] > band["high"]).sum() < 10


def test_bins_of_each_file(spark):
    """A file's bins do not depend on the files beside it."""
    files = {"small": 2000, "large": 5000}
    rows = [(f, i, 500 + 50 * ((i * 0.6180339887) % 1 + (i * 0.7548776662) % 1) + 4000 * (f == "small" and 1000 <= i < 1300)) for f, n in files.items() for i in range(n)]
    df = spark.createDataFrame(rows, "file_id string, event_idx long, `FL1-A` double").coalesce(2).cache()
    config = Config(("FL1-A",), mode="mad", max_bins=10, by=("file_id",))
    sizes = {r["file_id"]: (r["n_bins"], r["events_per_bin"]) for r in summary(df, config).collect()}
    assert sizes == {f: (bin_count(n, events_per_bin(n, 150, 10)), events_per_bin(n, 150, 10)) for f, n in files.items()}


def test_grid():
    assert [grid(n) for n in (1, 2, 3, 5, 7, 10)] == [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 3)]
