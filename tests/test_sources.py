"""FCS files and keywords, Gating-ML."""

import numpy as np
import pytest

from cytospark.errors import FormatError, GateError
from cytospark.operators.gates import Boolean, Ellipse, Gate, GateSet, Polygon, Rectangle
from cytospark.sources import fcs, gatingml
from cytospark.sources import keywords as K


@pytest.mark.parametrize("key,value,kind,want", [
    ("$PAR", "12", "int", 12), ("$TOT", "x", "other", "x"), ("$FIL", "a.fcs", "string", "a.fcs"), ("GUID", "g", "string", "g"),
    ("$BYTEORD", "1,2,3,4", "byte", "1,2,3,4"), ("$P1N", "FSC-A", "string", "FSC-A"), ("$P123N", "x", "string", "x"), ("$P3G", "1,5", "float", 1.5),
    ("$P4E", "4.0,1", "mixed", (4.0, 1.0)), ("$P4E", "1,5,2,5", "mixed", (1.5, 2.5)), ("$P5R", "262144", "int", 262144), ("$P1L", "(488)", "mixed", [488.0]),
    ("$P1L", "488,532", "mixed", [488.0, 532.0]), ("$P2D", "Linear,0,100", "mixed", {"kind": "Linear", "low": 0.0, "high": 100.0}), ("$P2D", "Odd,0,1", "other", "Odd,0,1"),
    ("$P1DISPLAY", "LOG", "string", "LOG"), ("$P1TYPE", "Area", "string", "Area"), ("MYKEY", "v", "string", "v"), ("$P1Q", "v", "other", "v"),
    ("$SPILLOVER", "2,A,B,1,0.1,0.15,1", "mixed", {"n": 2, "names": ["A", "B"], "values": [1.0, 0.1, 0.15, 1.0]}), ("$SPILLOVER", "2,A,B,1", "other", "2,A,B,1"),
])
def test_typed(key, value, kind, want):
    assert K.typed(key, value) == (kind, want)


def test_tokenize_keeps_doubled_delimiters_and_the_last_pair():
    assert K.tokenize("/$A/1//2/b/ x /$C/3/") == {"$A": "1/2", "$B": "x", "$C": "3"}
    assert K.tokenize("|k|v") == {"$K": "v"}


def make(tmp_path, kinds, order=">", name="x.fcs", zero=False, extra="", rows=7):
    """A file written field by field, apart from the writer."""
    cols = [np.arange(rows) * (i + 1) + 0.5 * (k[0] == "f") for i, k in enumerate(kinds)]
    row = np.dtype([(f"p{i}", order + k) for i, k in enumerate(kinds)])
    data = np.zeros(rows, row)
    for i, c in enumerate(cols):
        data[f"p{i}"] = c
    code = {"u": "I", "f": "F"}
    kw = {"$BYTEORD": "4,3,2,1" if order == ">" else "1,2,3,4", "$DATATYPE": {"u2": "I", "u4": "I", "f4": "F", "f8": "D"}[kinds[0]], "$MODE": "L", "$NEXTDATA": "0", "$PAR": len(kinds), "$TOT": rows,
          "$BEGINANALYSIS": 0, "$ENDANALYSIS": 0, "$BEGINSTEXT": 0, "$ENDSTEXT": 0}
    for i, k in enumerate(kinds, 1):
        kw |= {f"$P{i}N": f"C{i}-A", f"$P{i}B": int(k[1]) * 8, f"$P{i}R": 1024, f"$P{i}E": "0,0", f"$P{i}DATATYPE": "D" if k == "f8" else code[k[0]]}
    text = lambda a, b: ("\f" + "".join(f"{k}\f{v}\f" for k, v in {**kw, "$BEGINDATA": f"{a:8}", "$ENDDATA": f"{b:8}"}.items()) + extra).encode()
    start = 58 + len(text(0, 0))
    end = start + data.nbytes - 1
    at = [58, start - 1, 0 if zero else start, 0 if zero else end, 0, 0]
    path = tmp_path / name
    path.write_bytes(b"FCS3.1    " + b"".join(f"{o:8}".encode() for o in at) + text(start, end) + data.tobytes())
    return path, cols


@pytest.mark.parametrize("kinds", [["u2"] * 3, ["u4"] * 2, ["f4"] * 4, ["f8"] * 2, ["u2", "f4", "u4", "f8"]])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("zero", [False, True])
def test_read(spark, tmp_path, kinds, order, zero):
    path, cols = make(tmp_path, kinds, order, zero=zero)
    fcs.register(spark)
    got = spark.read.format("fcs").load(str(path)).orderBy("event_idx").toPandas()
    assert list(got["event_idx"]) == list(range(7)) and set(got["file_id"]) == {"x"}
    for i, c in enumerate(cols, 1):
        np.testing.assert_allclose(got[f"C{i}-A"], c)


def test_binary_rows_give_the_same_events(spark, tmp_path):
    make(tmp_path, ["f4"] * 2)
    binary = spark.read.format("binaryFile").load(str(tmp_path))
    assert fcs.events_from_binary(binary, ["C1-A", "C2-A"]).count() == 7


def test_round_trip(spark, tmp_path):
    rows = [(f"f{k}", i, float(i * k), float(-i)) for k in (1, 2, 3) for i in range(50)]
    df = spark.createDataFrame(rows, "file_id string, event_idx long, `FSC-A` float, `FL1-A` float")
    fcs.register(spark)
    fcs.by_file(df).write.format("fcs").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("fcs").load(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    kw, par = fcs.catalogue(spark, str(tmp_path / "out"))
    assert {r["value"] for r in kw.where("key = '$TOT'").collect()} == {"50"}
    assert [r["transform"] for r in par.where("file_id = 'f1'").orderBy("number").collect()] == ["linear", "arcsinh"]


def test_equal_names_in_two_folders(spark, tmp_path):
    """Files stay apart, and the writer gives each its place again."""
    for k, folder in enumerate(("a", "b")):
        (tmp_path / folder).mkdir()
        make(tmp_path / folder, ["f4"] * 2, rows=5 + k)
    fcs.register(spark)
    df = spark.read.format("fcs").load(str(tmp_path))
    assert {r["file_id"]: r["count"] for r in df.groupBy("file_id").count().collect()} == {"a/x": 5, "b/x": 6}
    fcs.by_file(df).write.format("fcs").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("fcs").load(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.where("file_id in ('a/x', 'b/x')").collect()))
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "out"))
    assert {r[0] for r in fcs.events_from_binary(binary, ["C1-A", "C2-A"], str(tmp_path / "out")).select("file_id").collect()} == {"a/x", "b/x"}
    kw, _ = fcs.catalogue(spark, str(tmp_path / "out"), a_task=1)
    assert {r["file_id"]: r["value"] for r in kw.where("key = '$TOT'").collect()} == {"a/x": "5", "b/x": "6"}


def test_large_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    make(tmp_path, ["f4"] * 3, rows=1000)
    monkeypatch.setattr(fcs, "SPLIT", 2000)
    parts = fcs.Reader(str(tmp_path), ["C1-A", "C2-A", "C3-A"]).partitions()
    got = [i for p in parts for b in fcs.Reader(str(tmp_path), ["C1-A", "C2-A", "C3-A"]).read(p) for i in b.column(1).to_pylist()]
    assert len(parts) > 5 and got == list(range(1000))


def test_failed_writes_leave_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    fcs.register(spark)
    df = spark.range(100).selectExpr("'f' || id div 50 as file_id", "id % 50 as event_idx", "cast(id as float) as `FL1-A`")
    bad = df.withColumn("FL1-A", F.when(F.col("file_id") == "f1", F.raise_error(F.lit("no"))).otherwise(F.col("FL1-A")).cast("float"))
    with pytest.raises(Exception):  # noqa: B017
        fcs.by_file(bad).write.format("fcs").mode("append").save(str(tmp_path / "out"))
    split = df.where("file_id = 'f0'").repartition(3, "event_idx")
    with pytest.raises(Exception):  # noqa: B017
        split.write.format("fcs").mode("append").save(str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("*.fcs"))


def test_required_keywords():
    def lacking(version):
        return K.missing(version, {})

    assert [len(lacking(v)) for v in ("FCS1.0", "FCS2.0", "FCS3.0", "FCS3.1", "FCS3.2", "FCS4.0")] == [0, 5, 12, 12, 8, 11]
    assert {"$BTIM", "$ETIM", "$DATE", "$CYT"} <= set(lacking("FCS4.0")) and not {"$BEGINSTEXT", "$ENDSTEXT", "$MODE"} & set(lacking("FCS4.0"))
    assert "$MODE" not in lacking("FCS3.2") and "$MODE" in lacking("FCS3.0")


def test_copy_add_column_and_json(tmp_path):
    import json

    path, cols = make(tmp_path, ["f4"] * 2)
    fcs.copy(str(path), str(tmp_path / "y.fcs"))
    assert (tmp_path / "y.fcs").read_bytes() == path.read_bytes()
    fcs.add_column(str(path), str(tmp_path / "z.fcs"), "QC", np.arange(7) % 2, "quality")
    at = fcs.open_layout(str(tmp_path / "z.fcs"))
    raw = (tmp_path / "z.fcs").read_bytes()[at.start :]
    assert at.names == ["C1-A", "C2-A", "QC"] and at.keywords["$PAR"] == "3" and at.keywords["$P3S"] == "quality"
    np.testing.assert_allclose(fcs.decode(raw, at.row), [*cols, np.arange(7) % 2])
    with pytest.raises(FormatError):
        fcs.add_column(str(path), str(tmp_path / "z.fcs"), "C1-A", np.zeros(7))
    assert json.loads(K.as_json(at.keywords)) == at.keywords and K.is_uuid4("9a4ff0a5-7a1c-4f5e-8d2c-0a1b2c3d4e5f") and not K.is_uuid4("x")
    with pytest.raises(FormatError):
        K.as_json({})
    big = fcs.encode(["A"], [np.arange(5)], order=">")
    at = fcs.layout(lambda s, n: big[s : s + n], len(big))
    assert at.row[0].byteorder == ">" and list(fcs.decode(big[at.start :], at.row)[0]) == [0, 1, 2, 3, 4]


def test_each_file_by_its_own_matrix(spark):
    from cytospark.operators.compensation import compensate, compensate_files, default_biexponential

    rows = [(f, i, float(i + 1), float(2 * i), float(i)) for f in ("one", "two", "none") for i in range(4)]
    df = spark.createDataFrame(rows, "file_id string, event_idx long, A double, B double, C double")
    texts = {"one": "2,A,B,1,0.1,0.15,1", "two": "2,C,A,1,0.3,0,1"}
    kw = spark.createDataFrame([(f, "$SPILLOVER", v) for f, v in texts.items()] + [("none", "$TOT", "4")], "file_id string, key string, value string")
    got = {(r["file_id"], r["event_idx"]): (r["A"], r["B"], r["C"]) for r in compensate_files(df, kw, ["A", "B", "C"]).collect()}
    want = [("none", ["A"], [[1.0]]), ("one", ["A", "B"], [[1, 0.1], [0.15, 1]]), ("two", ["C", "A"], [[1, 0.3], [0, 1]])]
    for f, names, m in want:
        for r in compensate(df.where(f"file_id = '{f}'"), m, names).collect():
            assert np.allclose(got[f, r["event_idx"]], (r["A"], r["B"], r["C"]))
    assert default_biexponential(df.select("A", "B")).first()["B"] == 0


def test_edit_keywords(tmp_path):
    path, _ = make(tmp_path, ["f4"] * 2)
    fcs.edit_keywords(str(path), lambda k: k | {"$FIL": "a|b"})
    at = fcs.open_layout(str(path))
    assert at.keywords["$FIL"] == "a|b" and at.events == 7


def test_malformed(tmp_path):
    path, _ = make(tmp_path, ["f4"])
    good = path.read_bytes()
    for bad in (b"FCS9.9" + good[6:], good[:6] + b"xxxx" + good[10:], good[:-5], good.replace(b"$BYTEORD", b"$BITEORD"), b"FCS"):
        path.write_bytes(bad)
        with pytest.raises(FormatError):
            fcs.open_layout(str(path))
    with pytest.raises(FormatError):
        fcs.files(str(tmp_path / "x.txt"))


GATES = [
    Gate("r", Rectangle((1.0, 2.0), (3.0, 4.0), half_open=True), "A", "B", "r"), Gate("p", Polygon(((0.0, 0.0), (2.0, 0.0), (1.0, 3.0))), "A", "B", "p"),
    Gate("b", Boolean("and", ("r", "n")), "", "", "b"), Gate("n", Boolean("not", ("p",)), "", "", "n"),
]


def test_gatingml_round_trip():
    assert gatingml.read(gatingml.write(GATES)) == GATES
    e = Gate("e", Ellipse((1.0, 2.0), 3.0, 1.5, 0.4), "A", "B", "e")
    (back,) = gatingml.read(gatingml.write([e]))
    assert np.allclose([back.geometry.rx, back.geometry.ry, back.geometry.angle], [3.0, 1.5, 0.4])


def test_gatingml_1_5():
    xml = """<g:Gating-ML xmlns:g="http://x/gating" xmlns:d="http://x/data">
      <g:RectangleGate g:id="one"><g:dimension g:min="1" g:max="5"><d:parameter d:name="A"/></g:dimension></g:RectangleGate>
      <g:PolygonGate g:id="poly" g:parent_id="one"><g:dimension><d:parameter d:name="A"/></g:dimension><g:dimension><d:parameter d:name="B"/></g:dimension>
        <g:vertex><g:coordinate d:value="0"/><g:coordinate d:value="0"/></g:vertex><g:vertex><g:coordinate d:value="9"/><g:coordinate d:value="0"/></g:vertex>
        <g:vertex><g:coordinate d:value="0"/><g:coordinate d:value="9"/></g:vertex></g:PolygonGate>
      <g:BooleanGate g:id="nb"><g:and><g:gateReference g:ref="poly" g:use-as-complement="true"/>
        <g:RectangleGate g:id="inner"><g:dimension g:min="0"><d:parameter d:name="B"/></g:dimension></g:RectangleGate></g:and></g:BooleanGate></g:Gating-ML>"""
    gates = {g.id: g for g in gatingml.read(xml)}
    assert gates["one"].geometry == Rectangle((1.0, 1.0), (5.0, 5.0), half_open=True) and gates["one"].x == gates["one"].y == "A"
    assert gates["poly"].geometry == Boolean("and", ("one", "poly:own")) and gates["nb"].geometry == Boolean("and", ("poly:not", "inner"))


def test_gate_errors(spark):
    s = GateSet([Gate("a", Boolean("and", ("b", "c"))), Gate("b", Boolean("not", ("a",))), Gate("c", Boolean("or", ("a",)))])
    for g in ("a", "c", "zz"):
        with pytest.raises(GateError):
            s.condition(g)
