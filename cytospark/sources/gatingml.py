"""Gating-ML: reading 1.5 and 2.0 gates, writing 2.0."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET

from ..errors import FormatError
from ..operators.gates import Boolean, Ellipse, Gate, Polygon, Rectangle

V2 = "http://www.isac-net.org/std/Gating-ML/v2.0/gating"
DATA = "http://www.isac-net.org/std/Gating-ML/v2.0/datatypes"


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str, default: str | None = None) -> str | None:
    for k, v in e.attrib.items():
        if k.rpartition("}")[2] == name:
            return v
    return default


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _tag(x) == name]


def _children(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e if _tag(x) == name]


def _channels(gate: ET.Element) -> list[str]:
    out = []
    for d in _children(gate, "dimension"):
        found = [x for x in d.iter() if _tag(x) in ("parameter", "fcs-dimension")]
        if not found:
            raise FormatError("a dimension without a parameter")
        out.append(_attr(found[0], "name") or "")
    return out


def _rectangle(gate: ET.Element) -> tuple[Rectangle | Boolean, list[str], list[Gate]]:
    """One dimension stands for both; over two, a conjunction of rectangles."""
    names, lows, highs = _channels(gate), [], []
    for d in _children(gate, "dimension"):
        lows.append(float(_attr(d, "min", "-inf")))
        highs.append(float(_attr(d, "max", "inf")))
    if not names:
        raise FormatError("a rectangle without dimensions")
    if len(names) == 1:
        return Rectangle((lows[0],) * 2, (highs[0],) * 2, half_open=True), names * 2, []
    if len(names) == 2:
        return Rectangle(tuple(lows), tuple(highs), half_open=True), names, []
    ident = _attr(gate, "id") or ""
    parts = [Gate(f"{ident}:{n}", Rectangle((a,) * 2, (b,) * 2, half_open=True), n, n) for n, a, b in zip(names, lows, highs, strict=True)]
    return Boolean("and", tuple(p.id for p in parts)), names[:2], parts


def _numbers(e: ET.Element, name: str) -> list[float]:
    return [float(_attr(x, "value")) for x in _all(e, name)]


def _polygon(gate: ET.Element) -> Polygon:
    nodes = []
    for v in _children(gate, "vertex"):
        c = _numbers(v, "coordinate") or [float(x.text) for x in _children(v, "position")]
        nodes.append(tuple(c[:2]))
    return Polygon(tuple(nodes))


def _ellipse(gate: ET.Element) -> Ellipse:
    """From mean, covariance and squared distance: half axes are square roots of its eigenvalues times the distance."""
    mean = _numbers(gate, "coordinate")[:2]
    rows = [[float(_attr(x, "value")) for x in _children(r, "entry")] for r in _all(gate, "row")]
    dist = float(_attr(_all(gate, "distanceSquare")[0], "value"))
    if len(mean) < 2 or [len(r) for r in rows] != [2, 2]:
        raise FormatError("an ellipse needs two dimensions")
    (a, b), (_, d) = rows
    mid, half = (a + d) / 2, math.hypot((a - d) / 2, b)
    angle = 0.5 * math.atan2(2 * b, a - d)
    return Ellipse(tuple(mean), math.sqrt((mid + half) * dist), math.sqrt(max(mid - half, 0) * dist), angle)


def read(xml: str) -> list[Gate]:
    """All gates of a document, those defined inside booleans too; a parent is one more operand of a conjunction."""
    out: list[Gate] = []

    def gate(e: ET.Element) -> str:
        ident, kind, more = _attr(e, "id") or f"gate{len(out)}", _tag(e), []
        if kind == "RectangleGate":
            geometry, names, more = _rectangle(e)
        elif kind == "PolygonGate":
            geometry, names = _polygon(e), _channels(e)
        elif kind in ("EllipsoidGate", "EllipseGate"):
            geometry, names = _ellipse(e), _channels(e)
        else:
            op = next((x for x in e if _tag(x) in ("and", "or", "not")), None)
            if op is None:
                raise FormatError(f"boolean gate {ident} without an operation")
            ids = []
            for x in op:
                if _tag(x) == "gateReference":
                    ref = _attr(x, "ref")
                    if (_attr(x, "use-as-complement") or "") == "true":
                        out.append(Gate(f"{ref}:not", Boolean("not", (ref,))))
                        ref = f"{ref}:not"
                    ids.append(ref)
                elif _tag(x).endswith("Gate"):
                    ids.append(gate(x))
            geometry, names = Boolean(_tag(op), tuple(ids)), ["", ""]
        out.extend(more)
        if parent := _attr(e, "parent_id"):
            out.append(Gate(f"{ident}:own", geometry, names[0], names[1]))
            geometry, names = Boolean("and", (parent, f"{ident}:own")), ["", ""]
        out.append(Gate(ident, geometry, names[0], names[1], _attr(e, "name") or ident))
        return ident

    root = ET.fromstring(xml)
    for e in root:
        if _tag(e) in ("RectangleGate", "PolygonGate", "EllipsoidGate", "EllipseGate", "BooleanGate"):
            gate(e)
    return out


def write(gates: list[Gate]) -> str:
    """A 2.0 document that read() takes back."""
    ET.register_namespace("gating", V2)
    ET.register_namespace("data-type", DATA)
    g, d = (lambda n: f"{{{V2}}}{n}"), (lambda n: f"{{{DATA}}}{n}")
    root = ET.Element(g("Gating-ML"))

    def dimension(e: ET.Element, channel: str, low: float | None = None, high: float | None = None) -> None:
        x = ET.SubElement(e, g("dimension"))
        if low is not None and math.isfinite(low):
            x.set(g("min"), repr(float(low)))
        if high is not None and math.isfinite(high):
            x.set(g("max"), repr(float(high)))
        ET.SubElement(x, d("fcs-dimension")).set(d("name"), channel)

    for gate in gates:
        s = gate.geometry
        kind = {Rectangle: "RectangleGate", Polygon: "PolygonGate", Ellipse: "EllipsoidGate", Boolean: "BooleanGate"}[type(s)]
        e = ET.SubElement(root, g(kind), {g("id"): gate.id})
        if isinstance(s, Rectangle):
            dimension(e, gate.x, s.low[0], s.high[0])
            dimension(e, gate.y, s.low[1], s.high[1])
        elif isinstance(s, Boolean):
            op = ET.SubElement(e, g(s.op))
            for o in s.operands:
                ET.SubElement(op, g("gateReference")).set(g("ref"), o)
        else:
            dimension(e, gate.x)
            dimension(e, gate.y)
            if isinstance(s, Polygon):
                for n in s.nodes:
                    v = ET.SubElement(e, g("vertex"))
                    for c in n:
                        ET.SubElement(v, g("coordinate")).set(d("value"), repr(float(c)))
            else:
                m = ET.SubElement(e, g("mean"))
                for c in s.mid:
                    ET.SubElement(m, g("coordinate")).set(d("value"), repr(float(c)))
                cos, sin, a, b = math.cos(s.angle), math.sin(s.angle), s.rx**2, s.ry**2
                cov = ET.SubElement(e, g("covarianceMatrix"))
                for row in ((a * cos * cos + b * sin * sin, (a - b) * cos * sin), ((a - b) * cos * sin, a * sin * sin + b * cos * cos)):
                    r = ET.SubElement(cov, g("row"))
                    for c in row:
                        ET.SubElement(r, g("entry")).set(d("value"), repr(c))
                ET.SubElement(e, g("distanceSquare")).set(d("value"), "1")
    return ET.tostring(root, encoding="unicode")
