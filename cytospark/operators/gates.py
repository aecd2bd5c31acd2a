"""Gates: geometric and boolean event filters, compiled to boolean Columns and fused into one scan."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GateError

#: Above this many edges a polygon is tested by an array lambda: unrolled, its code would not compile.
MOST_EDGES = 60


def _finite(*v: float) -> None:
    if not all(math.isfinite(x) for x in v):
        raise GateError(f"coordinates must be finite: {v}")


@dataclass(frozen=True)
class Polygon:
    """Even-odd ray casting; an open polygon, or one of under three nodes, holds nothing."""

    nodes: tuple[tuple[float, float], ...]
    closed: bool = True

    def __post_init__(self):
        for n in self.nodes:
            _finite(*n)

    def valid(self) -> bool:
        return self.closed and len(self.nodes) >= 3

    def bounds(self):
        if len(self.nodes) < 3:
            return None
        xs, ys = zip(*self.nodes, strict=True)
        box = min(xs), min(ys), max(xs), max(ys)
        return box if box[0] < box[2] and box[1] < box[3] else None

    def center(self):
        n = len(self.nodes)
        return sum(x for x, _ in self.nodes) / n, sum(y for _, y in self.nodes) / n

    def test(self, x: Column, y: Column) -> Column:
        if not self.valid() or not (box := self.bounds()):
            return F.lit(False)
        # edges without height never cross a ray, and would divide by zero
        edges = [(*a, *b) for a, b in zip((self.nodes[-1], *self.nodes[:-1]), self.nodes, strict=True) if a[1] != b[1]]
        cross = lambda x1, y1, x2, y2: ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        if len(edges) <= MOST_EDGES:
            odd = F.lit(False)
            for e in edges:
                odd = odd != cross(*(F.lit(float(v)) for v in e))
        else:
            rows = F.array(*(F.array(*(F.lit(float(v)) for v in e)) for e in edges))
            odd = F.aggregate(rows, F.lit(False), lambda s, e: s != cross(e[0], e[1], e[2], e[3]))
        return x.between(box[0], box[2]) & y.between(box[1], box[3]) & odd


@dataclass(frozen=True)
class Rectangle:
    """Closed on all sides; half_open leaves the upper sides out."""

    low: tuple[float, float]
    high: tuple[float, float]
    half_open: bool = False

    def valid(self) -> bool:
        return self.low[0] < self.high[0] and self.low[1] < self.high[1]

    def bounds(self):
        return *self.low, *self.high

    def center(self):
        return (self.low[0] + self.high[0]) / 2, (self.low[1] + self.high[1]) / 2

    def test(self, x: Column, y: Column) -> Column:
        out = None
        for c, a, b in ((x, self.low[0], self.high[0]), (y, self.low[1], self.high[1])):
            for cond in ([] if a == -math.inf else [c >= F.lit(float(a))]) + ([] if b == math.inf else [c < F.lit(float(b)) if self.half_open else c <= F.lit(float(b))]):
                out = cond if out is None else out & cond
        return F.lit(True) if out is None else out


@dataclass(frozen=True)
class Ellipse:
    """Rotated by angle (radians); the border belongs to it."""

    mid: tuple[float, float]
    rx: float
    ry: float
    angle: float = 0.0

    def valid(self) -> bool:
        return self.rx > 0 and self.ry > 0

    def center(self):
        return self.mid

    def bounds(self):
        c, s = math.cos(self.angle), math.sin(self.angle)
        w, h = math.hypot(self.rx * c, self.ry * s), math.hypot(self.rx * s, self.ry * c)
        return self.mid[0] - w, self.mid[1] - h, self.mid[0] + w, self.mid[1] + h

    def test(self, x: Column, y: Column) -> Column:
        if not self.valid():
            return F.lit(False)
        c, s, box = F.lit(math.cos(self.angle)), F.lit(math.sin(self.angle)), self.bounds()
        dx, dy = x - F.lit(float(self.mid[0])), y - F.lit(float(self.mid[1]))
        u, v = (dx * c + dy * s) / F.lit(float(self.rx)), (dy * c - dx * s) / F.lit(float(self.ry))
        slack = 1e-9 * (1 + max(abs(b) for b in box))
        return x.between(box[0] - slack, box[2] + slack) & y.between(box[1] - slack, box[3] + slack) & (u * u + v * v <= F.lit(1.0))


@dataclass(frozen=True)
class Boolean:
    op: str
    operands: tuple[str, ...]

    def valid(self) -> bool:
        return len(self.operands) == 1 if self.op == "not" else self.op in ("and", "or") and len(self.operands) >= 2


@dataclass(frozen=True)
class Mode:
    """Which files a gate is for: all, one, or a group."""

    files: tuple[str, ...] | None = None

    def applies_to(self, file: str) -> bool:
        return self.files is None or file in self.files


@dataclass(frozen=True)
class Gate:
    id: str
    geometry: Polygon | Rectangle | Ellipse | Boolean
    x: str = ""
    y: str = ""
    name: str = ""
    mode: Mode = field(default_factory=Mode)


def rectangle_of(points) -> Rectangle:
    if len(points) < 2:
        raise GateError("a rectangle needs two points")
    xs, ys = zip(*points, strict=True)
    _finite(*xs, *ys)
    return Rectangle((min(xs), min(ys)), (max(xs), max(ys)))


def polygon_of(points) -> Polygon:
    if len(points) < 3:
        raise GateError("a polygon needs three points")
    return Polygon(tuple(map(tuple, points)))


def ellipse_of(points) -> Ellipse:
    """From centre, right, top, left, bottom; two to four points give the ellipse in their box, one a default."""
    for p in points:
        _finite(*p)
    if not points:
        raise GateError("an ellipse needs a point")
    if len(points) == 1:
        return Ellipse(points[0], 50.0, 50.0, 0.0)
    if len(points) < 5:
        xs, ys = zip(*points, strict=True)
        return Ellipse(((min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2), (max(xs) - min(xs)) / 2, (max(ys) - min(ys)) / 2, 0.0)
    (cx, cy), right, top = points[:3]
    return Ellipse((cx, cy), math.hypot(right[0] - cx, right[1] - cy), math.hypot(top[0] - cx, top[1] - cy), math.atan2(right[1] - cy, right[0] - cx))


class GateSet:
    """Gates by id, compiled recursively: booleans may hold booleans; cycles and missing operands are errors."""

    def __init__(self, gates):
        self.gates = {g.id: g for g in gates}

    def condition(self, gate: str, _above: tuple[str, ...] = ()) -> Column:
        """Whether an event is in the gate; an event with a null channel is not."""
        if gate not in self.gates:
            raise GateError(f"no gate {gate!r}")
        if gate in _above:
            raise GateError(f"gate {gate!r} is its own operand")
        g = self.gates[gate]
        if not isinstance(g.geometry, Boolean):
            return F.coalesce(g.geometry.test(F.col(f"`{g.x}`"), F.col(f"`{g.y}`")), F.lit(False))
        if not g.geometry.valid():
            raise GateError(f"{g.geometry.op} with {len(g.geometry.operands)} operands")
        parts = [self.condition(o, (*_above, gate)) for o in g.geometry.operands]
        if g.geometry.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if g.geometry.op == "and" else out | p
        return out

    def chain(self, ids) -> Column:
        """All gates from the root to a leaf; no gate lets every event pass."""
        out = F.lit(True)
        for i in ids:
            out = out & self.condition(i)
        return out

    def by_channels(self, x: str, y: str, file: str | None = None) -> list[Gate]:
        """Gates over two channels that apply to the file; without one, those for all files."""
        return [g for g in self.gates.values() if (g.x, g.y) == (x, y) and (g.mode.files is None if file is None else g.mode.applies_to(file))]


def filter_events(df: DataFrame, gates: GateSet, *ids: str) -> DataFrame:
    return df.where(gates.chain(ids))


def filter_mask(df: DataFrame, mask: DataFrame, keys: list[str], column: str = "keep") -> DataFrame:
    """Rows whose mask row is true, by key."""
    return df.join(mask.where(F.col(column)).select(*keys), keys, "left_semi")


def to_dict(g: Gate) -> dict:
    """A gate as JSON-ready values: geometry tagged by type, mode by name."""
    s = g.geometry
    kind = {Polygon: "Polygon", Rectangle: "Rectangle", Ellipse: "Ellipse", Boolean: "Boolean"}[type(s)]
    shape = {
        "Polygon": lambda: {"nodes": [list(n) for n in s.nodes], "closed": s.closed},
        "Rectangle": lambda: {"min": list(s.low), "max": list(s.high), "half_open": s.half_open},
        "Ellipse": lambda: {"center": list(s.mid), "radius_x": s.rx, "radius_y": s.ry, "angle": s.angle},
        "Boolean": lambda: {"operation": s.op, "operands": list(s.operands)},
    }[kind]()
    files = g.mode.files
    mode = {"name": "Global"} if files is None else {"name": "FileSpecific", "guid": files[0]} if len(files) == 1 else {"name": "FileGroup", "guids": list(files)}
    return {"id": g.id, "name": g.name, "geometry": {"type": kind, **shape}, "mode": mode, "parameters": [g.x, g.y]}


def from_dict(d: dict) -> Gate:
    s, m = d["geometry"], d["mode"]
    try:
        geometry = {
            "Polygon": lambda: Polygon(tuple(map(tuple, s["nodes"])), s["closed"]),
            "Rectangle": lambda: Rectangle(tuple(s["min"]), tuple(s["max"]), s.get("half_open", False)),
            "Ellipse": lambda: Ellipse(tuple(s["center"]), s["radius_x"], s["radius_y"], s["angle"]),
            "Boolean": lambda: Boolean(s["operation"], tuple(s["operands"])),
        }[s["type"]]()
        files = {"Global": lambda: None, "FileSpecific": lambda: (m["guid"],), "FileGroup": lambda: tuple(m["guids"])}[m["name"]]()
    except KeyError as e:
        raise GateError(f"gate {d.get('id')!r} lacks {e}") from e
    return Gate(d["id"], geometry, *d["parameters"], d["name"], Mode(files))


def with_file(mode: Mode, file: str) -> Mode:
    """The mode with a file more; a gate for all files stays one for all."""
    return mode if mode.files is None or file in mode.files else Mode((*mode.files, file))


def without_file(mode: Mode, file: str) -> Mode:
    return mode if mode.files is None else Mode(tuple(f for f in mode.files if f != file))
