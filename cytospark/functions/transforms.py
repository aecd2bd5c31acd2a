"""Scale transforms, pixel maps and nice numbers as Column builders (constants folded on the driver)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default parameters of the scales.
ARCSINH_COFACTOR = 200.0
PREPROCESS_COFACTOR = 2000.0
BIEX_T, BIEX_M, BIEX_A, BIEX_W = 262144.0, 4.5, 0.0, 0.5


@dataclass(frozen=True)
class Linear:
    def forward(self, x: Column) -> Column:
        return x

    inverse = forward


@dataclass(frozen=True)
class Arcsinh:
    cofactor: float = ARCSINH_COFACTOR

    def forward(self, x: Column) -> Column:
        return F.asinh(x / F.lit(float(self.cofactor)))

    def inverse(self, y: Column) -> Column:
        return F.sinh(y) * F.lit(float(self.cofactor))


@dataclass(frozen=True)
class Biexponential:
    """asinh(x * sinh(M ln10) / T) + A ln10; the width W has no part in it. T = 0 is the identity."""

    t: float = BIEX_T
    m: float = BIEX_M
    a: float = BIEX_A
    w: float = BIEX_W

    @property
    def scale(self) -> float:
        return math.sinh(self.m * math.log(10))

    def forward(self, x: Column) -> Column:
        return x if self.t == 0 else F.asinh(x * F.lit(self.scale / self.t)) + F.lit(self.a * math.log(10))

    def inverse(self, y: Column) -> Column:
        return y if self.t == 0 else F.lit(self.t / self.scale) * F.sinh(y - F.lit(self.a * math.log(10)))


def from_name(name: str):
    """linear, arcsinh, biexponential or logicle; anything else is the default arcsinh."""
    return {"linear": Linear(), "arcsinh": Arcsinh(), "biexponential": Biexponential(), "logicle": Biexponential()}.get(name.strip().lower(), Arcsinh())


def short_exponent(x: Column) -> Column:
    """One decimal and an exponent without sign or leading zeros: 1.0e3, 2.5e-2."""
    s = F.format_string("%.1e", x)
    return F.regexp_replace(F.regexp_replace(s, r"e\+0*(\d+)$", "e$1"), r"e-0*(\d+)$", "e-$1")


def apply(df: DataFrame, scales: dict[str, object]) -> DataFrame:
    """Replace columns by their transforms, all in one projection."""
    return df.withColumns({c: s.forward(F.col(f"`{c}`")) for c, s in scales.items()})


def is_fluorescence(name: Column) -> Column:
    return ~F.upper(name).rlike("FSC|SSC|TIME")


def fluorescence_channels(columns: list[str]) -> list[str]:
    return [c for c in columns if not any(k in c.upper() for k in ("FSC", "SSC", "TIME"))]


@dataclass(frozen=True)
class Area:
    """A plot of width x height pixels; margins in the plot around the drawing area."""

    width: int = 400
    height: int = 400
    margin: int = 10
    x_label: int = 50
    y_label: int = 50

    @property
    def x_range(self) -> tuple[float, float]:
        return float(self.margin + self.y_label), float(self.width - self.margin)

    @property
    def y_range(self) -> tuple[float, float]:
        return float(self.margin), float(self.height - self.margin - self.x_label)


def to_pixel(v: Column, scale, low: float, high: float, area: tuple[float, float], flip: bool = False) -> Column:
    """Raw value to pixel in a range of transformed values; a range of no width maps to the area's start (end if flipped)."""
    start, end = area
    if high == low:
        return F.lit(end if flip else start)
    t = scale.forward(v)
    n = (F.lit(high) - t if flip else t - F.lit(low)) / F.lit(high - low)
    return F.lit(start) + n * F.lit(end - start)


def from_pixel(p: Column, scale, low: float, high: float, area: tuple[float, float], flip: bool = False) -> Column:
    """Pixel to raw value; pixels beyond the area count as its border."""
    start, end = area
    n = (F.lit(end) - p if flip else p - F.lit(start)) / F.lit(end - start)
    n = F.greatest(F.lit(0.0), F.least(F.lit(1.0), n))
    return scale.inverse(F.lit(low) + n * F.lit(high - low))


def nice_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds on multiples of the largest power of ten within the range; half a unit around a single value; 0..1 where a
    bound is not a number."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(high - low)))
    bad = F.isnan(low) | F.isnan(high) | (F.abs(low) == float("inf")) | (F.abs(high) == float("inf"))
    pick = lambda none, one, many: F.when(bad, F.lit(none)).when(high == low, one).otherwise(many)
    return pick(0.0, low - 0.5, F.floor(low / step) * step), pick(1.0, high + 0.5, F.ceil(high / step) * step)


def axis_spec(scale, low: Column, high: Column) -> tuple[Column, Column]:
    """An axis of transformed bounds: nice ones on a linear scale, as they are on others."""
    return nice_bounds(low, high) if isinstance(scale, Linear) else (low, high)


def nice_number(x: Column, up: bool = True) -> Column:
    """The nearest 1, 2, 5, 10 (up) or 0.5, 1, 2, 5 (down) times a power of ten that holds |x|; the sign stays, 0 is 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    m = F.abs(x) / power
    if up:
        nice = F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 5, 5.0).otherwise(10.0)
    else:
        nice = F.when(m >= 5, 5.0).when(m >= 2, 2.0).when(m >= 1, 1.0).otherwise(0.5)
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * nice * power)
