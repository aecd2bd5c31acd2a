"""Density rasters: pixels, counts, log scale, colours, packed chunks, axis ranges."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.transforms import Area, Linear, axis_spec, nice_number
from ..session import ship


def pixel(v: Column, low: float, high: float, size: int) -> Column:
    """floor of the scaled value; values out of range pile up on the edge pixels, NaN on the first."""
    p = F.floor((F.nanvl(v, F.lit(float(low))) - F.lit(float(low))) * F.lit(size / (high - low)))
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), p)).cast("int")


def counts(df: DataFrame, x: str, y: str, xr: tuple[float, float], yr: tuple[float, float], width: int = 400, height: int = 400, *by: str) -> DataFrame:
    px, py = pixel(F.col(f"`{x}`").cast("double"), *xr, width), pixel(F.col(f"`{y}`").cast("double"), *yr, height)
    return df.groupBy(*by, px.alias("px"), py.alias("py")).agg(F.count(F.lit(1)).alias("n"))


def log_density(raster: DataFrame, *by: str) -> DataFrame:
    """log10(n + 1) over the larger of 1 and its maximum, per plot."""
    v = F.log10(F.col("n") + 1)
    top = raster.groupBy(*by).agg(F.greatest(F.lit(1.0), F.max(v)).alias("top_"))
    x = raster.join(F.broadcast(top), list(by)) if by else raster.crossJoin(F.broadcast(top))  # a row a plot
    return x.withColumn("density", v / F.col("top_")).drop("top_")


def data_coordinates(raster: DataFrame, xr, yr, width: int = 400, height: int = 400) -> DataFrame:
    at = lambda p, r, n: F.col(p) / F.lit(n / (r[1] - r[0])) + F.lit(float(r[0]))
    return raster.withColumns({"x": at("px", xr, width), "y": at("py", yr, height)})


#: Corners of a blue-green-yellow gradient at 0, 1/4, 1/2, 3/4, 1.
GRADIENT = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))


#: Corners of named colour maps at equal steps, as red, green, blue.
COLOUR_MAPS = {
    "viridis": GRADIENT,
    "plasma": ((13, 8, 135), (126, 3, 168), (204, 71, 120), (248, 149, 64), (240, 249, 33)),
    "inferno": ((0, 0, 4), (87, 16, 110), (188, 55, 84), (249, 142, 9), (252, 255, 164)),
    "magma": ((0, 0, 4), (81, 18, 124), (183, 55, 121), (252, 137, 97), (252, 253, 191)),
    "turbo": ((35, 23, 27), (74, 88, 221), (47, 157, 245), (39, 215, 196), (77, 248, 132), (149, 251, 81), (222, 221, 50), (255, 164, 35), (246, 95, 24), (186, 34, 8), (144, 12, 0)),
    "cividis": ((0, 32, 81), (60, 77, 110), (127, 124, 117), (187, 175, 113), (253, 234, 69)),
    "warm": ((110, 64, 170), (191, 60, 175), (254, 75, 131), (255, 120, 71), (226, 183, 47), (175, 240, 91)),
    "cool": ((110, 64, 170), (76, 110, 219), (35, 171, 216), (29, 223, 163), (82, 246, 103), (175, 240, 91)),
    "cubehelix": ((0, 0, 0), (22, 83, 76), (160, 121, 73), (199, 180, 237), (255, 255, 255)),
    "rainbow": ((110, 64, 170), (254, 75, 131), (226, 183, 47), (82, 246, 103), (35, 171, 216), (110, 64, 170)),
    "jet": ((0, 0, 128), (0, 0, 255), (0, 128, 255), (0, 255, 255), (128, 255, 128), (255, 255, 0), (255, 128, 0), (255, 0, 0), (128, 0, 0)),
    "spectral": ((158, 1, 66), (213, 62, 79), (244, 109, 67), (253, 174, 97), (254, 224, 139), (255, 255, 191), (230, 245, 152), (171, 221, 164), (102, 194, 165), (50, 136, 189), (94, 79, 162)),
    "bone": ((0, 0, 0), (84, 84, 116), (169, 200, 200), (255, 255, 255)),
    "mandelbrot": ((255, 255, 255), (255, 191, 0), (128, 255, 0), (0, 255, 191), (0, 64, 255), (128, 0, 255), (0, 0, 0)),
    "black_white": ((0, 0, 0), (255, 255, 255)),
    "volcano": ((0, 0, 0), (128, 0, 0), (255, 64, 0), (255, 191, 64), (255, 255, 255)),
    "viridis_rgb": GRADIENT,
}


def colour(v: Column, name: str = "viridis") -> Column:
    """array<int> r, g, b of a density in 0..1 by linear interpolation between the named map's corners."""
    if name not in COLOUR_MAPS:
        raise EngineError(f"no colour map {name!r}")
    corners = COLOUR_MAPS[name]
    steps = len(corners) - 1
    k = F.least(F.lit(steps - 1), F.floor(v * steps)).cast("int")
    table = F.array(*(F.array(*map(F.lit, c)) for c in corners))
    t = v * steps - k
    return F.transform(F.array(*map(F.lit, range(3))), lambda i: F.round(table[k][i] * (1 - t) + table[k + 1][i] * t).cast("int"))


def packed(raster: DataFrame, *by: str) -> DataFrame:
    """One binary a plot: bounding box (four little-endian uint32), then r, g, b bytes of its pixels by rows."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, x1, y0, y1 = pdf["px"].min(), pdf["px"].max(), pdf["py"].min(), pdf["py"].max()
        data = np.zeros((y1 - y0 + 1, x1 - x0 + 1, 3), np.uint8)
        data[pdf["py"] - y0, pdf["px"] - x0] = np.array(pdf["rgb"].tolist(), np.uint8)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "chunk": [struct.pack("<4I", x0, y0, x1, y1) + data.tobytes()]})

    ship(raster.sparkSession)
    types = dict(raster.dtypes)
    return raster.groupBy(*by).applyInPandas(run, "".join(f"`{k}` {types[k]}, " for k in by) + "chunk binary")


@dataclass(frozen=True)
class Plot:
    """A density plot: area and title, each axis' channel, scale and range, and the colour map."""

    x: str
    y: str
    x_range: tuple[float, float] = (0.0, 200000.0)
    y_range: tuple[float, float] = (0.0, 200000.0)
    x_scale: object = Linear()
    y_scale: object = Linear()
    area: Area = Area()
    title: str = "Density Plot"
    colours: str = "viridis"

    def axes(self) -> tuple[Column, Column, Column, Column]:
        """Low and high of x, low and high of y, as drawn."""
        f = lambda r: (F.lit(float(r[0])), F.lit(float(r[1])))
        return (*axis_spec(self.x_scale, *f(self.x_range)), *axis_spec(self.y_scale, *f(self.y_range)))

    def draw(self, df: DataFrame, *by: str, progress=None, cancelled=None) -> DataFrame | None:
        """px, py, n, density, rgb of every plot (by). progress is told each step's name and share done; nothing is
        returned once cancelled says so."""
        size = [int(b - a) for a, b in (self.area.x_range, self.area.y_range)]
        steps = (
            ("counts", lambda d: counts(d, self.x, self.y, self.x_range, self.y_range, *size, *by)), ("density", lambda d: log_density(d, *by)),
            ("colour", lambda d: d.withColumn("rgb", colour(F.col("density"), self.colours))),
        )
        for k, (name, step) in enumerate(steps, 1):
            if cancelled and cancelled():
                return None
            df = step(df)
            if progress:
                progress(name, k / len(steps))
        return df


def axis_range(channel: str, bounds: tuple[Column, Column], top: Column) -> tuple[Column, Column]:
    """Scatter: 0..200000; time: 0..max; else percentile bounds rounded to nice numbers."""
    if "FSC" in channel or "SSC" in channel:
        return F.lit(0.0), F.lit(200000.0)
    if "Time" in channel:
        return F.lit(0.0), top
    return nice_number(bounds[0], up=False), nice_number(bounds[1])
