"""Polygons on a lattice.

A pixel takes the burn value of the last feature that touches it: whose inside shares more than an edge or a corner
with the pixel's inside.  Rectangles are exploded with built-in functions.  Of other polygons the edges are dealt, each to the
bands of rows that it passes through, so a band of a feature gets the edges that matter there and no others; a
task walks them row by row and gives spans of columns.  Spans become pixels, and the last feature of a pixel is found by
an aggregate over (y, x) with partial results: neither a large feature nor a busy latitude is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DataType
from gridloom.plans.geometry import Area, MapProjection, Window, _covering
from gridloom.plans.layer import Data

EPS = 1e-9
#: Rows of a band.
BAND = 64


def spans(edges: np.ndarray, y0: int, y1: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(row, [(first column, end column)]) of the cells of rows y0 to y1 that the polygon's inside overlaps.

    edges: (n, 4) of x, y, x, y in cell units; those that pass through no row may be missing.
    """
    if not len(edges):
        return
    ax, ay, bx, by = edges.T
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    for row in range(max(y0, int(np.floor(low.min() + EPS))), min(y1, int(np.ceil(high.max() - EPS)))):
        inside = (low < row + 1 - EPS) & (high > row + EPS)
        x1, v1, x2, v2 = edges[inside].T
        level = v1 == v2
        with np.errstate(divide="ignore", invalid="ignore"):
            ends = np.sort([(row - v1) / (v2 - v1), (row + 1 - v1) / (v2 - v1)], axis=0)
        t0, t1 = np.where(level, 0.0, np.maximum(ends[0], 0.0)), np.where(level, 1.0, np.minimum(ends[1], 1.0))
        left, right = np.sort([x1 + t0 * (x2 - x1), x1 + t1 * (x2 - x1)], axis=0)  # the part of each edge in the open row
        upright = right - left < EPS  # a line between two cells touches neither
        first = np.where(upright, np.floor(left), np.floor(left + EPS))
        end = np.where(upright, np.where(np.abs(left - np.round(left)) > EPS, first + 1, first), np.ceil(right - EPS))
        mid = row + 0.5  # the rest of the inside: cells between crossings of the row's middle
        cross = (low <= mid) & (high > mid)
        xs = np.sort(ax[cross] + (mid - ay[cross]) / (by[cross] - ay[cross]) * (bx[cross] - ax[cross]))
        xs = xs[: len(xs) // 2 * 2]
        parts = sorted(zip([*first.tolist(), *np.floor(xs[::2] + EPS).tolist()], [*end.tolist(), *np.ceil(xs[1::2] - EPS).tolist()], strict=True))
        out: list[tuple[int, int]] = []
        for a, b in parts:
            if b <= a:
                continue
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], int(b)))
            else:
                out.append((int(a), int(b)))
        if out:
            yield row, out


def touched(rings: Sequence[np.ndarray], y0: int, y1: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, columns) of the cells of rows y0 to y1 that the polygon's inside overlaps; rings in cell units (x, y)."""
    edges = [np.zeros((0, 4))]
    for ring in rings:
        pts = np.asarray(ring, float)
        if len(pts) > 1:
            edges.append(np.hstack([pts, np.roll(pts, -1, axis=0)]))
    for row, own in spans(np.vstack(edges), y0, y1):
        yield row, np.concatenate([np.arange(a, b) for a, b in own])


class Shapes(Data):
    """Features as a layer: burn values inside, 0 elsewhere."""

    def __init__(self, features: DataFrame, area: Area, datatype: DataType, name: str = ""):
        """features: priority (later wins), burn, and either left, top, right, bottom or rings (in map units)."""
        super().__init__(area, datatype, None, name)
        self.features = features

    def pixels(self, w: Window) -> DataFrame:
        p, (dx, dy) = self.projection, self.area.grid_offset
        kind = "double" if self.datatype.is_float else "bigint"
        cells = self._rectangles(w, p, dx, dy) if "left" in self.features.columns else self._polygons(w, p, dx, dy)
        return cells.groupBy("y", "x").agg(F.max_by("burn", "priority").cast(kind).alias("v"))

    def _rectangles(self, w: Window, p: MapProjection, dx: float, dy: float) -> DataFrame:
        def cells(a: str, b: str, off: float, step: float, first: int, end: int) -> tuple[Column, Column]:
            lo, hi = (F.col(a) - off) / step, (F.col(b) - off) / step
            return F.greatest(F.floor(lo + EPS), F.lit(first)), F.least(F.ceil(hi - EPS), F.lit(end)) - 1

        y0, y1 = cells("top", "bottom", dy, p.ystep, w.yoff, w.yend)
        x0, x1 = cells("left", "right", dx, p.xstep, w.xoff, w.xend)
        held = self.features.select("priority", "burn", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1")).filter("y1 >= y0 and x1 >= x0")
        dealt = _banded(held)
        own = F.sequence(F.greatest("y0", F.col("band") * BAND), F.least("y1", F.col("band") * BAND + (BAND - 1)))
        rows = dealt.select("priority", "burn", "x0", "x1", F.explode(own).alias("y"))
        return rows.select("priority", "burn", "y", F.explode(F.sequence("x0", "x1")).alias("x"))

    def _polygons(self, w: Window, p: MapProjection, dx: float, dy: float) -> DataFrame:
        held = self.features.filter("rings is not null").select(F.monotonically_increasing_id().alias("feature"), F.col("priority").cast("bigint").alias("priority"), F.col("burn").cast("double").alias("burn"), F.explode("rings").alias("ring"))
        following = lambda i: F.get("ring", (i + 1) % F.size("ring"))
        pairs = F.transform("ring", lambda a, i: F.struct(((a["x"] - dx) / p.xstep).alias("x1"), ((a["y"] - dy) / p.ystep).alias("y1"), ((following(i)["x"] - dx) / p.xstep).alias("x2"), ((following(i)["y"] - dy) / p.ystep).alias("y2")))
        edges = held.select("feature", "priority", "burn", F.explode(pairs).alias("e")).select("feature", "priority", "burn", "e.*")
        low, high = F.greatest(F.least("y1", "y2"), F.lit(float(w.yoff))), F.least(F.greatest("y1", "y2"), F.lit(float(w.yend)))
        bands = F.sequence(F.floor(low / BAND), F.floor(high / BAND))
        dealt = edges.filter(low <= high).select("*", F.explode(bands).alias("band"))

        def run(part: pa.Table) -> pa.Table:
            band, priority, burn = (part[c][0].as_py() for c in ("band", "priority", "burn"))
            walked = np.stack([part[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
            out = [(row, max(a, w.xoff), min(b, w.xend) - 1) for row, own in spans(walked, max(w.yoff, band * BAND), min(w.yend, (band + 1) * BAND)) for a, b in own if a < w.xend and b > w.xoff]
            y, x0, x1 = zip(*out, strict=True) if out else ((), (), ())
            columns = [pa.array([priority] * len(out), pa.int64()), pa.array([burn] * len(out), pa.float64()), *(pa.array(c, pa.int64()) for c in (y, x0, x1))]
            return pa.Table.from_arrays(columns, ["priority", "burn", "y", "x0", "x1"])

        walked = dealt.groupBy("feature", "band").applyInArrow(run, "priority long, burn double, y long, x0 long, x1 long")
        return walked.select("priority", "burn", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def _banded(features: DataFrame) -> DataFrame:
    """Each feature once for every band of its rows y0 to y1; the bands of a feature are dealt out."""
    bands = F.sequence(F.floor(F.col("y0") / BAND), F.floor(F.col("y1") / BAND))
    return features.withColumn("band", F.explode(bands)).repartition("priority", "band")


def footprint(left: float, top: float, right: float, bottom: float, projection: MapProjection, anchor: tuple[float, float] = (0.0, 0.0)) -> Area:
    """The pixels round an envelope on the lattice through ``anchor``."""
    own = Area(anchor[0], anchor[1], anchor[0] + projection.xstep, anchor[1] + projection.ystep, projection).grid_offset
    w = _covering(left - own[0], top - own[1], right - own[0], bottom - own[1], projection)
    return Area.of_window(w, projection, own)
