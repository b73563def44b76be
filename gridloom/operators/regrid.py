"""Re-gridding to another step or coordinate system."""

from __future__ import annotations

import math
from collections.abc import Iterator
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DataType
from gridloom.plans import crs
from gridloom.plans.geometry import Area, MapProjection, Window, _covering
from gridloom.plans.layer import Data, Layer, joinable, within


class ResamplingMethod(Enum):
    Nearest = "nearest"
    Average = "average"
    Min = "min"
    Max = "max"
    Med = "med"
    Mode = "mode"
    RootMeanSquare = "rms"
    Sum = "sum"


def resampled(pieces: DataFrame, method: ResamplingMethod) -> DataFrame:
    """(y, x, v) of pieces (y, x, v, w): source values with the share of the source pixel that falls into the target.

    NaN pieces don't count, a target of NaN alone is NaN.  Ties of Mode go to the smallest value.
    """
    v, w = F.col("v").cast("double"), F.col("w")
    pieces = pieces.filter(w > 0)
    good = ~F.isnan(v)
    if method is ResamplingMethod.Mode:
        counts = pieces.groupBy("y", "x", v.alias("v")).agg(F.sum("w").alias("w"))
        rank = F.struct((~F.isnan("v")).alias("good"), F.round("w", 9).alias("w"), (-F.col("v")).alias("v"))
        best = counts.groupBy("y", "x").agg(F.max(rank).alias("b"))
        return best.select("y", "x", F.when(F.col("b.good"), -F.col("b.v")).otherwise(F.lit(float("nan"))).alias("v"))
    only = F.when(good, v)
    weight = F.sum(F.when(good, w))
    value = {
        ResamplingMethod.Nearest: F.max(only),
        ResamplingMethod.Average: F.sum(only * w) / weight,
        ResamplingMethod.Min: F.min(only),
        ResamplingMethod.Max: F.max(only),
        ResamplingMethod.Med: F.median(only),
        ResamplingMethod.RootMeanSquare: F.sqrt(F.sum(only * only * w) / weight),
        ResamplingMethod.Sum: F.sum(only * w),
    }[method]
    return pieces.groupBy("y", "x").agg(F.coalesce(value, F.lit(float("nan"))).alias("v"))


def alone(pieces: DataFrame, method: ResamplingMethod) -> DataFrame:
    """resampled, where each target has one piece: no aggregate is needed, so nothing is held or moved."""
    v = F.col("v").cast("double")
    value = {ResamplingMethod.Sum: v * F.col("w"), ResamplingMethod.RootMeanSquare: F.abs(v)}.get(method, v)
    return pieces.select("y", "x", value.alias("v"))


def _whole(ratio: float, lo: int, hi: int) -> bool:
    """Whether each source index from lo to hi is cut into whole targets; less than half of _axis's eps is noise."""
    k = round(ratio)
    return k >= 1 and abs(ratio - k) * max(abs(lo), abs(hi)) < 5e-10 * k


def _axis(c: str, ratio: float, name: str) -> tuple[Column, Column]:
    """(targets that a source index overlaps, share of the source in one of them); ratio: source step / target step."""
    a, b = F.col(c) * ratio, (F.col(c) + 1) * ratio
    eps = 1e-9 * max(1.0, ratio)
    cells = F.sequence(F.floor(a + eps), F.greatest(F.floor(a + eps), F.ceil(b - eps) - 1))
    t = F.col(name)
    return cells, F.greatest(F.least(b, t + 1) - F.greatest(a, t), F.lit(0.0)) / ratio


class Reprojected(Data):
    """A layer or expression on another lattice.

    With the same coordinate system every source pixel is dealt to the target pixels that it overlaps, by its shares,
    and one aggregate makes the targets; where the target's steps are whole fractions of the source's, each target has
    one piece and needs none.  Across coordinate systems each target is mapped back: points spread over it, at
    least 4 x 4 and two for each source pixel along either side, fall on the source pixels that it overlaps and tell by how
    much.  So no target that has data under it is left out, at any distortion.  For Nearest each target takes the source
    pixel under its centre.  Integer ratios of steps are exact.
    """

    def __init__(self, child: Layer, projection: MapProjection, method: ResamplingMethod):
        own = child.projection
        if own is None:
            raise ValueError("a layer without projection can't be reprojected")
        self.children, self.source, self.target, self.method = (child,), own, projection, ResamplingMethod(method)
        self.same = crs.lookup(own.name) == crs.lookup(projection.name)
        super().__init__(self._target_area(child.area), child.datatype)

    def _target_area(self, area: Area) -> Area:
        if self.source == self.target:
            return area
        if self.same:
            p = self.target
            w = _covering(area.left, area.top, area.right, area.bottom, p)
            return Area.of_window(w, p)
        return area.reproject(self.target)

    @property
    def datatype(self) -> DataType:
        return self.children[0].datatype

    def describe(self) -> str:
        return f"as_projection {self.target.name} {self.target.xstep} {self.method.name}"

    @property
    def dense(self) -> bool:
        """Whether every target has a source pixel: the child's frame has a row for each pixel of its area."""
        if self.source == self.target or not self.same:
            return False
        held, w = self.children[0].area.window, self.area.window
        sides = ((held.yoff, held.yend, w.yoff, w.yend), (held.xoff, held.xend, w.xoff, w.xend))
        return all(r > 0 and self._reached(lo, hi, r, first, last) for r, (lo, hi, first, last) in zip(self.ratios, sides, strict=True))

    def _reached(self, lo: int, hi: int, ratio: float, first: int, last: int) -> bool:
        """Whether the source pixels lo to hi - 1 of an axis are dealt to all targets first to last - 1, as in _rescaled."""
        if self.method is ResamplingMethod.Nearest:
            return math.ceil(lo * ratio - 0.5 - 1e-9) <= first and math.ceil(hi * ratio - 0.5 - 1e-9) >= last
        eps = 1e-9 * max(1.0, ratio)
        return math.floor(lo * ratio + eps) <= first and math.ceil(hi * ratio - eps) >= last

    @property
    def ratios(self) -> tuple[float, float]:
        """Source step / target step of rows and columns."""
        return self.source.ystep / self.target.ystep, self.source.xstep / self.target.xstep

    def pixels(self, w: Window) -> DataFrame:
        child = self.children[0]
        if self.source == self.target:
            return child.frame(w)
        held = Window.shared([self._source_window(w), child.area.window])
        if held is None:
            return child.frame(Window(child.area.window.xoff, child.area.window.yoff, 1, 1)).filter(F.lit(False))
        rows = child.frame(held).select("y", "x", F.col("v").cast("double").alias("v"))
        return within(self._rescaled(rows, held) if self.same else self._warped(joinable(rows, held), w), w)

    def _source_window(self, w: Window) -> Window:
        area = Area.of_window(w, self.target)
        if self.same:
            return _covering(area.left, area.top, area.right, area.bottom, self.source).grow(1)
        try:
            return area.reproject(self.source).window.grow(3)
        except ValueError:
            return self.children[0].area.window

    def _rescaled(self, rows: DataFrame, held: Window) -> DataFrame:
        ry, rx = self.ratios
        if self.method is ResamplingMethod.Nearest:
            for c, r in (("y", ry), ("x", rx)):  # targets whose centre lies in the source pixel
                first, last = F.ceil(F.col(c) * r - 0.5 - 1e-9), F.ceil((F.col(c) + 1) * r - 0.5 - 1e-9) - 1
                rows = rows.filter(last >= first).withColumn(c, F.explode(F.sequence(first, last)))
            return rows.select("y", "x", "v")
        for c, r in (("y", ry), ("x", rx)):
            cells, share = _axis(c, r, f"t{c}")
            rows = rows.withColumn(f"t{c}", F.explode(cells)).withColumn(f"w{c}", share)
        pieces = rows.select(F.col("ty").alias("y"), F.col("tx").alias("x"), "v", (F.col("wy") * F.col("wx")).alias("w"))
        if _whole(ry, held.yoff, held.yend) and _whole(rx, held.xoff, held.xend):
            return alone(pieces, self.method)
        return resampled(pieces, self.method)

    def _overlaps(self, targets: DataFrame, least: int) -> DataFrame:
        """(y, x, my, mx, w, size) of targets (y, x): the source pixels that they overlap, their shares of the target, and the
        target's size in source pixels, by least x least points or more (0: by their centres)."""
        source, target = self.source, self.target

        def mapped(x, y):
            mx, my = crs.transform(target.name, source.name, x * target.xstep, y * target.ystep)
            return mx / source.xstep, my / source.ystep

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x"))
                corners = [np.stack(mapped(x + i, y + j)) for j in (0, 1) for i in (0, 1)]
                with np.errstate(invalid="ignore"):
                    across = np.nanmax([np.zeros_like(corners[0]), np.abs(corners[1] - corners[0]), np.abs(corners[3] - corners[2])], axis=(0, 1))
                    down = np.nanmax([np.zeros_like(corners[0]), np.abs(corners[2] - corners[0]), np.abs(corners[3] - corners[1])], axis=(0, 1))
                    a, b = corners[1] - corners[0], corners[2] - corners[0]
                    size = np.abs(a[0] * b[1] - a[1] * b[0])
                size = np.where(np.isfinite(size), size, across * down)
                nx, ny = (np.maximum(least, np.ceil(2 * d)).astype(np.int64) if least else np.ones(len(x), np.int64) for d in (across, down))
                for px, py in np.unique(np.stack([nx, ny]), axis=1).T.tolist() if len(x) else []:
                    every = np.flatnonzero((nx == px) & (ny == py))
                    step = max(1, MOST_POINTS // (px * py))
                    for lo in range(0, len(every), step):
                        own = every[lo : lo + step]
                        t, cy, cx, n = _counted(mapped, x[own], y[own], px, py)
                        columns = [y[own][t], x[own][t], cy, cx, n / (px * py), size[own][t]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["y", "x", "my", "mx", "w", "size"])

        return targets.mapInArrow(run, "y long, x long, my long, mx long, w double, size double")

    def _warped(self, rows: DataFrame, w: Window) -> DataFrame:
        from gridloom.plans.layer import lattice

        source = rows.select(F.col("y").alias("my"), F.col("x").alias("mx"), "v")
        nearest = self.method is ResamplingMethod.Nearest
        pieces = self._overlaps(lattice(w), 0 if nearest else 4)
        if nearest:
            return pieces.select("y", "x", "my", "mx").join(source, ["my", "mx"]).select("y", "x", "v")
        share = F.col("w") * F.col("size") if self.method is ResamplingMethod.Sum else F.col("w")
        return resampled(pieces.join(source, ["my", "mx"]).select("y", "x", "v", share.alias("w")), self.method)


#: Points that are mapped at a time.
MOST_POINTS = 1_000_000


def _counted(mapped, x: np.ndarray, y: np.ndarray, px: int, py: int) -> tuple[np.ndarray, ...]:
    """(target, row, column, points) of the cells that the px x py points of each target fall into."""
    found: list[np.ndarray] = []
    rows = max(1, MOST_POINTS // (px * len(x)))
    for lo in range(0, py, rows):
        j, i = np.meshgrid(np.arange(lo, min(lo + rows, py)), np.arange(px), indexing="ij")
        mx, my = mapped((x[:, None] + (i.ravel() + 0.5) / px).ravel(), (y[:, None] + (j.ravel() + 0.5) / py).ravel())
        ok = np.isfinite(mx) & np.isfinite(my)
        target = np.repeat(np.arange(len(x)), i.size)[ok]
        cy, cx = (np.floor(m[ok] + 1e-9).astype(np.int64) for m in (my, mx))
        cells, n = _unique(target, cy, cx, np.ones(len(target), np.int64))
        found.append(np.vstack([cells, n]))
    if len(found) > 1:
        cells, n = _unique(*np.hstack(found))
        return (*cells, n)
    return tuple(found[0])


def _unique(target: np.ndarray, cy: np.ndarray, cx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (target, row, column) and the sums of n."""
    order = np.lexsort((cx, cy, target))
    cells = np.stack([target, cy, cx])[:, order]
    first = np.flatnonzero(np.r_[True, (cells[:, 1:] != cells[:, :-1]).any(axis=0)]) if len(order) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n[order], first) if len(order) else np.zeros(0, np.int64)
    return cells[:, first], sums
