"""Mosaics: many layers that act as one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DataType
from gridloom.plans.geometry import Window
from gridloom.plans.layer import MISMATCH, Data, Layer, TableLayer, find_union


#: Mosaics of more layers aren't checked for gaps.
MOST_CHECKED = 2000


class MosaicEmpty(ValueError):
    """There is nothing to make a mosaic of."""


class Mosaic(Data):
    """The first layer of the list that covers a pixel gives its value; gaps are 0.

    Layers with a nodata value let lower ones show through where they have it; other layers' NaN is data.  Layers that
    don't reach a window are not read for it.
    """

    def __init__(self, layers: Sequence[Layer], name: str = ""):
        if not layers:
            raise MosaicEmpty("a mosaic needs at least one layer")
        if any(layer.projection != layers[0].projection for layer in layers):
            raise ValueError(MISMATCH)
        self.layers = list(layers)
        super().__init__(find_union(self.layers), self.layers[-1].datatype, None, name)

    @property
    def dense(self) -> bool:
        """True if the layers that fill their areas leave no gap in the whole; then no lattice is needed beside it."""
        full = [layer.area.window for layer in self.layers if isinstance(layer, TableLayer) and layer.dense and layer.nodata is None]
        if not full or len(full) > MOST_CHECKED:
            return False
        xs = np.unique([x for w in full for x in (w.xoff, w.xend)])
        ys = np.unique([y for w in full for y in (w.yoff, w.yend)])
        held = np.zeros((len(ys), len(xs)), bool)
        for w in full:
            held[np.searchsorted(ys, w.yoff) : np.searchsorted(ys, w.yend), np.searchsorted(xs, w.xoff) : np.searchsorted(xs, w.xend)] = True
        own = self.area.window
        return bool(held[:-1, :-1].all()) and Window(int(xs[0]), int(ys[0]), int(xs[-1] - xs[0]), int(ys[-1] - ys[0])).contains(own)

    @property
    def datatype(self) -> DataType:
        return self.layers[-1].datatype

    @property
    def key(self):
        return ("mosaic", tuple(layer.key for layer in self.layers), tuple(layer.area.window for layer in self.layers))

    def pixels(self, w: Window) -> DataFrame:
        held = [(priority, layer, own) for priority, layer in enumerate(self.layers) if (own := Window.shared([w, layer.area.window])) is not None]
        if not held:
            return self.layers[0].frame().select("y", "x", F.col("v").cast("double").alias("v")).filter(F.lit(False))
        alone = _apart([own for *_, own in held])
        out = _together([(layer, own) for (_, layer, own), apart in zip(held, alone, strict=True) if apart], w)
        parts = [self._rows(layer, own).withColumn("priority", F.lit(priority)) for (priority, layer, own), apart in zip(held, alone, strict=True) if not apart]
        if parts:  # only layers that meet others are merged
            out.append(reduce(DataFrame.union, parts).groupBy("y", "x").agg(F.min_by("v", "priority").alias("v")))
        return reduce(DataFrame.union, out)

    @staticmethod
    def _rows(layer: Layer, w: Window) -> DataFrame:
        rows = layer.pixels(w) if isinstance(layer, TableLayer) and layer.dense else layer.frame(w)
        v = F.col("v").cast("double")
        return (rows if layer.nodata is None else rows.filter(~F.isnan(v))).select("y", "x", v.alias("v"))


def _apart(windows: Sequence[Window]) -> list[bool]:
    """Which windows meet no other.  Windows are compared with those in the same cells of a grid as coarse as the largest."""
    width, height = max(w.xsize for w in windows), max(w.ysize for w in windows)
    cells: dict[tuple[int, int], list[int]] = {}
    for i, w in enumerate(windows):
        for cy in range(w.yoff // height, (w.yend - 1) // height + 1):
            for cx in range(w.xoff // width, (w.xend - 1) // width + 1):
                cells.setdefault((cy, cx), []).append(i)
    x0, x1, y0, y1 = (np.array([getattr(w, c) for w in windows]) for c in ("xoff", "xend", "yoff", "yend"))
    alone = np.ones(len(windows), bool)
    for members in cells.values():
        m = np.array(members)
        for k, i in enumerate(members):
            rest = m[k + 1 :]
            met = rest[(x0[rest] < x1[i]) & (x0[i] < x1[rest]) & (y0[rest] < y1[i]) & (y0[i] < y1[rest])]
            if len(met):
                alone[met] = alone[i] = False
    return alone.tolist()


def _together(layers: Sequence[tuple[Layer, Window]], w: Window) -> list[DataFrame]:
    """The pixels of layers that don't meet; those of files of one kind are read in one scan."""
    out, scans = [], {}
    for layer, own in layers:
        shared = getattr(layer, "scan_key", None)
        if shared is None:
            out.append(Mosaic._rows(layer, own))
        else:
            scans.setdefault(shared, []).append(layer)
    for group in scans.values():
        rows = group[0].scan(group, w).select("y", "x", group[0].value.cast("double").alias("v"))
        out.append(rows if group[0].nodata is None else rows.filter(~F.isnan("v")))
    return out
