"""Moving-window weighted sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DataType
from gridloom.plans.geometry import Area, MapProjection, Window
from gridloom.plans.layer import Data, Layer

#: Side of the square tiles that the work is dealt in.
TILE = 256


class Convolved(Data):
    """Cross-correlation of a layer or expression with a kernel.

    Pixels are dealt to square tiles, those near an edge also to the neighbours that need them (the halo), so each
    pixel moves about once whatever the kernel's size, and a task holds one tile at a time.
    """

    complete = True

    def __init__(self, child: Layer, weights, tile: int = TILE):
        weights = np.asarray(weights, np.float32).astype(np.float64)
        if weights.ndim != 2 or weights.shape[0] != weights.shape[1] or weights.shape[0] % 2 == 0:
            raise ValueError("the kernel must be square with an odd side")
        super().__init__(Area.world(), DataType.Float32)
        self.children, self.weights, self.tile = (child,), weights, max(tile, weights.shape[0])

    def _area(self, forced: bool = False) -> Area:
        return self.children[0]._area(forced)

    @property
    def projection(self) -> MapProjection | None:
        return self.children[0].projection

    @property
    def datatype(self) -> DataType:
        return self.children[0].datatype

    def describe(self) -> str:
        return f"conv2d {self.weights.shape[0]}x{self.weights.shape[1]}"

    def pixels(self, w: Window) -> DataFrame:
        r, size, weights = self.weights.shape[0] // 2, self.tile, self.weights
        child = self.children[0]
        around = child.frame(w.grow(r)).select("y", "x", F.col("v").cast("double").alias("v"))

        def tiles(c: str):
            first, last = F.floor((F.col(c) - r) / size), F.floor((F.col(c) + r) / size)
            return F.array_distinct(F.array(first, last))

        dealt = around.withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x")))

        def one(table: pa.Table) -> pa.Table:
            ty, tx = table["ty"][0].as_py(), table["tx"][0].as_py()
            data = np.zeros((size + 2 * r, size + 2 * r))
            y, x = table["y"].to_numpy() - (ty * size - r), table["x"].to_numpy() - (tx * size - r)
            data[y, x] = table["v"].to_numpy()
            out = np.zeros((size, size))
            for dy in range(2 * r + 1):
                for dx in range(2 * r + 1):
                    if weights[dy, dx]:
                        out += weights[dy, dx] * data[dy : dy + size, dx : dx + size]
            y0, y1 = max(w.yoff - ty * size, 0), min(w.yend - ty * size, size)
            x0, x1 = max(w.xoff - tx * size, 0), min(w.xend - tx * size, size)
            if y0 >= y1 or x0 >= x1:
                ys = xs = np.zeros(0, np.int64)
                part = np.zeros(0)
            else:
                ys, xs = (a.ravel() for a in np.mgrid[y0:y1, x0:x1])
                part = out[y0:y1, x0:x1].ravel()
            return pa.table({"y": pa.array(ys + ty * size), "x": pa.array(xs + tx * size), "v": pa.array(part)})

        return dealt.groupBy("ty", "tx").applyInArrow(one, "y long, x long, v double")

