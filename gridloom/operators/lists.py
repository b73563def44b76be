"""Pixel-wise sums and tests over lists of layers: one union and one aggregate instead of a chain of joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dtypes import DataType
from gridloom.plans.geometry import Area, MapProjection, Window
from gridloom.plans.layer import MISMATCH, Data, Expression, Formula, Layer, Literal, as_layer, at_zero


class Stacked(Data):
    """sum, any or all of layers, pixel by pixel.  sum and any cover the box round all, all what they share."""

    def __init__(self, layers: Sequence[Layer], how: str):
        known = [p for layer in layers if (p := layer.projection) is not None]
        if any(p != known[0] for p in known):
            raise ValueError(MISMATCH)
        super().__init__(Area.world(), DataType.Float64)
        self.children, self.how = tuple(layers), how

    def _area(self, forced: bool = False) -> Area:
        areas = [c._area(forced) for c in self.children]
        return reduce((lambda a, b: a & b) if self.how == "all" else (lambda a, b: a | b), areas)

    @property
    def projection(self) -> MapProjection | None:
        return next((p for c in self.children if (p := c.projection) is not None), None)

    @property
    def datatype(self) -> DataType:
        return DataType.joint([c.datatype for c in self.children])

    @property
    def key(self):
        return ("stack", self.how, tuple(c.key for c in self.children))

    def describe(self) -> str:
        return f"{self.how} of {len(self.children)}"

    def pixels(self, w: Window) -> DataFrame:
        floats = any(c.datatype.is_float for c in self.children)
        v = F.col("v").cast("double" if floats or self.how != "sum" else "bigint")
        parts = []
        for c in self.children:  # only what a child's own area holds: beyond it is 0
            held = Window.shared([w, c.area.window])
            if held is not None:
                parts.append(c.frame(held, sparse=True).select("y", "x", v.alias("v")))
        if not parts:
            return self.children[0].frame().select("y", "x", v.alias("v")).filter(F.lit(False))
        rows = reduce(DataFrame.union, parts).groupBy("y", "x")
        if self.how == "sum":
            return rows.agg(F.sum("v").alias("v"))
        true = F.sum(F.when(F.col("v") != 0, 1).otherwise(0))
        return rows.agg((true > 0 if self.how == "any" else true == len(self.children)).alias("v"))


def _plain(layer: Layer) -> bool:
    """Whether the layer is 0 outside its own area, so that only its pixels need to be stacked."""
    return not isinstance(layer, (Literal, Formula)) and at_zero(layer) == 0


def _stack(layers: Sequence[object], how: str, op: str) -> Layer:
    if isinstance(layers, Layer) or not layers:
        raise ValueError(f"{how} takes a list of layers that isn't empty")
    layers = [as_layer(x) for x in layers]
    if how != "sum":
        layers = [Expression("ne", (x, 0)) for x in layers]
    if len(layers) == 1:
        return layers[0]
    if all(map(_plain, layers)):
        return Stacked(layers, how)
    return reduce(lambda a, b: Expression(op, (a, b)), layers)


def sum_of(layers: Sequence[object]) -> Layer:
    return _stack(layers, "sum", "add")


def any_of(layers: Sequence[object]) -> Layer:
    return _stack(layers, "any", "logical_or")


def all_of(layers: Sequence[object]) -> Layer:
    return _stack(layers, "all", "logical_and")


